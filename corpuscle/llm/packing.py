"""Best-fit packing of token sequences by exact complements.

Only the histogram of piece lengths decides a packing, and it has at most `capacity` entries whatever the size
of the corpus. The driver plans on it: for each length, longest first, it looks up single lengths, then pairs,
then triples whose sum fills the gap exactly, and consumes as many as the counts allow at once; what is left is
placed by best-fit decreasing, again many at a time. The plan is a list of slots: n pieces of one length, by
their rank among pieces of that length, lie at one offset of n consecutive sequences. The executors rank the
pieces and look their slots up.

Rows: a null text counts as empty; an empty text is one piece of the end token alone. Ties (equal lengths) and
repeated rows are told apart by their place in the stored table. Long texts are cut into pieces of the capacity,
the last one shorter. An empty table gives an empty table. Other columns of the input are not carried, so clashing
names do no harm. All columns but `text` may be null and are returned as they are.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle.llm.bpe import SPELLED_OUT, spelled_out
from corpuscle.llm.shared import bounded, lean, small_batches, stored
from corpuscle.llm.words import LOWER, WordTable, laid_out, word_bounds

#: Entries of a worker's table of words, and the longest piece that is merged in numpy.
WORDS, LONGEST = 1 << 20, 32
#: The pieces that the tokenizer's first step cuts a text into, after it is in lower case and composed.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: No code point below this is composed with another or changes by composition.
COMPOSED = SPELLED_OUT
#: Bytes of text that are encoded at once.
STEP = 1 << 20


class PieceMerges:
    """Byte pair encoding of many pieces at once: each round merges the best pair of every piece, the first of equals."""

    NONE = 1 << 30
    BITS = 18

    def __init__(self, vocab: dict[str, int], merges: list[list[str]], end: str):
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        name = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in shown)}
        self._inner = np.array([vocab[name[b]] for b in range(256)], np.int32)
        self._last = np.array([vocab[name[b] + end] for b in range(256)], np.int32)
        self._made = np.array([vocab[a + b] for a, b in merges], np.int32)
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in merges], np.int64)
        self._key, self._rank = np.full(1 << self.BITS, -1, np.int64), np.full(1 << self.BITS, self.NONE, np.int32)
        todo = np.arange(len(keys))
        slot = self._home(keys)
        while len(todo):
            free = np.flatnonzero(self._key[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            mine = free[first]
            self._key[slot[mine]], self._rank[slot[mine]] = keys[todo[mine]], todo[mine]
            rest = np.ones(len(todo), bool)
            rest[mine] = False
            todo, slot = todo[rest], (slot[rest] + 1) & ((1 << self.BITS) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - self.BITS)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge; NONE if there is none, or a side is missing (below zero)."""
        out = np.full(len(left), self.NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left[todo].astype(np.int64) << 16 | right[todo]
        slot = self._home(keys)
        while len(todo):
            there = self._key[slot]
            same = there == keys
            out[todo[same]] = self._rank[slot[same]]
            on = (there >= 0) & ~same
            todo, keys, slot = todo[on], keys[on], (slot[on] + 1) & ((1 << self.BITS) - 1)
        return out

    def ids(self, pieces: list[bytes]) -> list[bytes]:
        """Ids as unsigned 16-bit numbers, of pieces of 1 to `LONGEST` bytes."""
        out: list[bytes] = [b""] * len(pieces)
        sizes = np.array([len(p) for p in pieces])
        for width in (4, 8, 12, 20, LONGEST):
            rows = np.flatnonzero((sizes > (0 if width == 4 else before)) & (sizes <= width))
            before = width
            for at in range(0, len(rows), 8192):
                own = rows[at : at + 8192]
                for i, x in zip(own.tolist(), self._merged([pieces[i] for i in own.tolist()], sizes[own], width), strict=True):
                    out[i] = x
        return out

    def _merged(self, pieces: list[bytes], sizes: np.ndarray, width: int) -> list[bytes]:
        data = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8).reshape(-1, width)
        column = np.arange(width)
        ids = np.where(column < sizes[:, None], self._inner[data], -1)
        ids[np.arange(len(ids)), sizes - 1] = self._last[data[np.arange(len(ids)), sizes - 1]]
        ids = np.concatenate([ids, np.full((len(ids), 2), -1, ids.dtype)], axis=1)  # what moves left past the end
        ranks = self._ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        whole, rows = ids.copy(), np.arange(len(ids))
        while len(rows):
            best = ranks.argmin(1)
            least = ranks[np.arange(len(rows)), best]
            on = least < self.NONE
            if not on.all():
                whole[rows[~on]] = ids[~on]
                rows, ids, ranks, best, least = rows[on], ids[on], ranks[on], best[on], least[on]
                if not len(rows):
                    break
            every = np.arange(len(rows))
            moved = np.minimum(np.arange(ids.shape[1]) + (np.arange(ids.shape[1]) > best[:, None]), ids.shape[1] - 1)
            ids = np.take_along_axis(ids, moved, 1)
            ids[every, best] = self._made[least]
            ranks = np.take_along_axis(ranks, np.minimum(moved[:, :-1], ranks.shape[1] - 1), 1)
            ranks[every, best] = self._ranks(ids[every, best], ids[every, best + 1])
            back = np.flatnonzero(best > 0)
            ranks[back, best[back] - 1] = self._ranks(ids[back, best[back] - 1], ids[back, best[back]])
        counts = (whole >= 0).sum(1)
        flat, ends = whole[whole >= 0].astype("<u2").tobytes(), (2 * np.cumsum(counts)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


class WordTokenizer:
    """Ids of whole texts by a tokenizer with word ends; the ids of words are kept in a table.

    Words end at ASCII white space, which no piece reaches across. Words of code points below COMPOSED are cut into
    the tokenizer's own pieces, whose merges run for many pieces at once. A text with any other word goes to the
    tokenizer as it stands.
    """

    def __init__(self, path: str, words: int = WORDS):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self._merges = PieceMerges(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self._cut_low = re.compile(spelled_out(PIECES)).findall
        self._high = re.compile(f"[^\0-{chr(COMPOSED - 1)}]").search
        self._table = WordTable(self._learn, entries=words)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, words: list[bytes]) -> list[bytes | None]:
        """Ids of words; None for one that the tokenizer has to see as it stands."""
        cut: list[list[str] | None] = []
        for w in words:
            text = w.decode("utf-8").lower()
            cut.append(None if self._high(text) or "<|" in text else self._cut_low(text))
        pieces = list({p for parts in cut if parts for p in parts})
        raw = [p.encode() for p in pieces]
        some = [i for i, p in enumerate(raw) if len(p) <= LONGEST]
        known = {pieces[i]: x for i, x in zip(some, self._merges.ids([raw[i] for i in some]), strict=True)}
        known.update((p, self._ids(p).astype("<u2").tobytes()) for p in pieces if p not in known)
        return [None if parts is None else b"".join([known[p] for p in parts]) for parts in cut]

    def encode_batch(self, texts: list[str | bytes | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        if not texts:
            return []
        raw, ends = laid_out([t.encode() if isinstance(t, str) else t or b"" for t in texts])
        data = LOWER[np.frombuffer(raw, np.uint8)]
        starts, stops = word_bounds(data)
        entries = self._table.entries(data.tobytes(), data, starts, stops)
        counts = self._table.counts(entries)
        ids = self._table.ids(entries).astype("<u4").tobytes()
        total = np.concatenate([[0], np.cumsum(np.maximum(counts, 0))])
        last = np.searchsorted(starts, ends)  # words up to the end of each text
        cuts = np.concatenate([[0], 4 * total[last]]).tolist()
        odd = np.add.accumulate(np.concatenate([[0], counts < 0]))[np.concatenate([[0], last])]
        out = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for i in np.flatnonzero(np.diff(odd)).tolist():
            out[i] = self._ids(texts[i] if isinstance(texts[i], str) else texts[i].decode()).tobytes()
        return out


@cache
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def pieces(df: DataFrame, path: str, end: int, capacity: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids) of each text's ids and the end token; ids as little-endian 32-bit numbers."""
    small_batches(df.sparkSession)
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), *(T.StructField(x, T.LongType()) for x in ("piece", "start", "length")), T.StructField("ids", T.BinaryType())])
    schema["piece"].dataType = T.IntegerType()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, last, size = _tokenizer(path), np.array([end], "<u4").tobytes(), 4 * capacity
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            for at, stop in bounded(texts, STEP):
                part = b.slice(at, stop - at)
                rows, nth, cut = [], [], []
                for i, own in enumerate(tokenizer.encode_batch(texts.slice(at, stop - at).to_pylist())):
                    ids = own + last
                    for k, start in enumerate(range(0, len(ids), size)):
                        rows.append(i)
                        nth.append(k)
                        cut.append(ids[start : start + size])
                n = np.array(nth, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows, pa.int32())), pa.array(n), pa.array(n.astype(np.int64) * capacity), pa.array([len(x) // 4 for x in cut], pa.int64()), pa.array(cut, pa.binary())],
                    [key, "piece", "start", "length", "ids"],
                )

    return df.select(key, text).mapInArrow(lean(run), schema)


class Sums:
    """An index of sums of present lengths: of each sum the larger halves of its pairs and the largest parts of its
    triples, longest first. Lengths only vanish while a plan is made, so no combination is missed."""

    def __init__(self, present: np.ndarray, capacity: int):
        down = np.flatnonzero(present)[::-1].astype(np.uint16 if capacity < 1 << 16 else np.int64)  # longest first
        self._larger = self._parts(down, present, capacity, 1)
        self._largest = self._parts(down, np.array([len(x) > 0 for x in self._larger]), capacity, 2)

    @staticmethod
    def _parts(down: np.ndarray, others: np.ndarray, capacity: int, times: int) -> list[np.ndarray]:
        """For each sum the lengths whose rest is among the others and not longer than so many times themselves."""
        out = []
        for total in range(capacity + 1):
            own = down[np.searchsorted(-down.astype(np.int64), -total, "right") :]  # shorter than the sum
            own = own[: int(np.searchsorted(-own.astype(np.int64) * (times + 1), -total, "right"))]
            out.append(own[others[total - own.astype(np.int64)]])
        return out

    def pairs(self, total: int) -> np.ndarray:
        return self._larger[total].astype(np.int64)

    def triples(self, total: int) -> np.ndarray:
        return self._largest[total].astype(np.int64)


class Planner:
    """Packs a histogram of lengths; slots hold (length, first rank, pieces, first sequence, offset)."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            if not 0 < length <= capacity:
                raise ValueError(f"length {length} is outside 1..{capacity}")
            self.left[length] += n
        self.used = np.zeros(capacity + 1, np.int64)
        self.slots: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0

    def _put(self, length: int, n: int, sequence: int, offset: int) -> None:
        self.slots.append((length, int(self.used[length]), n, sequence, offset))
        self.used[length] += n
        self.left[length] -= n

    def _fill(self, lengths: list[int]) -> bool:
        """Opens as many sequences of exactly these lengths as the counts allow; whether there was any."""
        need = defaultdict(int)
        for x in lengths:
            need[x] += 1
        n = min(int(self.left[x]) // k for x, k in need.items())
        offset = 0
        for x in lengths if n else ():
            self._put(x, n, self.sequences, offset)
            offset += x
        self.sequences += n
        return n > 0

    def exact(self) -> None:
        """Longest first, each length takes what fills its gap exactly: one length, a pair, or a triple from the index."""
        index = Sums(self.left > 0, self.capacity)
        for length in range(self.capacity, 0, -1):
            gap = self.capacity - length
            if not self.left[length]:
                continue
            if gap == 0:
                self._fill([length])
                continue
            if self.left[gap]:
                self._fill([length, gap])
            if self.left[length]:
                for b in self._present(index.pairs(gap), gap):
                    if self._fill([length, b, gap - b]) and not self.left[length]:
                        break
            if self.left[length]:
                self._triples(length, gap, index)

    def _present(self, larger: np.ndarray, total: int) -> list[int]:
        """Of the larger halves of a sum those of pairs that are both still there."""
        return larger[(self.left[larger] > 0) & (self.left[total - larger] > 0)].tolist()

    def _triples(self, length: int, gap: int, index: Sums) -> None:
        largest = index.triples(gap)
        for c in largest[self.left[largest] > 0].tolist():
            pairs = index.pairs(gap - c)
            for b in self._present(pairs[pairs <= c], gap - c):
                if self._fill([length, c, b, gap - c - b]) and not self.left[length]:
                    return
                if not self.left[c]:
                    break

    def best_fit(self) -> None:
        open_: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by gap: runs of sequences
        gaps: list[int] = []

        def free(gap: int, first: int, n: int) -> None:
            if gap:
                if not open_[gap]:
                    insort(gaps, gap)
                open_[gap].append((first, n))

        for length in range(self.capacity, 0, -1):
            while self.left[length]:
                at = bisect_left(gaps, length)
                if at == len(gaps):
                    each = self.capacity // length
                    n = int(self.left[length])
                    for new, k in ((n // each, each), (1, n % each)):
                        if new and k:
                            for i in range(k):
                                self._put(length, new, self.sequences, i * length)
                            free(self.capacity - k * length, self.sequences, new)
                            self.sequences += new
                    continue
                gap = gaps[at]
                first, n = open_[gap].pop()
                if not open_[gap]:
                    gaps.pop(at)
                take = min(n, int(self.left[length]))
                if take < n:
                    free(gap, first + take, n - take)
                self._put(length, take, first, self.capacity - gap)
                free(gap - length, first, take)

    def plan(self) -> np.ndarray:
        self.exact()
        self.best_fit()
        return np.array(sorted(self.slots), np.int64).reshape(-1, 5)


def pack(df: DataFrame, capacity: int, length: str = "length") -> DataFrame:
    """df with sequence_id and offset. Rows whose length is null, below 1 or above the capacity have no place: both are
    null for them.

    df is written to the shared folder once, so that ranks stay the same when a task is run again.
    """
    whole = stored(df.withColumn("_task", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "pieces")
    fits = F.coalesce(F.col(length).between(1, capacity), F.lit(False))
    base = whole.where(fits)
    counts = base.groupBy("_task", F.col(length).alias("_length")).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("_length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)))
    histogram = counts.groupBy("_length").agg(F.sum("_n").alias("_n")).collect()  # at most `capacity` rows
    slots = Planner({r["_length"]: r["_n"] for r in histogram}, capacity).plan()
    names = [f.name for f in df.schema.fields]
    ranked = (
        base.withColumn("_nth", F.row_number().over(Window.partitionBy("_task", length).orderBy("_at")) - 1)
        .join(before.select(F.col("_task").alias("_t"), "_length", "_before"), (F.col("_task") == F.col("_t")) & (F.col(length) == F.col("_length")))
        .select(*names, F.col("_length").cast("long").alias("_length"), (F.coalesce("_before", F.lit(0)) + F.col("_nth")).alias("_rank"))
    )
    span = int(slots[:, 2].sum() + 1) if len(slots) else 1
    keys = slots[:, 0] * span + slots[:, 1] if len(slots) else slots[:, 0]
    if len(slots) and int(slots[-1, 0]) * span >= 1 << 62:
        raise ValueError("too many pieces for one plan")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, ranks = (b.column(i).to_numpy(zero_copy_only=False) for i in (b.num_columns - 2, b.num_columns - 1))
            found = slots[np.searchsorted(keys, sizes * span + ranks, "right") - 1]
            made = [pa.array(found[:, 3] + ranks - found[:, 1]), pa.array(found[:, 4])]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *made], [*names, "sequence_id", "offset"])

    kept = [f for f in df.schema.fields]
    placed = ranked.mapInArrow(run, T.StructType([*kept, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    none = F.lit(None).cast("long")
    return placed.unionByName(whole.where(~fits).select(*names, none.alias("sequence_id"), none.alias("offset")))
