"""Near-duplicate texts by similarity of word shingles: SimHash links of the Golay code, verified, and an exact rest.

Texts are near-duplicates if the sets of their shingles of `width` words have a Jaccard similarity of at least
`similarity` (0.8). Texts of equal sets are one unit. Links between units come in two rounds, and each is checked on
whole texts before it counts:

1. Units of equal or linked SimHash fingerprints (the module `simhash`: nearby codewords of the Golay code as keys,
   pigeonhole), and units that share one of the `LEADS` smallest hashes of their sets. Within a key only pairs that
   join what is apart are sent. What is verified gives the units their labels.
2. A fingerprint cannot promise to meet every pair at 0.8, so the rest is exact: two sets of similarity t or more share
   a shingle among the first (1 - t) n + 1 of each in any common order (rare shingles first, by counts of all texts in
   `BUCKETS` buckets). Under such a key all pairs of different labels are compared by size and by parities of their
   sets, which no similar pair fails, and what passes and was not checked yet is checked on whole texts.

So no similar pair is left between two groups, whatever the number of texts under a key. Groups above the block size
are dealt to pairs of blocks, so that a task holds two blocks of a key at most.

Rows: null and empty texts have no shingles and are duplicates of each other only; a null text that stays comes out
empty. A text of fewer words is one shingle. Rows with a null key are grouped too, and lend a group no name. Ties and
repeated rows are equal sets. An empty table gives an empty table; columns of any name are carried along.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle.llm import simhash
from corpuscle.llm.components import components
from corpuscle.llm.shared import lean, stored, texts_by_id, unzipped
from corpuscle.llm.words import LOWER, laid_out, ranges, word_bounds

#: Rows of one key that a task compares at once.
BLOCK = 8192
#: Smallest hashes of a set that are keys of the first round, and rows of a large key that all its blocks see there.
LEADS, ANCHORS = 8, 64
#: Buckets of the shingle counts (a power of two), and the fewest parities of a set; larger sets have up to 128 times as many.
BUCKETS, PARITIES, FINEST = 1 << 16, 512, 7
#: Bytes of parities that are compared at once.
COMPARED = 8 << 20
#: Bytes of texts that are cut into shingles at once.
STEP = 1 << 20
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


# --- sets of shingles


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _B
    return h ^ (h >> np.uint64(29))


def _word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A hash of each word, eight bytes after the other."""
    sizes = stops - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    at = np.ndarray((len(padded) - 7,), "<u8", padded.data, strides=(1,))
    masks = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
    h = _mixed((at[starts] & masks[np.minimum(sizes, 8)]) * _A + sizes.astype(np.uint64))
    rows, k = np.flatnonzero(sizes > 8), 8
    while len(rows):
        h[rows] = _mixed(h[rows] * _A + (at[starts[rows] + k] & masks[np.minimum(sizes[rows] - k, 8)]))
        k += 8
        rows = rows[sizes[rows] > k]
    return h


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles, in lower case (A-Z only)."""
    raw, ends = laid_out(texts)
    data = LOWER[np.frombuffer(raw, np.uint8)]
    starts, stops = word_bounds(data)
    words = _word_hashes(data, starts, stops)
    last = np.searchsorted(starts, ends)
    first = np.concatenate([[0], last[:-1]])
    whole = words.copy()
    for j in range(1, min(width, len(words))):
        whole[: len(words) - j] = _mixed(whole[: len(words) - j] * _A + words[j:])
    out = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(whole[a : b - width + 1]))
        elif a == b:
            out.append(np.zeros(0, np.uint64))
        else:
            h = words[a : a + 1].copy()
            for j in range(a + 1, b):
                h = _mixed(h * _A + words[j])
            out.append(h)
    return out


def shingle_set(text: str | None, width: int) -> np.ndarray:
    return shingle_sets([(text or "").encode("utf-8", "replace")], width)[0]


def similarity_of(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; two empty ones are equal."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def simhash_of(own: np.ndarray) -> int:
    """Bits that more than half of the hashes have: eight bits of all bytes are summed at a time, in bytes of a number."""
    lanes = np.uint64(0x0101010101010101)
    h = np.concatenate([own, np.zeros(-len(own) % 255, np.uint64)]).reshape(-1, 255)
    out = 0
    for bit in range(8):
        part = (h >> np.uint64(bit) & lanes).sum(1, dtype=np.uint64).view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
        for byte in np.flatnonzero(2 * part > len(own)).tolist():
            out |= 1 << 8 * byte + bit
    return out


def parities(own: np.ndarray) -> bytes:
    """Whether an odd number of hashes falls in each of as many classes as there are hashes, or up to twice as many.

    Sets differ in at least as many hashes as parities. The parities of fewer classes are those of two halves together.
    """
    level = min(FINEST, max(0, (max(1, len(own)) - 1).bit_length() - (PARITIES - 1).bit_length()))
    n = PARITIES << level
    odd = np.bincount((own * _A >> np.uint64(32)).astype(np.int64) & (n - 1), minlength=n) & 1
    return np.packbits(odd).tobytes()


class Parities:
    """The parities of many sets. For each level the rows whose parities are that fine or finer, at that level."""

    def __init__(self, rows: list[bytes]):
        width = PARITIES // 64
        self.level = np.array([(len(x) // (8 * width)).bit_length() - 1 for x in rows], np.int64)
        self._at, self._bits = [], []
        for level in range(int(self.level.max(initial=-1)) + 1):
            own = np.flatnonzero(self.level >= level)
            at, bits = np.full(len(rows), -1), np.empty((len(own), width << level), np.uint64)
            at[own] = np.arange(len(own))
            for finer in range(level, int(self.level.max()) + 1):
                some = np.flatnonzero(self.level == finer)
                made = np.frombuffer(b"".join([rows[i] for i in some.tolist()]), np.uint64).reshape(len(some), width << finer)
                while made.shape[1] > width << level:
                    made = made[:, : made.shape[1] // 2] ^ made[:, made.shape[1] // 2 :]
                bits[at[some]] = made
            self._at.append(at)
            self._bits.append(bits)

    def within(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Whether the sets of each pair may differ in no more hashes than the limit."""
        ok = np.ones(len(a), bool)
        finest = np.minimum(self.level[a], self.level[b])
        for level, (at, bits) in enumerate(zip(self._at, self._bits, strict=True)):
            if level and not (finest >= level).any():
                break
            # All pairs at the coarsest level, those that pass at the finest that both have.
            todo = np.flatnonzero(ok & (finest == level)) if level else np.arange(len(a))
            step = COMPARED // (8 * bits.shape[1])
            for first in range(0, len(todo), step):
                own = todo[first : first + step]
                ok[own] = np.bitwise_count(bits[at[a[own]]] ^ bits[at[b[own]]]).sum(1, dtype=np.int64) <= limit[own]
        return ok


def prefix(own: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first hashes of a set, those in thin buckets before others, of which similar sets share one."""
    n = len(own) - math.ceil(similarity * len(own) - 1e-9) + 1
    return own[np.lexsort((own, counts[own >> np.uint64(48)]))[:n]] if len(own) else own


def _texts(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of a column of packed ones, with the row each run begins at."""
    held, at, size = [], 0, 0
    for i, z in enumerate(column.to_pylist()):
        held.append(unzipped(z))
        size += len(held[-1])
        if size >= STEP:
            yield at, held
            held, at, size = [], i + 1, 0
    if held:
        yield at, held


# --- what a text becomes

_PRINTS = "kind byte, id long, name binary, size int, word long, bits binary"


def _printed(width: int):
    """Rows of (id, z) become prints of kind 0; each task ends with the counts of its shingles by bucket, of kind 1."""

    def rows(kind: int, ids, names, sizes, words, bits) -> pa.RecordBatch:
        n = len(ids)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int8)), pa.array(ids, pa.int64()), names, sizes, pa.array(words, pa.int64()), bits], ["kind", "id", "name", "size", "word", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for at, texts in _texts(b.column(1)):
                sets = shingle_sets(texts, width)
                counts += np.bincount(np.concatenate(sets) >> np.uint64(48), minlength=BUCKETS)
                names = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets]
                words = np.array([simhash_of(x) for x in sets], np.uint64).view(np.int64)
                yield rows(0, b.column(0).slice(at, len(sets)).to_numpy(), pa.array(names, pa.binary()), pa.array([len(x) for x in sets], pa.int32()), words, pa.array([parities(x) for x in sets], pa.binary()))
        some = np.flatnonzero(counts)
        yield rows(1, some, pa.nulls(len(some), pa.binary()), pa.nulls(len(some), pa.int32()), counts[some], pa.nulls(len(some), pa.binary()))

    return run


def _keyed(width: int, similarity: float, counts: np.ndarray | None):
    """(key, unit) of (unit, z): a set's smallest hashes or, with counts, its prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in _texts(b.column(1)):
                keys = [prefix(x, counts, similarity) if counts is not None else x[:LEADS] for x in shingle_sets(texts, width)]
                units = np.repeat(b.column(0).slice(at, len(keys)).to_numpy(), [len(k) for k in keys])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(units)], ["key", "unit"])

    return run


# --- groups of rows with a common key


def _met(block: int):
    """(key, unit, block) of sorted (key, unit) rows whose key has another row; rows of a key are numbered in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, unit, seen = np.zeros(0, np.int64), np.zeros(0, np.int64), 0  # the last row, and how many of its key came
        for b in batches:
            if not b.num_rows:
                continue
            k, u = (np.concatenate([x, b.column(i).to_numpy()]) for i, x in enumerate((key, unit)))
            new = np.concatenate([[True], k[1:] != k[:-1]])
            begins = np.flatnonzero(new)
            nth = np.arange(len(k)) - begins[np.cumsum(new) - 1]
            if len(key):  # the row that was held back, of which some may have been sent
                nth[: begins[1] if len(begins) > 1 else len(k)] += seen - 1
            more = np.concatenate([~new[1:], [False]]) | (nth > 0)
            more[-1] = False  # held back until the next row is known
            yield pa.RecordBatch.from_arrays([pa.array(k[more]), pa.array(u[more]), pa.array((nth[more] // block).astype(np.int32))], ["key", "unit", "block"])
            key, unit, seen = k[-1:], u[-1:], int(nth[-1]) + 1
        if seen > 1:
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(unit), pa.array(np.array([(seen - 1) // block], np.int32))], ["key", "unit", "block"])

    return run


class Rows:
    """Columns of sorted rows (key, part, unit, label, size, bits); bits are parities()."""

    def __init__(self, key, part, unit, label, size, bits):
        self.columns = (key, part, unit, label, size, bits)
        self.key, self.part, self.unit, self.label, self.size, self.bits = self.columns

    @classmethod
    def of(cls, b: pa.RecordBatch) -> Rows:
        bits = np.empty(b.num_rows, object)
        bits[:] = b.column(5).to_pylist()
        return cls(*(b.column(i).to_numpy() for i in range(5)), bits)

    def __len__(self) -> int:
        return len(self.key)

    def at(self, rows) -> Rows:
        return Rows(*(x[rows] for x in self.columns))

    def and_(self, other: Rows) -> Rows:
        return Rows(*(np.concatenate(x) for x in zip(self.columns, other.columns, strict=True)))

    def groups(self) -> np.ndarray:
        return np.cumsum(np.concatenate([[0], (self.key[1:] != self.key[:-1]) | (self.part[1:] != self.part[:-1])]))


def meetings(rows: Rows, similarity: float, joining: bool) -> np.ndarray:
    """Pairs of units of different labels in a group that may be similar: all, or with `joining` those that join what
    is apart when the pairs before are taken for links."""
    group, bits = rows.groups(), Parities(rows.bits.tolist())
    names, top = np.unique(rows.label, return_inverse=True)
    up = np.arange(len(names))  # of each label the one that it was joined to
    out: list[np.ndarray] = []

    def find(x: int) -> int:
        while up[x] != x:
            x = int(up[x])
        return x

    def take(a: np.ndarray, b: np.ndarray, order: np.ndarray) -> None:
        ok = np.flatnonzero(up[top[order[a]]] != up[top[order[b]]])
        a, b = order[a[ok]], order[b[ok]]
        # False only for pairs that cannot reach the similarity: by their sizes, or the least number of differences.
        x, y = rows.size[a], rows.size[b]
        ok = np.minimum(x, y) >= similarity * np.maximum(x, y) - 1e-9
        a, b, most = a[ok], b[ok], (x[ok] + y[ok]) * (1 - similarity) / (1 + similarity) + 1e-9
        ok = bits.within(a, b, most)
        a, b = a[ok], b[ok]
        if joining:
            new = []
            for i, (x, y) in enumerate(zip(top[a].tolist(), top[b].tolist(), strict=True)):
                x, y = find(x), find(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
                    new.append(i)
            while not np.array_equal(flat := up[up], up):
                up[:] = flat
            a, b = a[new], b[new]
        if len(a):
            out.append(np.stack([np.minimum(rows.unit[a], rows.unit[b]), np.maximum(rows.unit[a], rows.unit[b])], 1))

    every = np.arange(len(rows))
    for d in range(1, 9) if joining else ():
        left = every[: max(0, len(every) - d)]
        left = left[group[left] == group[left + d]]
        take(left, left + d, every)
    # By label: each row meets the rows after its own label's.
    order = np.lexsort((up[top], group))
    group = group[order]
    run = np.cumsum(np.concatenate([[0], (group[1:] != group[:-1]) | (up[top[order]][1:] != up[top[order]][:-1])]))
    other, ends, left = np.searchsorted(run, run, "right"), np.searchsorted(group, group, "right"), every
    while len(left := left[other[left] < ends[left]]):
        take(left, other[left], order)
        other[left] += 1
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)


def _meeting(similarity: float, joining: bool, block: int):
    """(a, b) of sorted rows. With `joining` a group above the block size is taken in blocks, which share its first rows."""

    def pairs(rows: Rows) -> pa.RecordBatch:
        found = meetings(rows, similarity, joining)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, i])) for i in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Rows | None = None
        for b in batches:
            if b.num_rows:
                held = held.and_(Rows.of(b)) if held is not None else Rows.of(b)
                last = int(np.argmax((held.key == held.key[-1]) & (held.part == held.part[-1])))
                if last >= block:
                    yield pairs(held.at(slice(last)))
                    held = held.at(slice(last, None))
                if joining and len(held) - last >= 2 * block and last < block:
                    yield pairs(held)
                    held = held.at(slice(last, last + ANCHORS))
        if held is not None and len(held):
            yield pairs(held)

    return run


def _verified(width: int, similarity: float):
    """(a, b) of (a, b, z, z) rows whose texts are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                packed = [part.column(i).to_pylist() for i in (2, 3)]
                distinct = {z: i for i, z in enumerate(dict.fromkeys([*packed[0], *packed[1]]))}
                sets = shingle_sets([unzipped(z) for z in distinct], width)
                ok = [similarity_of(sets[distinct[x]], sets[distinct[y]]) >= similarity for x, y in zip(*packed, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of neighbours in sorted (word, unit) rows with equal words."""
    held: tuple[np.ndarray, np.ndarray] | None = None
    for b in batches:
        word, unit = (b.column(i).to_numpy() for i in (0, 1))
        if held is not None:
            word, unit = np.concatenate([held[0], word]), np.concatenate([held[1], unit])
        same = np.flatnonzero(word[1:] == word[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(unit[same]), pa.array(unit[same + 1])], ["a", "b"])
        held = word[-1:], unit[-1:]


# --- the operator

_PAIR = "a long, b long"
_ROWS = ("key", "part", "unit", "label", "size", "bits")


def groups(base: DataFrame, width: int = 5, similarity: float = 0.8, block: int = BLOCK) -> DataFrame:
    """(id, group) of (id, z) rows: the smallest id that a row reaches through near-duplicates."""
    prints = stored(base.select("id", "z").mapInArrow(lean(_printed(width)), _PRINTS), "prints")
    counts = np.zeros(BUCKETS, np.int64)
    for r in prints.where("kind = 1").groupBy("id").agg(F.sum("word").alias("n")).collect():  # a row for each bucket
        counts[r["id"]] = r["n"]
    prints = prints.where("kind = 0")
    heads = prints.groupBy("name").agg(F.min_by(F.struct("id", "size", "word", "bits"), "id").alias("h"))
    heads = stored(heads.select("name", F.col("h.id").alias("unit"), "h.size", "h.word", "h.bits"), "heads")
    same = prints.select("id", "name").join(heads.select("name", "unit"), "name").where("id != unit").select(F.col("unit").alias("a"), F.col("id").alias("b"))
    units = heads.where("size > 0")  # no shingles, no other like it
    texts = base.select(F.col("id").alias("unit"), "z").join(units.select("unit"), "unit")

    def similar(pairs: DataFrame, name: str) -> DataFrame:
        both = pairs.join(base.select(F.col("id").alias("a"), F.col("z").alias("za")), "a").join(base.select(F.col("id").alias("b"), F.col("z").alias("zb")), "b")
        return stored(both.select("a", "b", "za", "zb").mapInArrow(lean(_verified(width, similarity)), _PAIR), name)

    # Round 1: fingerprints and leading hashes.
    of_word = units.groupBy("word").agg(F.min("unit").alias("unit"))
    linked = simhash.links(of_word.select(F.col("word").alias("fingerprint")))
    linked = linked.join(of_word.select(F.col("word").alias("a"), F.col("unit").alias("ua")), "a").join(of_word.select(F.col("word").alias("b"), F.col("unit").alias("ub")), "b")
    linked = linked.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b"))
    chained = units.select("word", "unit").repartitionByRange("word", "unit").sortWithinPartitions("word", "unit").mapInArrow(_chained, _PAIR)
    leads = texts.select("unit", "z").mapInArrow(lean(_keyed(width, similarity, None)), "key long, unit long")
    leads = leads.join(units.select("unit", "size", "bits"), "unit").select("key", F.lit(0).alias("part"), "unit", F.col("unit").alias("label"), "size", "bits")
    leads = leads.repartition("key").sortWithinPartitions("key").mapInArrow(lean(_meeting(similarity, True, block)), _PAIR)
    tried = stored(linked.union(chained).union(leads).distinct(), "tried")
    links = similar(tried, "links")
    labels = components(links, "a", "b").select(F.col("node").alias("unit"), F.col("component").alias("label"))

    # Round 2: prefixes, between labels.
    keyed = texts.select("unit", "z").mapInArrow(lean(_keyed(width, similarity, counts)), "key long, unit long")
    met = stored(keyed.repartition("key").sortWithinPartitions("key", "unit").mapInArrow(_met(block), "key long, unit long, block int"), "met")
    met = met.join(labels, "unit", "left").withColumn("label", F.coalesce("label", "unit"))
    mixed = met.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), (F.max("block") + 1).alias("blocks")).where("x < y").select("key", "blocks")
    parts = F.expr("explode(if(blocks = 1, array(0), transform(sequence(0, blocks - 1), j -> least(block, j) * blocks + greatest(block, j))))")
    apart = met.join(mixed, "key").select("key", parts.alias("part"), "unit", "label").join(units.select("unit", "size", "bits"), "unit")
    apart = apart.select(*_ROWS).repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(lean(_meeting(similarity, False, block)), _PAIR)
    rest = stored(apart.distinct().join(tried, ["a", "b"], "left_anti"), "rest")
    links = links.union(similar(rest, "further")).union(same)
    found = stored(components(links, "a", "b"), "groups")
    return base.select("id").join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("group"))


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8, block: int = BLOCK) -> DataFrame:
    """The rows of df without near-duplicates: of each group the row with the smallest key stays (nulls last)."""
    columns = [f for f in df.schema.fields if f.name != text]
    names = [f"c{i}" for i in range(len(columns))]
    own = names[[f.name for f in columns].index(key)]
    base = texts_by_id(df, text, columns, "near")
    named = base.select("id", F.col(own).alias("key")).join(groups(base, width, similarity, block), "id")
    keep = named.groupBy("group").agg(F.min(F.struct(F.col("key").isNull(), "key", "id")).alias("k")).select(F.col("k.id").alias("id"))

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([unzipped(z).decode("utf-8", "replace") for z in b.column(b.num_columns - 1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], texts], [*names, "_text"])

    kinds = [T.StructField(n, f.dataType) for n, f in zip(names, columns, strict=True)]
    out = base.join(keep, "id", "left_semi").select(*names, "z").mapInArrow(lean(opened), T.StructType([*kinds, T.StructField("_text", T.StringType())]))
    at = {f.name: n for f, n in zip(columns, names, strict=True)} | {text: "_text"}
    return out.select(*(F.col(at[c]).alias(c) for c in df.columns))
