"""Removal of long repeated byte strings, by column-wise construction of a collection's suffix order.

What is asked: which strings of `length` bytes start at two places of the collection, and which bytes they cover.

1. Equal texts are counted as one text with a number of copies (hashes are grouped, not texts).
2. Every window of `length` bytes is named by the least hash among its grams of `GRAM` bytes. Equal windows have
   equal names. A run of windows of one name is a fragment; fragments of names that occur once repeat nothing.
3. Fragments are aligned at their named gram, so equal windows start in the same column. A task takes the distinct
   fragments of some names, each at most twice, and builds the collection's suffix order column by column from the
   right: a round inserts one symbol of each fragment, which gives the column's part of the Burrows-Wheeler transform
   (the symbols in the order of the suffixes after them), reorders the suffixes by it, and updates the common
   prefixes of neighbours. As only suffixes of one column can be compared, the transform is the sequence of its
   columns; each is written after the other and read once, by the next round, so a task holds two of them. Where a
   neighbour shares `length` bytes, the window that starts there repeats.
4. Names with more than `CROWD` rows of fragments are named anew by grams of length - 1 bytes, under which at most
   two bytes of a fragment differ, so that a name's distinct fragments are bounded.
5. Repeated windows are joined back to the places of their fragments, and the runs they cover are removed.
6. Where shorter passages are asked for, too, they are found first: a repeated string of `length` bytes lies within the
   bytes that repeated strings of fewer bytes cover, so only those bytes are named again.

Rows: a null text counts as empty and an empty text loses nothing. Texts of any length are whole; their windows are
found some at a time. Repeated rows (equal texts) of at least `length` bytes lose all their bytes. Rows are told
apart by their place in the stored table, so null or repeated keys do no harm. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle.llm.shared import lean, new_path, scratch, stored, texts_by_id, unzipped

GRAM = 100
#: Rows of fragments of one name above which the name is split.
CROWD = 20_000
#: Bytes of fragments whose suffix order is built together.
STEP = 6 << 20
#: Windows named at once.
SPAN = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_M = (1 << 64) - 1


# --- names of windows


class Powers:
    """Powers of the hash's base and of its inverse."""

    def __init__(self) -> None:
        self.n = 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 1 << 16)
            ones = np.ones(self.n, np.uint64)
            ones[1:] = _BASE
            self._up = np.cumprod(ones)
            ones[1:] = pow(_BASE, -1, 1 << 64)
            self._down = np.cumprod(ones)
        return self._up[:n], self._down[:n]


_POWERS = Powers()


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A mixed 64-bit hash of the gram at each place."""
    n = len(data) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _POWERS.upto(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    h = (total[gram:] - total[:n]) * down[:n]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` hashes in a row: least from the block's begin and to its end meet."""
    n = len(h) - width + 1
    padded = np.full(-(-len(h) // width) * width, _M, np.uint64)
    padded[: len(h)] = h
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def named_runs(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, first window, windows, place) of runs of windows whose first gram with the least hash is at one place."""
    h = gram_hashes(data, gram)
    width = length - gram + 1
    n = len(h) - width + 1
    if n <= 0:
        e = np.zeros(0, np.int64)
        return e.astype(np.uint64), e, e, e
    low = least(h, width)
    leads = h[:n] == low  # the window begins with its named gram, so the next one has it no more
    first = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | leads[:-1]]))
    end = np.append(first[1:], n)
    name, place = low[first], end - 1
    for rows in np.array_split(np.flatnonzero(~leads[end - 1]), max(1, len(first) // 8192)):
        if len(rows):  # a smaller hash came in before the named gram was left
            place[rows] = first[rows] + np.argmax(h[first[rows][:, None] + np.arange(width)] == name[rows][:, None], axis=1)
    return name, first, end - first, place


# --- the suffix order


def repeated_windows(group: np.ndarray, fragments: list[bytes], column: np.ndarray, windows: np.ndarray, twice: np.ndarray, length: int) -> list[np.ndarray]:
    """For each fragment the windows (from its own first byte) that start elsewhere in its group, too.

    group: fragments are compared within it. column: where a fragment's first byte stands; windows: how many of its
    first bytes begin a window. twice: fragments that occur more than once, which go in twice.
    """
    n = len(fragments)
    copies = np.concatenate([np.arange(n), np.flatnonzero(twice)])
    sizes = np.array([len(x) for x in fragments])
    base = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(fragments), np.uint8)
    start, stop = column[copies], (column + sizes)[copies]
    offset = base[copies] - start  # byte of column c is data[offset + c]
    of_group = group[copies]
    found = np.zeros(len(data), bool)
    by_stop = np.argsort(-stop, kind="stable")
    next_in = 0
    # Suffix order of the column to the right: rows sorted by group, then suffix; shared[i]: bytes that i and i - 1 share.
    rows, shared = np.zeros(0, np.int64), np.zeros(0, np.int32)
    for c in range(int(stop.max(initial=0)) - 1, int(start.min(initial=0)) - 1, -1):
        alive = start[rows] <= c
        if not alive.all():
            # A row that leaves hands its shared length on: its neighbours share the least of both.
            kept = np.flatnonzero(alive)
            shared = np.minimum.reduceat(shared[: kept[-1] + 1], np.concatenate([[0], kept[:-1] + 1])) if len(kept) else shared[:0]
            rows = rows[kept]
        first = next_in
        while next_in < len(by_stop) and stop[by_stop[next_in]] - 1 >= c:
            next_in += 1
        if next_in > first:  # suffixes that begin here come before all longer ones
            rows = np.concatenate([by_stop[first:next_in], rows])
            shared = np.concatenate([np.zeros(next_in - first, np.int32), shared])
            if next_in - first < len(rows):
                shared[next_in - first] = 0
        if not len(rows):
            continue
        symbol = data[offset[rows] + c]  # this column of the transform
        key = of_group[rows].astype(np.int64) << 8 | symbol
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        same = np.concatenate([[False], ordered[1:] == ordered[:-1]])
        least_between = _least_between(shared, order[:-1], order[1:], same[1:])
        shared = np.zeros(len(rows), np.int32)
        shared[1:][same[1:]] = np.minimum(least_between + 1, length)
        rows = rows[order]
        long = shared >= length
        if long.any():
            long |= np.concatenate([long[1:], [False]])
            hit = rows[long]
            hit = hit[c < (start + windows[copies])[hit]]
            found[offset[hit] + c] = True
    return [np.flatnonzero(found[a : a + w]) for a, w in zip(base[:-1].tolist(), windows.tolist(), strict=True)]


def _least_between(shared: np.ndarray, before: np.ndarray, after: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The least of shared[before + 1 .. after] for the wanted pairs, by doubling."""
    lo, hi = before[wanted] + 1, after[wanted]
    out = np.empty(len(lo), np.int32)
    span = hi - lo + 1
    level = np.frexp(span.astype(np.float64))[1] - 1  # the largest power of two within the span
    table, k = shared, 0
    for k in range(int(level.max(initial=0)) + 1):
        at = np.flatnonzero(level == k)
        if len(at):
            out[at] = np.minimum(table[lo[at]], table[hi[at] - (1 << k) + 1])
        if (1 << k + 1) <= len(shared):
            table = np.minimum(table[: len(table) - (1 << k)], table[1 << k :])
    return out


# --- the operator


def text_runs(text: bytes, length: int, gram: int, within: list[tuple[int, int]] | None = None) -> tuple[np.ndarray, ...]:
    """named_runs of a whole text, or of the windows that lie within given runs of its bytes, in overlapping stretches
    of bounded length."""
    data, parts = np.frombuffer(text, np.uint8), []
    for begin, stop in [(0, len(data))] if within is None else within:
        for at in range(begin, stop - length + 1, SPAN):
            name, first, windows, place = named_runs(data[at : min(stop, at + SPAN + length - 1)], length, gram)
            parts.append((name.view(np.int64), first + at, windows, place + at))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else tuple(np.zeros(0, np.int64) for _ in range(4))


def _longs(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns.values()], list(columns))


def _unpacked(column: pa.Array) -> list[bytes]:
    return [unzipped(z) for z in column.to_pylist()]


def _named(length: int, gram: int, unpack):
    """Runs of (id, n, bytes) rows, without their bytes; n is carried along. A fourth column holds the spans to look at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                within = [list(zip(*(x.tolist() for x in _merged(own)), strict=True)) for own in part.column(3)] if part.num_columns > 3 else [None] * part.num_rows
                made = [text_runs(t, length, gram, w) for t, w in zip(unpack(part.column(2)), within, strict=True)]
                sizes = [len(m[0]) for m in made]
                ids, n = (np.repeat(part.column(i).to_numpy(), sizes) for i in (0, 1))
                yield _longs(dict(zip(("id", "n", "name", "first", "windows", "place"), (ids, n, *(np.concatenate(x) for x in zip(*made, strict=True))), strict=True)))

    return run


_NAMED = "id long, n long, name long, first long, windows long, place long"
_CUT = "id long, first long, k1 long, k2 long, name long, lead long, windows long, n long, fragment binary"
#: Fragments that a task remembers to have sent.
SENT = 200_000


def _cut(length: int, unpack):
    """Fragments of (id, bytes, runs) rows. n is above 0 where the fragment has to be looked at: its bytes come with
    the first of its like in a task, and n is 2 if it stands twice; the second of its like comes without bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[tuple[int, int], int] = {}
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                ids, texts, lists = part.column(0).to_pylist(), unpack(part.column(1)), part.column(2)
                out: list[tuple] = []
                for i, text in enumerate(texts):
                    runs = lists[i].values
                    for n, name, first, windows, place in zip(*(runs.field(k).to_pylist() for k in ("n", "name", "first", "windows", "place")), strict=True):
                        fragment = text[first : first + windows + length - 1]
                        key = struct.unpack("<qq", hashlib.blake2b(fragment, digest_size=16, key=struct.pack("<qq", name, place - first)).digest())
                        before = sent.get(key, 0)
                        out.append((ids[i], first, *key, name, place - first, windows, n if before < 2 else 0, None if before else fragment))
                        if before < 2:
                            sent[key] = before + n
                if len(sent) > SENT:
                    sent.clear()
                columns = list(zip(*out, strict=True)) if out else [()] * 9
                yield pa.RecordBatch.from_arrays([*(pa.array(list(c), pa.int64()) for c in columns[:8]), pa.array(list(columns[8]), pa.binary())], ["id", "first", "k1", "k2", "name", "lead", "windows", "n", "fragment"])

    return run


_HITS = "k1 long, k2 long, begin long, stop long, n long, fragment binary"


def _rows(k1, k2, begin, stop, n, fragment) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (k1, k2, begin, stop, n)), fragment], ["k1", "k2", "begin", "stop", "n", "fragment"])


def _ordered(length: int, crowd: int):
    """Covered bytes of fragments (name, k1, k2, lead, windows, n, fragment) that come sorted; rows of a name with more
    than `crowd` rows come back as they are, with n above 0."""

    def hits(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        name, k1, k2, lead, windows, n = (t[c].to_numpy() for c in ("name", "k1", "k2", "lead", "windows", "n"))
        one = np.flatnonzero(np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (name[1:] != name[:-1])]))
        has = np.flatnonzero(t["fragment"].is_valid().to_numpy())
        bytes_at = has[np.searchsorted(has, one)]  # some row of each fragment has its bytes
        group = np.cumsum(np.concatenate([[0], name[one][1:] != name[one][:-1]]))
        found = repeated_windows(group, t["fragment"].take(pa.array(bytes_at)).to_pylist(), length - lead[one], windows[one], np.add.reduceat(n, one) > 1, length)
        row, begin, stop = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, w in enumerate(found):
            if len(w):
                cut = np.flatnonzero(np.diff(w) > 1) + 1
                begin.append(w[np.concatenate([[0], cut])])
                stop.append(w[np.concatenate([cut - 1, [len(w) - 1]])] + length)
                row.append(np.full(len(cut) + 1, one[i]))
        row = np.concatenate(row) if row else np.zeros(0, np.int64)
        return _rows(k1[row], k2[row], np.concatenate(begin), np.concatenate(stop), np.zeros(len(row), np.int64), pa.nulls(len(row), pa.binary()))

    def given_back(part: pa.RecordBatch) -> pa.RecordBatch:
        z = np.zeros(part.num_rows, np.int64)
        return _rows(part.column(1), part.column(2), z, z, part.column(5), part.column(6))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = size = 0
        at, over = None, None  # the name of the last row held; a name that is given back
        for b in batches:
            names = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                part, name = b.slice(lo, hi - lo), int(names[lo])
                if name == over:
                    yield given_back(part)
                    continue
                if name != at:
                    if size >= STEP:
                        yield hits(held)
                        held, size = [], 0
                    own, count, at = len(held), 0, name
                held.append(part)
                count += part.num_rows
                size += part.column(6).nbytes
                if count > crowd:
                    for x in held[own:]:
                        yield given_back(x)
                    del held[own:]
                    over, at = name, None
                    size = sum(x.column(6).nbytes for x in held)
        if held:
            yield hits(held)

    return run


def _hits(cut: DataFrame, length: int, crowd: int, name: str) -> DataFrame:
    rows = cut.where("n > 0").select("name", "k1", "k2", "lead", "windows", "n", "fragment")
    return stored(rows.repartition("name").sortWithinPartitions("name", "k1", "k2").mapInArrow(lean(_ordered(length, crowd)), _HITS), name)


def covered(texts: DataFrame, length: int = 400, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """(id, spans): the bytes [begin, stop) of each text that repeated strings of `length` bytes cover.

    texts: id (a distinct number), z (the text's bytes in zstd), n (at how many places it stands; 2 stands for more).
    Texts without such bytes have no row. Spans may overlap; they are not sorted. Where texts have a column within, of
    spans as well, strings outside of these are not looked at.
    """
    runs = stored(texts.select("id", "n", "z", *(c for c in texts.columns if c == "within")).mapInArrow(lean(_named(length, gram, _unpacked)), _NAMED), "runs")
    names = runs.groupBy("name").agg(F.sum("n").alias("all")).where("all > 1").select("name")
    names = stored(names, "names")  # with an exchange of its own on both sides, Spark can split a frequent name
    own = runs.join(names, "name", "left_semi").groupBy("id").agg(F.collect_list(F.struct("n", "name", "first", "windows", "place")).alias("runs"))
    cut = stored(texts.select("id", "z").join(own, "id").mapInArrow(lean(_cut(length, _unpacked)), _CUT), "fragments")
    found = _hits(cut, length, crowd, "hits")
    hits, crowded = found.where("n = 0").select("k1", "k2", "begin", "stop"), found.where("n > 0")
    if not crowded.isEmpty():
        hits = hits.union(_split(crowded, length))
    spans = cut.select("id", "first", "k1", "k2").join(hits, ["k1", "k2"])
    return spans.groupBy("id").agg(F.collect_list(F.struct((F.col("first") + F.col("begin")).alias("begin"), (F.col("first") + F.col("stop")).alias("stop"))).alias("spans"))


def _split(crowded: DataFrame, length: int) -> DataFrame:
    """Covered bytes of fragments of crowded names, which are cut again by grams of length - 1 bytes."""
    plain = lambda column: column.to_pylist()
    distinct = crowded.groupBy("k1", "k2").agg(F.least(F.sum("n"), F.lit(2)).alias("n"), F.first("fragment", True).alias("fragment"))
    distinct = stored(distinct.withColumn("id", F.monotonically_increasing_id()), "crowd")
    runs = distinct.select("id", "n", "fragment").mapInArrow(_named(length, length - 1, plain), _NAMED)
    own = runs.groupBy("id").agg(F.collect_list(F.struct("n", "name", "first", "windows", "place")).alias("runs"))
    finer = stored(distinct.select("id", "fragment").join(own, "id").mapInArrow(_cut(length, plain), _CUT), "finer")
    hits = finer.select("id", "first", "k1", "k2").join(_hits(finer, length, 1 << 40, "finer_hits").drop("n", "fragment"), ["k1", "k2"])
    hits = hits.select("id", (F.col("first") + F.col("begin")).alias("begin"), (F.col("first") + F.col("stop")).alias("stop"))
    return hits.join(distinct.select("id", "k1", "k2"), "id").select("k1", "k2", "begin", "stop")


def _kept_alone(made: Callable[[], DataFrame], spark: SparkSession, name: str) -> DataFrame:
    """stored() of a table, without the tables that were written to make it."""
    path = new_path(spark, name)
    with scratch(spark):
        df = made()
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def merged(begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes that spans cover."""
    order = np.argsort(begin, kind="stable")
    begin, stop = begin[order], np.maximum.accumulate(stop[order])
    first = np.flatnonzero(np.concatenate([[True], begin[1:] > stop[:-1]]))
    return begin[first], stop[np.append(first[1:], len(begin)) - 1] if len(begin) else stop


def _merged(spans: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """merged() of a list of (begin, stop), which may be null."""
    if not spans.is_valid or not len(spans.values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return merged(*(spans.values.field(k).to_numpy() for k in ("begin", "stop")))


def _without(text: bytes, begin: np.ndarray, stop: np.ndarray) -> bytes:
    edges = [0, *np.stack([begin, stop], 1).ravel().tolist(), len(text)]
    return b"".join([text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)])


def _long_enough(text: bytes, begin: np.ndarray, stop: np.ndarray, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs that hold so many words, those cut at a run's ends included."""
    ok = np.array([len(text[a:b].split()) >= least_words for a, b in zip(begin.tolist(), stop.tolist(), strict=True)], bool)
    return begin[ok], stop[ok]


def _removed(length: int, columns: int, keep_bytes: bool, least_words: int, as_text: bool = False, passages: tuple[int, int, int] | None = None):
    """Rows of (columns, sha, n_bytes, z, copied, spans) become (columns, n_bytes, n_removed, n_spans, kept_sha256, kept);
    with passages, whose spans are a further column, n_passages and rest come last."""

    def opened(kept: tuple[bytes, ...]) -> pa.Array:
        return pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary())

    def rest(z: pa.Scalar, n: int, double: bool | None, spans: pa.Scalar, near: pa.Scalar) -> tuple[int, bytes]:
        if double and n >= length:
            return int(n >= passages[0] and len(unzipped(z.as_py()).split()) >= passages[2]), b""
        text = unzipped(z.as_py())
        whole = double and n >= passages[0]
        begin, stop = _long_enough(text, *((np.zeros(1, np.int64), np.array([n])) if whole else _merged(near)), passages[2])
        gone = [np.concatenate(x) for x in zip((begin, stop), _merged(spans), strict=True)]
        return len(begin), _without(text, *merged(*gone)) if len(gone[0]) else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sha, sizes, z, copied, spans = (b.column(columns + i) for i in range(5))
            out: list[tuple] = []
            for i, (h, n, double) in enumerate(zip(sha.to_pylist(), sizes.to_pylist(), copied.to_pylist(), strict=True)):
                if double and n >= length and (not least_words or len(unzipped(z[i].as_py()).split()) >= least_words):
                    out.append((n, 1, hashlib.sha256().hexdigest(), b""))
                    continue
                plain = double or not spans[i].is_valid
                text = b"" if plain and not keep_bytes else unzipped(z[i].as_py())
                if plain:
                    out.append((0, 0, h.hex(), text))
                    continue
                begin, stop = _merged(spans[i])
                begin, stop = _long_enough(text, begin, stop, least_words) if least_words else (begin, stop)
                kept = _without(text, begin, stop)
                out.append((n - len(kept), len(begin), hashlib.sha256(kept).hexdigest(), kept))
            lost, runs, hashes, kept = zip(*out, strict=True) if out else ((), (), (), ())
            made = {"n_bytes": sizes, "n_removed": pa.array(lost, pa.int64()), "n_spans": pa.array(runs, pa.int64()), "kept_sha256": pa.array(hashes, pa.string())}
            made |= {"kept": opened(kept)} if keep_bytes else {}
            if passages:
                near = b.column(columns + 5)
                found = [rest(z[i], n, double, spans[i], near[i]) for i, (n, double) in enumerate(zip(sizes.to_pylist(), copied.to_pylist(), strict=True))]
                made |= {"n_passages": pa.array([x[0] for x in found], pa.int64()), "rest": opened(tuple(x[1] for x in found))}
            yield pa.RecordBatch.from_arrays([*b.columns[:columns], *made.values()], [*b.schema.names[:columns], *made])

    return run


def deduplicated(
    df: DataFrame, text: str = "text", length: int = 400, keep_bytes: bool = True, least_words: int = 0, gram: int = GRAM, as_text: bool = False, passages: tuple[int, int, int] | None = None
) -> DataFrame:
    """df without the text, with n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (binary); columns of
    df with these names are replaced. least_words: covered runs of fewer words stay. gram: bytes of the grams that name
    windows, less than length; results do not depend on it. as_text: kept is a string, without the rests of characters
    that were cut in two (a second pass over rows in Python would take a second worker for each task).

    passages: (bytes, gram, words), of bytes up to length. n_passages counts the runs of so many words and more that
    repeated strings of so many bytes cover, and rest is what remains without them and without what n_removed counts
    (as kept, a string with as_text). The other columns do not depend on it."""
    made = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", *(["n_passages", "rest"] if passages else [])]
    columns = [f for f in df.schema.fields if f.name not in made and f.name != text]
    names = [f"c{i}" for i in range(len(columns))]
    base = texts_by_id(df, text, columns, "texts")
    groups = stored(base.groupBy("sha").agg(F.min("id").alias("id"), F.least(F.count("*"), F.lit(2)).alias("n")), "copies")
    distinct = lambda least: base.where(F.col("n_bytes") >= least).select("id", "z").join(groups.select("id", "n"), "id")
    texts = distinct(length)
    if passages:
        near = _kept_alone(lambda: covered(distinct(passages[0]), *passages[:2]), df.sparkSession, "passages")
        texts = texts.join(near.withColumnRenamed("spans", "within"), "id")
    spans = covered(texts, length, gram)
    copied = base.select("id", "sha").join(groups.where("n > 1").select("sha"), "sha", "left_semi").select("id", F.lit(True).alias("copied"))
    rows = base.join(copied, "id", "left").join(spans, "id", "left")
    rows = rows.join(near.withColumnRenamed("spans", "near"), "id", "left") if passages else rows
    rows = rows.select(*names, "sha", "n_bytes", "z", "copied", "spans", *(["near"] if passages else []))
    kinds = [T.StructField(n, f.dataType) for n, f in zip(names, columns, strict=True)]
    bytes_or_text = T.StringType() if as_text else T.BinaryType()
    added = [T.StructField(n, T.LongType()) for n in made[:3]] + [T.StructField("kept_sha256", T.StringType())]
    added += [T.StructField("kept", bytes_or_text)] if keep_bytes else []
    added += [T.StructField("n_passages", T.LongType()), T.StructField("rest", bytes_or_text)] if passages else []
    out = rows.mapInArrow(lean(_removed(length, len(names), keep_bytes, least_words, as_text, passages)), T.StructType([*kinds, *added]))
    return out.select(*(F.col(n).alias(f.name) for f, n in zip(columns, names, strict=True)), *(f.name for f in added))
