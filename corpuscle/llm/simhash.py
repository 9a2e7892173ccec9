"""SimHash near-duplicates, found through nearby codewords of the binary Golay code.

A fingerprint of 64 bits is cut into three segments. Of two fingerprints that differ in at most four bits, either
two segments differ in at most one bit each, or one segment is equal and the others differ in two each. The code
of 23 bits is perfect: every word has one codeword within three bits, and one or six within four. So

- if segments differ in at most one bit, the codeword nearest to the one lies within four bits of the other, and
  a key of the nearest codewords of two segments meets a key among the nearby codewords of the same two;
- if a segment differs in two bits, the codeword nearest to the middle lies within four bits of both, and a key
  of an equal segment and a nearby codeword of the next one meets its like.

Rows of one key stand together after a sort, and each task compares rows of a key as they pass. It reports links
that join what was apart so far, never all pairs. Rows of a key with more than `BLOCK` rows are dealt again to
pairs of blocks, so no task holds more than two blocks of a key. Nothing is capped.

Rows: a null text counts as empty; an empty text has fingerprint zero, which is linked like any other. Repeated
rows and equal texts share a fingerprint and are linked as one. An empty table gives an empty table. Only the key
and text columns are read. Rows with a null key get a component like the others, but lend it no name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.components import components, forest
from corpuscle.llm.shared import stored

#: Bits of the segments, together 64.
SEGMENTS = (22, 21, 21)
#: Differing bits up to which fingerprints are linked.
DISTANCE = 4
#: Rows of one key that a task compares at once.
BLOCK = 8192
#: Shingles hashed at once.
STEP = 500_000


# --- fingerprints


def shingle_hashes(text: str | None, width: int, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles of a text in lower case (A-Z only), repeats included, some at a time."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - np.array([len(w) for w in words])
    data, digest = memoryview(b" ".join(words)), xxhash.xxh64_intdigest
    k = max(1, len(words) - width + 1)
    last = ends[min(width, len(words)) - 1 :]
    for at in range(0, k, STEP):
        n = min(STEP, k - at)
        spans = zip(starts[at : at + n].tolist(), last[at : at + n].tolist(), strict=True)
        yield np.fromiter((digest(data[a:b], seed) for a, b in spans), np.uint64, n)


def fingerprint(text: str | None, width: int, seed: int = 42) -> int:
    """Bits that more than half of the shingles' hashes have, as an unsigned number."""
    total, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, width, seed):
        total += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def fingerprints(df: DataFrame, width: int, key: str = "doc_id", text: str = "text", seed: int = 42) -> DataFrame:
    """(key, fingerprint): the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.array([fingerprint(t, width, seed) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made.view(np.int64))], [key, "fingerprint"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, fingerprint long")


# --- the code


class Golay:
    """The perfect binary code of 23 bits, 12 of them data: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1."""

    GENERATOR = 0b110001110101

    def __init__(self) -> None:
        bits = []
        for i in range(23):
            x = 1 << i
            for j in range(i, 10, -1):
                if x >> j & 1:
                    x ^= self.GENERATOR << (j - 11)
            bits.append(x)
        self._low, self._high = (self._table(bits[a:b]) for a, b in ((0, 12), (12, 23)))
        near: list[list[int]] = [[] for _ in range(2048)]
        for weight in range(5):
            for places in combinations(range(23), weight):
                s = 0
                for i in places:
                    s ^= bits[i]
                near[s].append(sum(1 << i for i in places))
        self._count = np.array([len(x) for x in near])
        self._errors = np.array([x + [x[0]] * (6 - len(x)) for x in near], np.int64)  # lightest first

    @staticmethod
    def _table(bits: list[int]) -> np.ndarray:
        out = np.zeros(1, np.int64)
        for x in bits:
            out = np.concatenate([out, out ^ x])
        return out

    def nearby(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the codewords within four bits, nearest first, in rows of six; and how many of them count."""
        s = self._low[words & 4095] ^ self._high[words >> 12]
        return (words[:, None] ^ self._errors[s]) >> 11, self._count[s]


GOLAY = Golay()


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, side) of signed fingerprints; links have a common key and sides 0 and 1, or both 2."""
    x, at = prints.view(np.uint64), 0
    segments = []
    for n in SEGMENTS:
        segments.append((x >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64))
        at += n
    near = [GOLAY.nearby(s) for s in segments]
    rows, made, sides = [], [], []
    every = np.arange(len(x))

    def add(row: np.ndarray, kind: int, key: np.ndarray, side: int) -> None:
        rows.append(row)
        made.append(kind << 48 | key)
        sides.append(np.full(len(row), side, np.int8))

    for kind, (i, j) in enumerate(combinations(range(3), 2)):
        (a, m), (b, n) = near[i], near[j]
        add(every, kind, a[:, 0] << 12 | b[:, 0], 0)
        for p in range(6):
            for q in range(6):
                ok = np.flatnonzero((p < m) & (q < n))
                add(ok, kind, a[ok, p] << 12 | b[ok, q], 1)
    for i in range(3):
        b, n = near[(i + 1) % 3]
        for q in range(6):
            ok = np.flatnonzero(q < n)
            add(ok, 3 + i, segments[i][ok] << 12 | b[ok, q], 2)
    return np.concatenate(rows), np.concatenate(made), np.concatenate(sides)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 5000):
            prints = b.column(0).slice(at, 5000).to_numpy(zero_copy_only=False)
            row, key, side = keys(np.ascontiguousarray(prints))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.zeros(len(key), np.int64)), pa.array(side), pa.array(prints[row])], ["key", "part", "side", "fingerprint"])


# --- links


def _joining(group: np.ndarray, side: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows of equal group (sorted) that join what was apart in their group."""
    label = np.arange(len(group))
    out_a, out_b = [], []
    rows, d = np.arange(len(group)), 0
    while True:
        d += 1
        rows = rows[rows + d < len(group)]
        rows = rows[group[rows] == group[rows + d]]
        if not len(rows):
            break
        other = rows + d
        ok = (side[rows] == 2) | (side[rows] != side[other])
        a, b = rows[ok], other[ok]
        diff = np.bitwise_count((prints[a] ^ prints[b]).view(np.uint64))
        ok = (diff <= DISTANCE) & (label[a] != label[b])
        for i, j in zip(a[ok].tolist(), b[ok].tolist(), strict=True):
            if label[i] != label[j]:
                first, last = np.searchsorted(group, group[i]), np.searchsorted(group, group[i], "right")
                own = label[first:last]
                own[own == label[j]] = label[i]
                out_a.append(prints[i])
                out_b.append(prints[j])
    return np.array(out_a, np.int64), np.array(out_b, np.int64)


_FOUND = "key long, part long, a long, b long, block int, side byte"


def _found(key: np.ndarray, part: np.ndarray, a: np.ndarray, b: np.ndarray, block: np.ndarray, side: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(part, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(block, pa.int32()), pa.array(side, pa.int8())], ["key", "part", "a", "b", "block", "side"])


def _linked(block: int):
    """Links of sorted (key, part, side, fingerprint) rows; rows of a part above the block size come back with a block number."""

    def links(held: list[np.ndarray]) -> pa.RecordBatch:
        key, part, side, prints = held
        group = np.cumsum(np.r_[0, (key[1:] != key[:-1]) | (part[1:] != part[:-1])]) if len(key) else key
        a, b = _joining(group, side, prints)
        pairs = [(x, y) for x, y in forest(zip(a.tolist(), b.tolist(), strict=True)).items() if x != y]
        z = np.zeros(len(pairs), np.int64)
        return _found(z, z, np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64), z - 1, z)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        over, seen = None, 0  # the group whose rows go to blocks, and how many of them were seen
        for b in batches:
            new = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            while held is not None and len(held[0]):
                key, part, side, prints = held
                if over is not None:
                    n = int(np.argmax(np.r_[(key != over[0]) | (part != over[1]), True]))
                    if n:
                        yield _found(key[:n], part[:n], prints[:n], prints[:n], (seen + np.arange(n)) // block, side[:n])
                    seen += n
                    held = [x[n:] for x in held]
                    if len(held[0]):
                        over = None
                    continue
                last = int(np.argmax((key == key[-1]) & (part == part[-1])))  # the last group may go on
                if last:
                    yield links([x[:last] for x in held])
                    held = [x[last:] for x in held]
                if len(held[0]) > block and block:
                    over, seen = (int(held[0][0]), int(held[1][0])), 0
                    continue
                break
        if held is not None and len(held[0]):
            yield links(held)

    return run


def links(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): links between the distinct values of a fingerprint column, enough to connect all that are linked."""
    keyed = prints.mapInArrow(_keyed, "key long, part long, side byte, fingerprint long")
    order = ["key", "part"]
    found = stored(keyed.repartition("key").sortWithinPartitions(*order).mapInArrow(_linked(block), _FOUND), "links")
    small, large = found.where("block < 0").select("a", "b"), found.where("block >= 0")
    blocks = large.groupBy("key").agg((F.max("block") + 1).alias("blocks"))
    # Row of block i goes to the pairs (i, j) and (j, i) of its key; within a pair all rows are compared.
    pairs = F.expr("explode(transform(sequence(0, blocks - 1), j -> cast(least(block, j) as bigint) * blocks + greatest(block, j)))")
    dealt = large.join(blocks, "key").select("key", pairs.alias("part"), "side", F.col("a").alias("fingerprint"))
    rest = dealt.repartition("key", "part").sortWithinPartitions(*order).mapInArrow(_linked(0), _FOUND)
    return small.union(rest.select("a", "b"))


def classes(df: DataFrame, width: int, key: str = "doc_id", text: str = "text", seed: int = 42, block: int = BLOCK) -> DataFrame:
    """(key, fingerprint, component_id): the smallest key among all rows that links reach, whatever their number."""
    own = stored(fingerprints(df, width, key, text, seed), "fingerprints")
    distinct = own.groupBy("fingerprint").agg(F.min(key).alias("_least"))
    near = components(links(distinct.select("fingerprint"), block), "a", "b")
    named = distinct.join(near.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("_c", F.coalesce("component", "fingerprint"))
    names = named.groupBy("_c").agg(F.min("_least").alias("component_id"))
    of_print = named.select("fingerprint", "_c").join(names, "_c").select("fingerprint", "component_id")
    return own.join(of_print, "fingerprint").select(key, "fingerprint", "component_id")
