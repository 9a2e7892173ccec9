"""Exact top-k by inner product, through best-first search in M-trees.

Inner products become distances by one more coordinate: with every vector x lengthened to the norm M by sqrt(M^2 -
|x|^2), the squared distance to (q, 0) is |q|^2 + M^2 - 2 qx. That is a metric, so an M-tree applies. Its pages hold
entries of routing vectors with covering radii, and leaves hold vectors; each entry stores its distance to the parent.
A search takes pages in the order of the highest score they can hold. Within a page, entries whose stored parent
distance and the query's distance to the parent already exclude them are left out before any distance is computed;
scores of the others are exact whole numbers. A page is left out only if it cannot even tie with the worst of the k.

Vectors are dealt to blocks of bounded size; each block has a tree, and queries stream past it. Equal vectors of a
block stand as one with their k + 1 smallest ids, as no more of them can be among the k best of a query.

Components beyond `LARGEST` would make sums of products inexact: a tree that holds some, or a query that does, goes
through all vectors of the block in whole numbers of any size. A score beyond 64 bits stands as the last one within.

Rows: vectors that are null, or hold null or non-finite components, take no part; nor do rows with a null id. Vectors
of another length than the query's are no candidates for it; empty vectors are candidates of each other. Rows that repeat an id and its vector count once; none with a query's
own id is a candidate for it. Empty tables, or no queries, give an empty table. Other columns are not read.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.llm.shared import stored

#: Components of a block's vectors, entries of a page, and queries that share a stream past a tree.
BLOCK, PAGE, CHUNK = 1 << 22, 512, 1_000
#: Largest component for which sums of products are exact in floats of 64 bits and 4096 dimensions.
LARGEST = 1 << 20


@dataclass
class Page:
    """leaf: rows lo..hi of the tree's vectors; else pages lo..hi. For each entry its distance to this page's centre."""

    leaf: bool
    lo: int
    hi: int
    centre: np.ndarray
    radius: float
    to_parent: np.ndarray
    centres: np.ndarray | None = None
    radii: np.ndarray | None = None


class Tree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        """vectors: whole numbers, a row for each id."""
        order = np.lexsort((ids, *vectors.T)) if len(ids) else np.zeros(0, np.int64)
        ids, vectors = ids[order], vectors[order]
        first = np.flatnonzero(np.concatenate([[True], (vectors[1:] != vectors[:-1]).any(1)])) if len(ids) else order
        bounds = np.append(first, len(ids))
        self.large = bool(len(vectors)) and float(np.abs(vectors).max(initial=0)) > LARGEST
        self.ids = [ids[a : min(b, a + k + 1)] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        vectors = vectors[first].astype(np.float64)
        if self.large:
            self.root, self.vectors = None, vectors
            return
        square = (vectors * vectors).sum(1)
        self.norm2 = float(square.max(initial=0))
        points = np.concatenate([vectors, np.sqrt(np.maximum(0, self.norm2 - square))[:, None]], axis=1)
        self.pages: list[Page] = []
        self._order: list[np.ndarray] = []
        self._placed = 0
        self.root = self._build(points, np.arange(len(points))) if len(points) else None
        order = np.concatenate(self._order) if self._order else np.zeros(0, np.int64)
        self.vectors, self.points = np.ascontiguousarray(vectors[order]), points[order]
        self.ids = [self.ids[i] for i in order]
        self.flat_ids = np.concatenate(self.ids) if self.ids else np.zeros(0, np.int64)
        self.id_at = np.concatenate([[0], np.cumsum([len(x) for x in self.ids])]).astype(np.int64)
        del self._order, self.points

    def _build(self, points: np.ndarray, rows: np.ndarray) -> int:
        """The number of the page that holds these rows."""
        own = points[rows]
        centre = own.mean(0)
        far = np.sqrt(((own - centre) ** 2).sum(1))
        if len(rows) <= PAGE:
            by = np.argsort(far, kind="stable")
            self._order.append(rows[by])
            self.pages.append(Page(True, self._placed, self._placed + len(rows), centre, float(far.max(initial=0)), far[by]))
            self._placed += len(rows)
            return len(self.pages) - 1
        below = [self._build(points, rows[part]) for part in self._split(own)]
        # Siblings need not stand together in the list, so an inner page keeps their numbers.
        centres = np.array([self.pages[i].centre for i in below])
        radii = np.array([self.pages[i].radius for i in below])
        page = Page(False, 0, len(below), centre, float(far.max()), np.sqrt(((centres - centre) ** 2).sum(1)), centres, radii)
        page.below = below
        self.pages.append(page)
        return len(self.pages) - 1

    def __getstate__(self) -> dict:
        return self.__dict__ | {"vectors": self.vectors if self.large else self.vectors.astype(np.int32)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state | {"vectors": state["vectors"].astype(np.float64)}

    @staticmethod
    def _split(own: np.ndarray) -> list[np.ndarray]:
        """Rows by their nearest routing vector; routing vectors are refined a few times from spread rows."""
        n = min(16, -(-len(own) // PAGE))
        routes = own[np.linspace(0, len(own) - 1, n).astype(np.int64)]
        for _ in range(4):
            near = np.argmin((routes * routes).sum(1) - 2 * own @ routes.T, axis=1)
            routes = np.array([own[near == i].mean(0) if (near == i).any() else routes[i] for i in range(n)])
        near = np.argmin((routes * routes).sum(1) - 2 * own @ routes.T, axis=1)
        parts = [p for p in (np.flatnonzero(near == i) for i in range(n)) if len(p)]
        return parts if len(parts) > 1 else np.array_split(np.arange(len(own)), n)

    def search(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """The k best (score, id) of a query, highest first, ties to the smaller id; its own id is no candidate."""
        if self.large or float(np.abs(query).max(initial=0)) > LARGEST:
            return self._all(query, own, k)
        if self.root is None:
            return []
        point = np.append(query, 0.0)
        whole = float(query @ query) + self.norm2
        slack = 1e-6 * (1 + np.sqrt(whole))

        def best(distance: np.ndarray, radius: np.ndarray) -> np.ndarray:
            """The highest score within a radius of points at a distance."""
            nearest = np.maximum(0, distance - radius - slack)
            return (whole - nearest * nearest) / 2

        to_root = np.sqrt(((self.pages[self.root].centre - point) ** 2).sum())
        queue = [(-float(best(to_root, self.pages[self.root].radius)), self.root, float(to_root))]
        kept: list[tuple[int, int]] = []  # a heap of (score, -id): the worst first
        while queue:
            bound, number, to_centre = heapq.heappop(queue)
            worst = kept[0][0] if len(kept) == k else -np.inf
            if -bound < worst:
                break
            page = self.pages[number]
            if page.leaf:
                ok = best(np.abs(to_centre - page.to_parent), 0) >= worst
                rows = np.arange(page.lo, page.hi)[ok]
                scores = self.vectors[rows] @ query
                some = np.flatnonzero(scores >= worst)
                if len(some) > k:  # of the page's own, those that cannot tie with its k best go
                    some = some[scores[some] >= np.partition(scores[some], len(some) - k - 1)[len(some) - k - 1]]
                for i in some.tolist():
                    value = int(scores[i])
                    for x in self.flat_ids[self.id_at[rows[i]] : self.id_at[rows[i] + 1]].tolist():
                        if x == own:
                            continue
                        if len(kept) < k:
                            heapq.heappush(kept, (value, -x))
                        elif (value, -x) > kept[0]:
                            heapq.heapreplace(kept, (value, -x))
                        else:
                            break
            else:
                ok = np.flatnonzero(best(np.abs(to_centre - page.to_parent), page.radii) >= worst)
                distance = np.sqrt(((page.centres[ok] - point) ** 2).sum(1))
                bounds = best(distance, page.radii[ok])
                for i, d, x in zip(ok.tolist(), distance.tolist(), bounds.tolist(), strict=True):
                    if x >= worst:
                        heapq.heappush(queue, (-x, page.below[i], d))
        return sorted(((s, -x) for s, x in kept), key=lambda p: (-p[0], p[1]))


    def _all(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """The same by all vectors, in whole numbers of any size."""
        exact = [int(x) for x in query.tolist()]
        within = lambda s: max(-(1 << 63), min(s, (1 << 63) - 1))
        scored = ((-within(sum(int(x) * y for x, y in zip(v, exact, strict=True))), i) for v, ids in zip(self.vectors.tolist(), self.ids, strict=True) for i in ids.tolist() if i != own)
        return [(-s, i) for s, i in heapq.nsmallest(k, scored)]


def quantised(df: DataFrame, scale: int, key: str, vector: str) -> DataFrame:
    """(id, v): floor(scale * component) of the rows that take part, as doubles that are whole numbers."""
    v = F.col(vector)
    rows = df.select(F.col(key).cast("long").alias("id"), F.transform(v, lambda x: x.cast("double")).alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine).select("id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(column[0]))


def top_k(df: DataFrame, queries: DataFrame, k: int, scale: int = 64, key: str = "vec_id", vector: str = "embedding", block: int | None = None) -> DataFrame:
    """(query_id, rank, <key>, score) of the rows of df for each row of queries; both have the key and the vector.

    block: vectors of a tree; by default as many as have BLOCK components together, 1024 at least.
    """
    base = stored(quantised(df, scale, key, vector).distinct(), "vectors")
    asked = stored(quantised(queries, scale, key, vector).distinct(), "queries")
    if block is None:
        one = base.select(F.size("v").alias("n")).first()
        block = max(1024, BLOCK // max(1, one["n"] if one else 1))
    blocks = max(1, -(-base.count() // block))
    chunks = max(1, -(-asked.count() // CHUNK))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by length and block; a block is a task's own or one of several."""
        held, at = [], None

        def made() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            tree = Tree(t["id"].to_numpy(), _matrix(t["v"].chunk(0)), k)
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int64()), pa.array([pickle.dumps(tree)], pa.binary())], ["size", "block", "tree"])

        for b in batches:
            sizes, numbers = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((numbers[1:] != numbers[:-1]) | (sizes[1:] != sizes[:-1])) + 1).tolist(), len(numbers)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi == lo:
                    continue
                if held and (sizes[lo], numbers[lo]) != at:
                    yield made()
                at = int(sizes[lo]), int(numbers[lo])
                held.append(b.slice(lo, hi - lo))
        if held:
            yield made()

    dealt = base.select(F.size("v").alias("size"), F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).alias("block"), "id", "v")
    trees = dealt.repartition(blocks, "size", "block").sortWithinPartitions("size", "block").mapInArrow(build, "size int, block long, tree binary")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1)))
    left = trees.select("size", "block", "tree", every.alias("chunk")).select("size", "block", "chunk", F.lit(0).alias("kind"), "tree", F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<double>").alias("v"))
    right = asked.select(F.size("v").alias("size"), "id", "v", F.pmod(F.xxhash64("id"), F.lit(chunks)).alias("chunk"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1))).alias("block"))
    right = right.select("size", "block", "chunk", F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("tree"), "id", "v")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, at = None, None
        for b in batches:
            keys = list(zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
            kinds, ids = b.column(3).to_pylist(), b.column(5).to_pylist()
            out: list[tuple[int, int, int]] = []
            vectors = b.column(6)
            for i, kind in enumerate(kinds):
                if kind == 0:
                    tree, at = pickle.loads(b.column(4)[i].as_py()), keys[i]
                elif at == keys[i]:  # else there is no candidate of its length
                    query = vectors[i].values.to_numpy(zero_copy_only=False)
                    out += [(ids[i], x, s) for s, x in tree.search(query, ids[i], k)]
            columns = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["query_id", "id", "score"])

    found = left.unionByName(right).repartition(blocks * chunks, "size", "block", "chunk").sortWithinPartitions("size", "block", "chunk", "kind")
    found = found.mapInArrow(search, "query_id long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")
