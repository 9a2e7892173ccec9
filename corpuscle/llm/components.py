"""Connected components of a link table, without gathering links on the driver or a component in one task.

Rounds of two star steps hang each node under ever smaller neighbours until only stars are left; their number
grows with the logarithm of the longest path. Before the rounds each task contracts the links it holds, block by
block. Every round is cut off by a checkpoint in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.shared import shared_folder

#: Links that a task contracts at once.
BLOCK = 200_000


def forest(links: Iterator[tuple[int, int]]) -> dict[int, int]:
    """The smallest node that each node of these links reaches through them."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        root = x
        while (above := up.setdefault(root, root)) != root:
            root = above
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    for a, b in links:
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: top(x) for x in up}


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def out() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        held.clear()
        pairs = [(x, y) for x, y in forest(zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True)).items() if x != y]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["child", "parent"])

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= BLOCK:
            yield out()
    if held:
        yield out()


def _under(edges: DataFrame) -> DataFrame:
    """Large star then small star; edges: (child, parent) with child > parent."""
    both = edges.select(F.col("child").alias("u"), F.col("parent").alias("v")).union(edges.select(F.col("parent").alias("u"), F.col("child").alias("v")))
    # Cut off, so that the join deals both sides anew and Spark can split a hub's rows.
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")).checkpoint()
    large = both.where("v > u").join(least, "u").where("v > m").select(F.col("v").alias("child"), F.col("m").alias("parent")).distinct()
    low = large.groupBy("child").agg(F.min("parent").alias("m"))
    small = large.join(low, "child")
    return (
        small.where("parent > m").select(F.col("parent").alias("child"), F.col("m").alias("parent")).union(low.select("child", F.col("m").alias("parent"))).distinct()
    )


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node of the links (long columns): the smallest node it reaches.

    Links with a null end and links of a node to itself join nothing; repeated links do no harm.
    """
    shared_folder(links.sparkSession)
    low, high = F.least(a, b).alias("parent"), F.greatest(a, b).alias("child")
    edges = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(high, low)
    edges = edges.mapInArrow(_contracted, "child long, parent long").checkpoint()
    while True:
        edges = _under(edges).checkpoint()
        # Stars: no child is a parent or has two of them.
        ends = edges.select(F.col("child").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("parent", F.lit(0), F.lit(1)))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if ends.where("up > 1 or up = 1 and down = 1").isEmpty():
            roots = edges.select(F.col("parent").alias("node")).distinct()
            return edges.select(F.col("child").alias("node"), F.col("parent").alias("component")).union(roots.select("node", F.col("node").alias("component")))
