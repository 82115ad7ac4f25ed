"""Connected components of an edge table by alternating large and small stars.

Every round is two aggregations and two joins on plain numbers, written to the
shared folder; no adjacency list, label map or component is ever held by one
task or by the driver, and a node with very many neighbours is pre-aggregated
(its minimum) and, in the join, split by adaptive execution.

Before the first round every task replaces its share of the edges, a bounded
number, by a spanning forest of them with the smallest node of each tree as its
root.  That keeps all reachability, and a dense group of many edges becomes a
few stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismrank.llm._shared import materialize


#: Edges that one task reduces to a forest.
TASK_EDGES = 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for u, v in zip(batch["u"].to_pylist(), batch["v"].to_pylist()):
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if find(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["u", "v"])


def _minimum(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_minimum(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _minimum(down)
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.union(low.select("u", F.col("low").alias("v"))).filter("u <> v")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``edges``: u, v (long).  Per node of an edge: node, root (the smallest
    node that can be reached)."""
    given = materialize(edges.select("u", "v").filter("u <> v"), "edges")
    tasks = -(-given.count() // TASK_EDGES)
    now = materialize(given.coalesce(max(1, tasks)).mapInArrow(_forest, "u long, v long").distinct(), "forest")
    seen = _mark(now)
    while True:
        now = materialize(_small_star(_large_star(now)).distinct(), "stars")
        mark = _mark(now)
        if mark == seen:
            break
        seen = mark
    # every edge is now (node, root); roots themselves are added
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
