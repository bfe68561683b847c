"""Connected components of an edge table, without collecting it: large-star and small-star rounds over a forest.

Each round ends in a table in the shared folder. Before the rounds every task replaces the edges of its partition by
a spanning forest of them, so that dense groups reach the shuffles with fewer edges than vertices. A star's centre may be a
hot key: its smallest neighbour is found by a pre-aggregated minimum, and it is joined back by a join that adaptive
execution may split.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import staged


class UnionFind:
    """Union by smallest id with path halving, over any ids."""

    def __init__(self):
        self.parent = {}

    def find(self, x):
        parent = self.parent
        if x not in parent:
            parent[x] = x
            return x
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def union(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def stars(self):
        """(vertex, root) for every vertex but the roots."""
        return [(x, r) for x in list(self.parent) if (r := self.find(x)) != x]


def _forest(batches):
    found = UnionFind()
    for b in batches:
        for s, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            found.union(s, d)
    if rows := found.stars():
        src, dst = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    low = staged(both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low")), "lowest")
    return both.join(low, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    low = staged(down.groupBy("src").agg(F.min("dst").alias("low")), "lowest")
    joined = down.join(low, "src")
    return joined.select(F.col("dst").alias("src"), F.col("low").alias("dst")).unionByName(low.select("src", F.col("low").alias("dst"))).where("src <> dst").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component_id) for each vertex of edges (src, dst: longs); component_id is the smallest reachable id.

    Loops and repeated edges are harmless; vertices without edges do not appear. An empty table gives an empty result.
    """
    e = edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).where("src <> dst")
    e = staged(e.mapInArrow(_forest, "src long, dst long"), "edges")

    def mark(df):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())

    before = mark(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        e = staged(_small_star(_large_star(e).distinct()), "edges")
        now = mark(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("dst").alias("id"), F.col("dst").alias("component_id")).distinct()
    return e.select(F.col("src").alias("id"), F.col("dst").alias("component_id")).unionByName(roots)

