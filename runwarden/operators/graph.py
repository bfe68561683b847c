"""Reachability and paths over edge tables, by frontier joins; each round's table is written out, so plans stay short."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, which driver and executors share; the session's own folder is set only where there is none, on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="runwarden-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reachable(roots: DataFrame, edges: DataFrame, max_rounds: int = 100_000) -> DataFrame:
    """(id): roots and all that edges (src, dst) lead to. A round joins the newest ids only and stops when there are none."""
    edges = written(edges.distinct(), "edges")
    seen = frontier = written(roots.select("id").distinct(), "frontier")
    for _ in range(max_rounds):
        frontier = written(edges.join(frontier, edges.src == frontier.id).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti"), "frontier")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
    raise RuntimeError("too deep")


def depths(edges: DataFrame, keys: list[str], max_rounds: int = 100_000) -> DataFrame:
    """keys + (node, depth): the least number of nodes on a path from a root; roots have out-edges and no in-edges, at depth 1.

    Nodes that no root reaches have a null depth.
    """
    edges = written(edges.where("src <> dst").distinct(), "edges")
    src, dst = edges.select(*keys, F.col("src").alias("node")).distinct(), edges.select(*keys, F.col("dst").alias("node")).distinct()
    level = written(src.join(dst, [*keys, "node"], "left_anti").withColumn("depth", F.lit(1)), "level")
    seen = level
    for i in range(2, max_rounds):
        level = written(edges.join(level.withColumnRenamed("node", "src"), [*keys, "src"]).select(*keys, F.col("dst").alias("node")).distinct().join(seen, [*keys, "node"], "left_anti").withColumn("depth", F.lit(i)), "level")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return src.union(dst).distinct().join(seen, [*keys, "node"], "left")


def shortest_paths(roots: DataFrame, edges: DataFrame, keys: list[str], most: int = 8) -> DataFrame:
    """keys + (node, path): of the shortest paths from a root, at most `most` edges, the least by its nodes."""
    edges = edges.where("src <> dst").distinct()
    level = written(roots.select(*keys, "node", F.array("node").alias("path")), "paths")
    seen = level
    for _ in range(most):
        step = edges.join(level.withColumnRenamed("node", "src"), [*keys, "src"]).select(*keys, F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"))
        step = step.join(seen.select(*keys, "node"), [*keys, "node"], "left_anti").groupBy(*keys, "node").agg(F.min("path").alias("path"))
        level = written(step, "paths")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen
