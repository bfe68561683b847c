"""Mixing sources to target weights, in DataFrame operations only: capped water-filling, then seeded repetitions.

The sizes of the sources are one aggregate; water-filling clamps sources at their maximum of epochs and gives the excess to the
others in proportion to their weights, until none is above its maximum. Every document is then repeated as often as its source's
whole epochs; for the fraction that is left, documents are taken once more in a seeded order until the source has its words:
a histogram of the order (seeded hashes, cut into 4,096 buckets by their first digits and summed per source) finds the bucket in which the quota ends, and only that bucket's
documents are ordered one by one. The document at the very end is taken in part, so each source gets its target to the word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import WORD, staged, table

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
SEED = 20240


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size) and the columns `keep`: size counts the words of the whole text, 0 for null."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), *keep)


def cyclic_weights(sources: DataFrame, weights=WEIGHTS) -> DataFrame:
    """(source, source_size, weight): sources by code point, null last, weigh weights[0], weights[1], ... repeating.

    `sources` is the aggregate with one row per source; strings compare by their UTF-8 bytes, which is code point order.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), F.pmod(rank, F.lit(len(weights))) + 1).alias("weight"))


def water_fill(weighted: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """weighted plus target: the sizes' total shared by weight, no source above max_epochs times its size.

    Each round clamps every source above its maximum and shares what is left among the others; only a round's two sums
    come to the driver. It ends when a round clamps nothing more.
    """
    cap = F.col("source_size") * F.lit(max_epochs)
    total = weighted.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level = None
    while True:
        clamped = F.lit(False) if level is None else F.col("weight") * F.lit(level) >= cap
        left, share = weighted.agg(F.lit(total) - F.coalesce(F.sum(F.when(clamped, cap)), F.lit(0)), F.sum(F.when(~clamped, F.col("weight")))).first()
        now = left / share if share else level or 0.0
        if now == level:
            break
        level = now
    amount = F.when(F.col("weight") * F.lit(level) >= cap, cap.cast("double")).otherwise(F.lit(level) * F.col("weight"))
    return weighted.withColumn("target", amount)


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, whole, part, taken) and the columns `keep` of docs, whose names must be none of these: the mix takes `whole` full repetitions of a document
    and `part` of its words once more; taken = whole * size + part.

    A null text has size 0 and is taken 0 times; a null source is a source of its own, ordered last; repeated rows are rows of
    their own; a source without words gets target 0; an empty table gives no rows. The same seed gives the same mix.
    """
    rows = staged(sized(docs, id_col, text_col, source_col, keep).withColumn("place", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)), "sizes")
    rows = rows.withColumn("bucket", F.conv(F.left("place", F.lit(3)), 16, 10).cast("int"))
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = water_fill(cyclic_weights(staged(sources, "sources"), weights), max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = plan.select("source", "source_size", "target", whole.alias("whole"), F.greatest(F.lit(0), F.round("target").cast("long") - whole * F.col("source_size")).alias("quota"))
    plan = staged(plan, "plan")

    hist = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
    hist = hist.join(plan.select(F.col("source").alias("plan_source"), "quota"), F.col("source").eqNullSafe(F.col("plan_source")))
    edge = staged(hist.where("before < quota and before + words >= quota").select("source", F.col("bucket").alias("edge_bucket"), "before"), "edges")

    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    plan = plan.join(edge.withColumnRenamed("source", "edge_source"), same("source", "edge_source"), "left").drop("edge_source")
    rows = rows.join(staged(plan, "edged-plan").withColumnRenamed("source", "plan_source"), same("source", "plan_source")).drop("plan_source")
    at_edge = rows.where(F.col("bucket") == F.col("edge_bucket"))
    order = Window.partitionBy("source").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at_edge = at_edge.withColumn("sofar", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    at_edge = at_edge.withColumn("part", F.greatest(F.lit(0), F.least("size", F.col("quota") - F.col("sofar")))).drop("sofar")
    others = rows.where(~F.coalesce(F.col("bucket") == F.col("edge_bucket"), F.lit(False)))
    others = others.withColumn("part", F.when(F.col("bucket") < F.col("edge_bucket"), F.col("size")).otherwise(F.lit(0)))
    out = at_edge.unionByName(others)
    return out.select("doc_id", "source", "size", "source_size", "target", "whole", "part", (F.col("whole") * F.col("size") + F.col("part")).alias("taken"), *keep)


#: Targets in closed form: by ascending maximum per weight, sources are clamped as long as their share of what is left exceeds their maximum.
OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, sha256('20240:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)]::DOUBLE AS weight, source_size * 3 AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s),
r AS (SELECT *, CAST(coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before, sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM w),
c AS (SELECT *, CAST(total - before AS DOUBLE) / share AS level, CAST(total - before AS DOUBLE) / share * weight >= cap AS over FROM r),
l AS (SELECT arg_min(level, cap / weight) FILTER (NOT over) AS level FROM c),
t AS (SELECT c.source, source_size, CASE WHEN l.level IS NULL OR l.level * weight >= cap THEN CAST(cap AS DOUBLE) ELSE l.level * weight END AS target FROM c, l),
q AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
p AS (SELECT *, greatest(0, CAST(round(target) AS BIGINT) - whole * source_size) AS quota FROM q),
o AS (SELECT d.*, p.source_size, p.target, p.whole, p.quota, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY place, doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sofar FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, quota - sofar)) AS BIGINT) AS taken FROM o
"""


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
