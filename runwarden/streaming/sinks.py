"""Sinks: exactly-once appends, tables appended once per key, partitions replaced in whole, one ordered hash chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.ranks import ordered_places
from ..operators.sequence import chained


def append(rows: DataFrame, out: str, checkpoint: str) -> None:
    """Runs a stream over all there is and appends it to a table; the checkpoint makes a second run add only what is new."""
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def latest(rows: DataFrame, out: str, checkpoint: str) -> None:
    """Each batch's changed rows of a stateful aggregate, a folder per batch: a batch that is run again replaces its own."""
    write = lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
    rows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def joined_batches(rows: DataFrame, dimension: str, keys: list[str], out: str, checkpoint: str) -> None:
    """Joins every batch with the dimension as it is when the batch runs."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.join(batch.sparkSession.read.parquet(dimension), keys).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def existing(spark, path: str, schema) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def append_new(rows: DataFrame, out: str, keys: list[str]) -> None:
    """Appends rows whose key the table has not."""
    seen = existing(rows.sparkSession, out, rows.schema).select(*keys)
    rows.dropDuplicates(keys).join(seen, keys, "left_anti").write.mode("append").parquet(out)


def replace_partitions(rows: DataFrame, out: str, key: str) -> None:
    """Overwrites the partitions that rows have, and no other."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(out)


def numbered(rows: DataFrame, last: int, *order: str) -> DataFrame:
    """rows with consecutive numbers after `last`, in order, nulls last. Places come from a written table: ids of partitions that adaptive execution
    coalesces are not the same in two passes."""
    return ordered_places(rows, [F.col(c).asc_nulls_last() for c in order]).withColumn("number", F.col("place") + last).drop("place")


CHAIN = "batch long, k long, prev string, hash string, canon string"


def append_chain(batch: DataFrame, out: str, batch_id: int) -> None:
    """Appends a batch (order, canon) to one chain: h = sha256(previous h, sha256(canon)). Texts are hashed in parallel and joined back by order; only
    the batch's digests stream through one task, as a chain must. A batch id that is there already adds nothing; orders are unique."""
    spark = batch.sparkSession
    log = existing(spark, out, CHAIN)
    if not log.where(F.col("batch") == batch_id).isEmpty():
        return
    head = log.agg(F.max_by(F.struct("k", "hash"), "k").alias("h")).select(F.coalesce("h.k", F.lit(0)), F.coalesce("h.hash", F.repeat(F.lit("0"), 64))).first()
    links = chained(batch.select(F.lit(0).cast("long").alias("log"), F.col("order").cast("long").alias("place"), F.sha2("canon", 256).alias("c")), head[0], head[1])
    rows = batch.withColumn("place", F.col("order").cast("long")).join(links, "place")
    rows.select(F.lit(batch_id).cast("long").alias("batch"), "k", "prev", "hash", "canon").write.mode("append").parquet(out)
