"""Exact dedup as a stateful stream, in DataFrame operations only.

Arriving rows are landed in the shared folder as (digest, length, doc_id, locator): narrow, without their texts. A stream reads the landed
files and keeps, per digest, in RocksDB-backed state without expiry: the largest identifier, where its content is, and how many
rows have come. State is checkpointed in the shared folder, so a restarted query goes on where it stopped, and rows
that come later meet what is kept.

Hits (digests with more than one row) are then checked in full: the documents are read and digested again, rows of hits are kept, and of each digest the least and the
greatest normalised text are taken, in every task first, so that a group of copies is one row when it is shuffled. Where these two are the same bytes,
all are. A digest that different texts share (tests use a weak one) is regrouped by whole texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import ascii_lower, shared_dir, staged, table

_STORE = "spark.sql.streaming.stateStore"
#: State on disk; changes are uploaded as logs. All stores of an executor share one bound of native memory, do not allocate ahead, and are
#: closed soon after the stream has ended.
STORE = {
    f"{_STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STORE}.rocksdb.changelogCheckpointing.enabled": "true",
    f"{_STORE}.rocksdb.allowFAllocate": "false",
    f"{_STORE}.rocksdb.boundedMemoryUsage": "true",
    f"{_STORE}.rocksdb.maxMemoryUsageMB": "128",
    f"{_STORE}.rocksdb.writeBufferSizeMB": "4",
    f"{_STORE}.maintenanceInterval": "10s",
}
STATE = "digest string, keep_id long, locator string, group_size long"
LANDED = "doc_id long, digest string, locator string, text_sha256 string"
#: Hits whose 64-bit hashes are broadcast to find their rows without a shuffle of the texts; beyond it the rows are joined by shuffling them once.
BROADCAST_HITS = 1_000_000


def sha256_digest(text: Column) -> Column:
    return F.sha2(text, 256)


def land(docs: DataFrame, path: str, digest: Callable[[Column], Column] = sha256_digest) -> None:
    """Append docs (doc_id, norm, locator) to the landing folder, without texts; a SHA-256 is landed beside another digest only."""
    sha = F.lit(None).cast("string") if digest is sha256_digest else F.sha2("norm", 256)
    docs.select("doc_id", digest(F.col("norm")).alias("digest"), "locator", sha.alias("text_sha256")).write.mode("append").parquet(path)


def state_of(spark: SparkSession, landed: str, checkpoint: str, out: str) -> DataFrame:
    """Run the stream over what has landed and not been seen; return the newest state of each digest.

    The stream writes each trigger's changed keys to `out`; a key's newest row is that with the most rows counted.
    """
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        rows = spark.readStream.schema(LANDED).parquet(landed)
        kept = F.max(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("order"), "doc_id", "locator")).alias("keep")
        changed = rows.groupBy("digest").agg(kept, F.count("*").alias("group_size"))
        changed = changed.select("digest", F.col("keep.doc_id").alias("keep_id"), "keep.locator", "group_size")

        def write(batch: DataFrame, epoch: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

        query = changed.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    try:
        states = spark.read.schema(STATE + ", epoch int").parquet(out)
    except Exception as e:  # nothing has ever come: there is no folder
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], STATE)
    newest = F.max_by(F.struct("keep_id", "locator", "group_size"), "group_size")
    return states.groupBy("digest").agg(newest.alias("s")).select("digest", "s.*")


def shared_digests(keyed: DataFrame, hits: DataFrame, name: str = "collisions") -> DataFrame:
    """(digest) of hits whose rows in keyed (digest, norm) are not all the same bytes."""
    if hits.count() <= BROADCAST_HITS:
        # Rows of other digests with the same 64 bits come too, and are found to be alone.
        near = F.broadcast(hits.select(F.xxhash64("digest").alias("hit")).distinct())
        rows = keyed.join(near, F.xxhash64("digest") == F.col("hit"), "left_semi")
    else:
        rows = staged(keyed.join(hits, "digest", "left_semi"), "hit-rows")
    return staged(rows.groupBy("digest").agg(F.min("norm").alias("least"), F.max("norm").alias("greatest")).where("least <> greatest").select("digest"), name)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256_digest) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of docs, dropped ones too.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the largest id stays.
    Rows that repeat an id are rows of their own: those with an equal text count in group_size, and each of them has kept true. A null id sorts
    lowest. An empty table gives no rows. Other columns of docs are not looked at; long texts are whole, one at a time.
    """
    spark = docs.sparkSession
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), norm.alias("norm"), F.input_file_name().alias("locator"))
    home = shared_dir(spark, "exact")
    land(rows, f"{home}/landed", digest)
    state = staged(state_of(spark, f"{home}/landed", f"{home}/checkpoint", f"{home}/state"), "exact-state")
    landed = spark.read.schema(LANDED).parquet(f"{home}/landed")

    keyed = rows.select("doc_id", digest(F.col("norm")).alias("digest"), "norm")
    shared = shared_digests(keyed.select("digest", "norm"), state.where("group_size > 1").select("digest"))
    out = landed.join(state.select("digest", "keep_id", "group_size"), "digest").select("doc_id", "keep_id", "group_size", "digest", "text_sha256")
    if not shared.isEmpty():
        odd = staged(keyed.join(shared, "digest"), "collision-rows")
        keep = F.max(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("order"), "doc_id")).alias("keep")
        own = staged(odd.groupBy("norm").agg(keep, F.count("*").alias("group_size")), "collision-groups")
        regrouped = odd.join(own, "norm").select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", "digest", F.sha2("norm", 256).alias("text_sha256"))
        out = out.join(shared, "digest", "left_anti").unionByName(regrouped)
    sha = F.coalesce("text_sha256", "digest").alias("text_sha256")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), sha)


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP9_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n.norm) AS text_sha256 FROM n JOIN g ON n.norm = g.norm
"""
