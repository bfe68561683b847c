"""What the text operators share: the shared folder, staged tables, table readers and empty results."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Words are runs of anything but space and the five control characters from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, which driver and executors share.

    The setting is read from the session. Where there is none, a temporary folder is set if the session is local; on a cluster that would be
    a folder which the executors do not share, so it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="runwarden-shared-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder: lineage ends there, and lost executors can read it again."""
    spark = session(df)
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one run in a folder of its own. One that nothing reads any more can be dropped before the run ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.count = spark, shared_dir(spark, name), 0

    def put(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{name}-{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Only tables whose readers have all been written themselves: lost executors then have nothing to read here again."""
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t.scratch_path)
            path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a batch that goes to Python. Spark's default of 10,000 would be gigabytes of very long texts.
BATCH_ROWS = "1000"


def small_batches(spark: SparkSession) -> None:
    """Sets the rows of a batch, unless the session has another than Spark's default."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, BATCH_ROWS)


def batches_by_bytes(spark: SparkSession, size: str = "8m") -> None:
    """Bounds the bytes of a batch that goes to Python, too, unless the session has another bound than Spark's default of 64 MB."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) in (None, "67108864b", "64MB"):
        spark.conf.set(name, size)


def give_back() -> None:
    """Returns this process's freed memory to the system; Arrow's pool and the C library otherwise keep it for later."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; what a batch's work has freed is given back before the next one and at the end. Workers live on from stage to stage and share an executor's memory."""
    for b in batches:
        yield b
        give_back()


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, null texts as empty: extra columns of the input cannot clash with an operator's own."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def ascii_lower(col):
    """Lower-cases A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def partitions_of(df: DataFrame) -> int:
    """How many partitions a shuffle of this session has."""
    return int(session(df).conf.get("spark.sql.shuffle.partitions"))
