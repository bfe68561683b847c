"""Stages of a corpus pipeline: each takes documents and gives the documents that it keeps, with all their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .bpe import tokenized
from .common import ascii_lower, small_batches, staged, table
from .exact import exact_groups
from .mixing import mix
from .quality import THRESHOLD, fit, scored, training_rows
from .simhash import near_groups


#: Every stage: null texts count as empty; null ids are ids like any other; extra columns stay as they are; an empty table gives an empty table; texts are whole.
#: Rows that repeat an id with different texts are documents of their own in all stages. Rows that repeat an id and a text are one document, which the two dedup stages keep once.


def _own(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    while name in docs.columns:
        name += "_"
    return name


def _key(*columns):
    """One text for several columns, nulls included, so that joins on it have one key."""
    return F.concat_ws(":", *(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("null")) for c in columns))


def _sha(text: str = "text"):
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _with(docs: DataFrame, key, small: DataFrame) -> DataFrame:
    """docs joined with small (own_key, one column more), which has one narrow row a key: the texts are shuffled once and not sorted. Columns of small get names that docs does not have."""
    small = small.select(*(F.col(c).alias(_own(docs, c)) for c in small.columns))
    return docs.join(small.hint("shuffle_hash"), key == F.col(small.columns[0]))


def _one_of_each(docs: DataFrame, key, kept: DataFrame) -> DataFrame:
    """The row with the least text of each key in kept (own_key, one row for each row of docs that stays)."""
    kept = staged(kept.groupBy("own_key").agg(F.count("*").alias("own_rows")), "kept-rows")
    rows, n = _with(docs, key, kept), F.col(_own(docs, "own_rows"))
    if kept.where("own_rows > 1").isEmpty():
        return rows.select(*docs.columns)
    # Only rows that share a key are ranked.
    nth = _own(docs, "nth")
    place = F.row_number().over(Window.partitionBy(_own(docs, "own_key")).orderBy(F.col("text").asc_nulls_first()))
    first = rows.where(n > 1).withColumn(nth, place).where(F.col(nth) == 1)
    return rows.where(n == 1).select(*docs.columns).unionByName(first.select(*docs.columns))


def keep_quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts 1 for; it is fitted on the labelled rows of these documents. Without labels of both kinds there is
    nothing to reject by, and every document stays."""
    items, y = training_rows(docs, table(spark, sf_dir, "labels"))
    if len(set(y.tolist())) < 2:
        return docs
    return scored(docs, fit(items, y)).where(F.col("score") >= THRESHOLD).select(*docs.columns)


def drop_exact(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, that with the largest id."""
    kept = exact_groups(docs).where("kept").select(_key("doc_id", "text_sha256").alias("own_key"))
    return _one_of_each(docs, _key("doc_id", F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256)), kept)


def drop_near(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by links of fingerprints, that with the smallest id (null first), and of rows of that id that with the least digest."""
    small_batches(spark)
    rows = docs.select(F.struct(F.col("doc_id").cast("long").alias("id"), _sha().alias("sha")).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    kept = near_groups(rows).where("doc_id <=> component_id").select(_key("doc_id.id", "doc_id.sha").alias("own_key"))
    return _one_of_each(docs, _key("doc_id", _sha()), kept)


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix repeats it; a repetition in part counts from half the document on.

    Rows with one id, text and source are taken equally often: as often as that of them which the mix takes most."""
    times = (F.col("whole") + F.when((F.col("part") > 0) & (F.col("part") * 2 >= F.col("size")), 1).otherwise(0)).cast("int")
    key = _key("doc_id", _sha(), "source")
    plan = mix(docs.withColumn("own_key", key), keep=("own_key",)).select("own_key", times.alias("own_times")).where("own_times > 0")
    plan = staged(plan.groupBy("own_key").agg(F.max("own_times").alias("own_times")), "repetitions")
    nth = _own(docs, "nth")
    return _with(docs, key, plan).select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(_own(docs, "own_times")))).alias(nth)).drop(nth)


def to_tokens(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of every document."""
    import public_tokenizers

    return tokenized(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
