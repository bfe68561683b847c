"""Advisories against packages: every pair once, by plain comparison, in units of a few pairs."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from runwarden.operators import advisories
from runwarden.plans import registry


@pytest.mark.parametrize("block", [2000, 3])
def test_matches(spark, block):
    rng = random.Random(1)
    names, spaces, versions = ["a", "a", "a", "b", None], ["x", "y", "any", "", None, None], ["1", "2", "any", "", None]
    a = [(i, rng.choice(names), rng.choice(spaces), rng.choice([None, [], [None], ["1", "1"], ["1", None, "2"], ["any", ""]])) for i in range(80)]
    p = [(i, rng.choice(names), rng.choice(spaces), rng.choice(versions)) for i in range(120)]
    own = spark.createDataFrame(a, "adv long, name string, namespace string, versions array<string>")
    got = advisories.matches(own, spark.createDataFrame(p, "package long, name string, namespace string, version string"), block).collect()
    fits = lambda x, y: x[1] is not None and x[1] == y[1] and (None in (x[2], y[2]) or x[2] == y[2]) and (x[3] is None or y[3] is not None and y[3] in x[3])
    assert sorted(map(tuple, got)) == [(x[0], y[0]) for x in a for y in p if fits(x, y)]
    assert len(got) > 500 and advisories.matches(own.limit(0), own.selectExpr("adv AS package", "name", "namespace", "name AS version")).count() == 0


def test_advisories_of_one_name(spark, tmp_path):
    """One name has most rows, in files of one part: several tasks make its pairs. A package without a version meets advisories of all versions."""
    d = str(tmp_path)
    spark.range(300).repartition(1).selectExpr("id * 30 AS s_suppkey").write.parquet(f"{d}/supplier.parquet")
    spark.range(400).repartition(1).selectExpr("id * 60 AS p_partkey", "CASE WHEN id % 5 <> 2 THEN CAST(id % 50 AS INT) END AS p_size").write.parquet(f"{d}/part.parquet")
    got = registry.QUERIES["join_advisory_package"](spark, d).select("adv", "p_partkey", F.spark_partition_id().alias("task")).collect()
    con = duckdb.connect()
    for t in ("supplier", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet/*.parquet')")
    assert sorted((r.adv, r.p_partkey) for r in got) == sorted(con.execute(registry.ORACLE["join_advisory_package"]).fetchall())
    assert len({r.task for r in got}) > 1
