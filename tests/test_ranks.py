"""Places and quantiles of groups against numpy, with steps that narrow."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from runwarden.operators import ranks


@pytest.fixture(scope="module")
def groups():
    rng = random.Random(2)
    return {
        "flat": [3.0] * 500, "ties": [float(rng.choice([0, 0, 0, 1, 7])) for _ in range(801)], "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-9, 9) for _ in range(900)],
        "one": [5.5], "two": [1.0, 2.0], "close": [1.0 + i * 2**-52 for i in range(600)], "out": [1e300, -1e300] + [float(i % 3) for i in range(700)],
    }


@pytest.mark.parametrize("few", [100_000, 8])
def test_quantiles(spark, groups, few, monkeypatch):
    monkeypatch.setattr(ranks.kth, "__defaults__", (few, 16))
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in [*vs, None]], "g string, x double").repartition(3)
    rows = rows.unionByName(spark.createDataFrame([(None, 1.0), (None, 4.0), ("void", None)], "g string, x double"))
    got = {(r.g, r.p): (r.n, r.value) for r in ranks.quantiles(rows, ["g"], "x", 0.0, 0.5, 0.99).collect()}
    for g, vs in groups.items():
        for p in (0.0, 0.5, 0.99):
            s = sorted(vs)
            k = (len(s) - 1) * p
            lo, hi = s[int(np.floor(k))], s[int(np.ceil(k))]
            assert got[g, p] == (len(s), pytest.approx(lo + (hi - lo) * (k - np.floor(k)), rel=1e-12)), (g, p)
    assert got[None, 0.5] == (2, 2.5) and ("void", 0.5) not in got


def test_nearest_ranks(spark, groups):
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, x double")
    got = {r.g: r for r in ranks.nearest_ranks(rows, ["g"], "x", p50=0.5, p99=0.99).collect()}
    for g, vs in groups.items():
        s = sorted(vs)
        assert (got[g].p50, got[g].p99) == (s[round(0.5 * (len(s) - 1))], s[round(0.99 * (len(s) - 1))])


def test_places_and_running_values(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("abc"), i, rng.randrange(9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(7)
    placed = ranks.ordered_places(df, [F.desc("v"), "i"]).collect()
    want = {r[1]: n + 1 for n, r in enumerate(sorted(rows, key=lambda r: (-r[2], r[1])))}
    assert {r.i: r.place for r in placed} == want
    got = {r.i: (r.total, r.most) for r in ranks.running(df, ["k"], ["i"], {"total": F.col("v")}, {"most": F.col("v")}).collect()}
    now = {}
    for k, i, v in rows:
        total, most = now.get(k, (0, v))
        now[k] = (total + v, max(most, v))
        assert got[i] == now[k]
    assert ranks.ordered_places(df.where("false"), ["i"]).collect() == [] and ranks.running(df.where("false"), ["k"], ["i"], {"t": F.lit(1)}).collect() == []
