"""Every query with SQL against DuckDB over the smallest tables."""

import os

import duckdb
import pytest

from runwarden.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}") if v == v else None
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_against_duckdb(spark, con, name):
    df = registry.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = [tuple(plain(v) for v in r) for r in df.select(*cols).collect()]
    q = con.execute(registry.ORACLE[name])
    names = [c[0] for c in q.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    want = [tuple(plain(r[i]) for i in order) for r in q.fetchall()]
    assert sorted(names) == cols
    assert sorted(got, key=str) == sorted(want, key=str)
