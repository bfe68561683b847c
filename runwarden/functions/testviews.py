"""Views that turn the driver's tables into security inputs; the same definitions as SQL for DuckDB.

Each view is a deterministic projection of a whole driver table, so its size follows the table: images have 60 files and are as many as parts
allow, five containers run an image, every customer is a container (but every tenth number, which stays unbound), every order a scenario run,
and namespaces follow suppliers and groups of fifteen customers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


#: Microseconds since the epoch of a timestamp without time zone, whatever the session's zone.
MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {})"


def micros(name: str):
    return F.expr(MICROS.format(name))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def v_event(spark, d) -> DataFrame:
    """Normalised events, one per row of events; seq is the arrival order."""
    e = load(spark, d, "events").selectExpr("event_id AS seq", "ts", "user_id", "event_type", "value", "CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k")
    return e.selectExpr(
        "seq", "ts", f"{MICROS.format('ts')} * 1000 AS t_ns", "concat('c', user_id) AS cid", "concat('i', user_id div 5) AS digest",
        "user_id AS pid", "user_id % 7 AS ppid",
        "CASE event_type WHEN 'purchase' THEN 'exec' WHEN 'click' THEN 'write' WHEN 'view' THEN 'load' WHEN 'error' THEN 'cap' ELSE 'connect' END AS kind",
        "concat('/d', k % 10, '/f', k) AS path", "concat('/d', user_id % 10, '/f', user_id % 60) AS exe",
        "CASE seq % 3 WHEN 1 THEN sha2(concat('h', k % 7), 256) WHEN 2 THEN sha2(concat('x', k), 256) END AS hash",
        "concat('CAP_', k % 12) AS cap", "CASE seq % 5 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS granted",
        "concat('10.', k % 4, '.', k % 50, '.', seq % 250) AS daddr", "CAST(k % 6 * 1000 + 80 AS INT) AS dport", "value", "k",
    )


def v_file(spark, d) -> DataFrame:
    """Declared files, 60 of each image."""
    return load(spark, d, "part").selectExpr("p_partkey % 60 AS k", "concat('i', p_partkey div 60) AS digest").selectExpr(
        "digest", "k", "concat('/d', k % 10, '/f', k) AS path", "sha2(concat('h', k % 8), 256) AS sha256", "k % 2 = 0 AS in_closure", "k % 6 AS layer",
        "CASE WHEN k % 5 = 0 THEN NULL ELSE concat('pkg:deb/debian/p', k % 12, '@1.', k % 3) END AS package",
    )


def v_package(spark, d) -> DataFrame:
    """Packages of the images with their dependency depth; null where unresolved."""
    return load(spark, d, "part").selectExpr("p_partkey % 60 AS k", "concat('i', p_partkey div 60) AS digest").selectExpr(
        "digest", "concat('pkg:deb/debian/p', k % 12, '@1.', k % 3) AS purl", "CASE WHEN k % 12 = 5 THEN NULL ELSE CAST(k % 12 AS INT) END AS depth"
    ).groupBy("digest", "purl").agg({"depth": "min"}).withColumnRenamed("min(depth)", "depth")


def v_binding(spark, d) -> DataFrame:
    """Containers bound to images, one for each customer; containers 9, 19, 29, ... are never bound."""
    return load(spark, d, "customer").selectExpr("*", "c_custkey + c_custkey div 9 AS m").selectExpr(
        "concat('c', m) AS container_id", "concat('i', m div 5) AS image_digest", "c_acctbal >= 0 AS verified",
        "CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS run_as_root", "c_custkey % 7 = 0 AS privileged",
        "concat('ns', c_custkey % 3) AS namespace", "concat('pod-', c_mktsegment, '-', c_custkey) AS pod",
        "CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN array('/d3') WHEN c_mktsegment = 'HOUSEHOLD' THEN array('/d1/f1', '/d4/') ELSE CAST(array() AS ARRAY<STRING>) END AS mounts",
    )


#: Links of every image: absolute, relative, chained with `..` after a link, a loop, one over a folder that has declared files, one at a declared file.
LINKS = [("/lnk0", "/d0"), ("/lnk1", "/d1"), ("/lnk2", "/d2"), ("/lnk3", "/d3"), ("/lnk4", "/d4"), ("/rel", "d5"), ("/hop", "./rel/../d6"), ("/chain", "/hop"), ("/deep", "/d8/sub"), ("/up", "/deep/../own"), ("/loop1", "/loop2"), ("/loop2", "loop1"), ("/d9", "d2"), ("/lnk2/f12", "/elsewhere")]


def v_link(spark, d) -> DataFrame:
    """Symlinks of the images, all in layer 1."""
    links = F.explode(F.array(*(F.struct(F.lit(a).alias("path"), F.lit(b).alias("target")) for a, b in LINKS)))
    return load(spark, d, "part").selectExpr("concat('i', p_partkey div 60) AS digest").distinct().select("digest", links.alias("l")).select("digest", "l.path", "l.target", F.lit(1).cast("bigint").alias("layer"))


#: What a path of v_link's images really is, for DuckDB.
REAL = r"""CASE WHEN regexp_matches({p}, '^/loop[12](/|$)') THEN NULL WHEN {p} IN ('/lnk2/f12', '/d2/f12', '/d9/f12') THEN '/elsewhere' ELSE regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({p}, '^/lnk([0-4])(/.*)?$', '/d\1\2'),
 '^/rel(/.*)?$', '/d5\1'), '^/(hop|chain)(/.*)?$', '/d6\2'), '^/deep(/.*)?$', '/d8/sub\1'), '^/up(/.*)?$', '/d8/own\1'), '^/d9(/.*)?$', '/d2\1') END"""
#: The same for a key: only its folder is resolved.
KEY = REAL.replace(" WHEN {p} IN ('/lnk2/f12', '/d2/f12', '/d9/f12') THEN '/elsewhere'", "")


def v_alert(spark, d) -> DataFrame:
    """Alerts: one per line item."""
    return load(spark, d, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber AS alert_id", "l_shipdate AS time", "concat('ns', l_suppkey) AS ns", "concat('pod', l_partkey % 5, '-', l_partkey % 9) AS pod",
        "CASE l_linenumber % 4 WHEN 0 THEN 'D_exec' WHEN 1 THEN 'D_write' WHEN 2 THEN 'D_cap' ELSE 'trust' END AS class",
        "CASE WHEN l_quantity < 10 THEN 'critical' WHEN l_quantity < 20 THEN 'high' WHEN l_quantity < 30 THEN 'medium' WHEN l_quantity < 45 THEN 'low' ELSE 'odd' END AS bucket",
        "l_partkey", "l_suppkey",
    )


def v_truth(spark, d) -> DataFrame:
    """Labelled scenario runs, one for each order."""
    return load(spark, d, "orders").selectExpr(
        "o_orderkey AS line", "o_orderpriority AS scenario", "CASE WHEN o_orderstatus = 'F' THEN 'benign' ELSE 'malicious' END AS label",
        "concat('ns', o_custkey div 15) AS namespace", "CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE concat('pod', o_orderkey % 5) END AS pod_prefix",
        "o_orderdate AS start", "o_orderdate + make_interval(0, 0, 0, CAST(o_orderkey % 11 AS INT)) AS stop",
    )


#: Images that have no specification, every fourth: in Spark and in DuckDB.
NO_ENVELOPE = "CAST(substr({}, 2) AS BIGINT) % 4 = 3"

#: The same views for DuckDB.
SQL = {
    "v_event": """SELECT event_id AS seq, ts, epoch_us(ts) * 1000 AS t_ns, 'c' || user_id AS cid, 'i' || (user_id // 5) AS digest, user_id AS pid, user_id % 7 AS ppid,
 CASE event_type WHEN 'purchase' THEN 'exec' WHEN 'click' THEN 'write' WHEN 'view' THEN 'load' WHEN 'error' THEN 'cap' ELSE 'connect' END AS kind,
 '/d' || (k % 10) || '/f' || k AS path, '/d' || (user_id % 10) || '/f' || (user_id % 60) AS exe,
 CASE event_id % 3 WHEN 1 THEN sha256('h' || (k % 7)) WHEN 2 THEN sha256('x' || k) END AS hash,
 'CAP_' || (k % 12) AS cap, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS granted,
 '10.' || (k % 4) || '.' || (k % 50) || '.' || (event_id % 250) AS daddr, CAST(k % 6 * 1000 + 80 AS INTEGER) AS dport, value, k
 FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events)""",
    "v_file": """SELECT digest, k, '/d' || (k % 10) || '/f' || k AS path, sha256('h' || (k % 8)) AS sha256, k % 2 = 0 AS in_closure, k % 6 AS layer,
 CASE WHEN k % 5 = 0 THEN NULL ELSE 'pkg:deb/debian/p' || (k % 12) || '@1.' || (k % 3) END AS package
 FROM (SELECT p_partkey % 60 AS k, 'i' || (p_partkey // 60) AS digest FROM part)""",
    "v_package": """SELECT digest, 'pkg:deb/debian/p' || (k % 12) || '@1.' || (k % 3) AS purl, min(CASE WHEN k % 12 = 5 THEN NULL ELSE CAST(k % 12 AS INTEGER) END) AS depth
 FROM (SELECT p_partkey % 60 AS k, 'i' || (p_partkey // 60) AS digest FROM part) GROUP BY 1, 2""",
    "v_binding": """SELECT 'c' || m AS container_id, 'i' || (m // 5) AS image_digest, c_acctbal >= 0 AS verified,
 CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS run_as_root, c_custkey % 7 = 0 AS privileged, 'ns' || (c_custkey % 3) AS namespace,
 'pod-' || c_mktsegment || '-' || c_custkey AS pod,
 CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN ['/d3'] WHEN c_mktsegment = 'HOUSEHOLD' THEN ['/d1/f1', '/d4/'] ELSE CAST([] AS VARCHAR[]) END AS mounts
 FROM (SELECT *, c_custkey + c_custkey // 9 AS m FROM customer)""",
    "v_alert": """SELECT l_orderkey * 10 + l_linenumber AS alert_id, l_shipdate AS time, 'ns' || l_suppkey AS ns, 'pod' || (l_partkey % 5) || '-' || (l_partkey % 9) AS pod,
 CASE l_linenumber % 4 WHEN 0 THEN 'D_exec' WHEN 1 THEN 'D_write' WHEN 2 THEN 'D_cap' ELSE 'trust' END AS class,
 CASE WHEN l_quantity < 10 THEN 'critical' WHEN l_quantity < 20 THEN 'high' WHEN l_quantity < 30 THEN 'medium' WHEN l_quantity < 45 THEN 'low' ELSE 'odd' END AS bucket,
 l_partkey, l_suppkey FROM lineitem""",
    "v_truth": """SELECT o_orderkey AS line, o_orderpriority AS scenario, CASE WHEN o_orderstatus = 'F' THEN 'benign' ELSE 'malicious' END AS label,
 'ns' || (o_custkey // 15) AS namespace, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'pod' || (o_orderkey % 5) END AS pod_prefix,
 o_orderdate AS start, o_orderdate + to_days(CAST(o_orderkey % 11 AS INTEGER)) AS stop FROM orders""",
}


def with_views(*names: str) -> str:
    """The WITH clause of a DuckDB query over these views."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({SQL[n]})" for n in names)
