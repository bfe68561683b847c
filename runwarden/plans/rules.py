"""Queries of trust rules over joined rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import testviews as V
from ..operators.advisories import matches
from ..operators.forest import spread
from ..operators.normalise import purl_identity
from .registry import query

IMAGE_SQL = """WITH RECURSIVE i AS (SELECT c_custkey AS image, 'k' || (c_custkey % 6) AS key_id, c_custkey % 40 AS t0, 'b' || (c_custkey % 9) AS builder, c_acctbal >= 0 AS trans, c_nationkey FROM customer),
ks AS (SELECT * FROM (VALUES ('k0', 'active', 0), ('k1', 'revoked', 0), ('k2', 'disabled', 0), ('k3', 'rotated', 20)) AS x(key_id, state, since)),
k AS (SELECT i.*, CASE WHEN image % 10 = 0 THEN NULL WHEN state IS NULL THEN false WHEN state = 'active' THEN true WHEN state = 'rotated' THEN t0 < since ELSE false END AS ok_key FROM i LEFT JOIN ks USING (key_id)),
f AS (SELECT image, bool_or(c_nationkey % 7 = 3) AS bad FROM i GROUP BY 1),
s AS (SELECT k.*, builder NOT IN ('b4', 'b7') AS ok_builder, NOT f.bad AS ok_comp FROM k JOIN f USING (image))"""


def images(spark, d):
    return V.load(spark, d, "customer").selectExpr("c_custkey AS image", "concat('k', c_custkey % 6) AS key_id", "c_custkey % 40 AS t0", "concat('b', c_custkey % 9) AS builder", "c_acctbal >= 0 AS trans", "c_nationkey")


def key_check(state: Column, t0: Column, since: Column, has_key: Column) -> Column:
    """Null without a key; an unknown key fails; a rotated one holds for what was signed before."""
    return F.when(has_key, F.when(state == "active", True).when(state == "rotated", t0 < since).otherwise(False))


def checked(spark, d) -> DataFrame:
    states = spark.createDataFrame([("k0", "active", 0), ("k1", "revoked", 0), ("k2", "disabled", 0), ("k3", "rotated", 20)], "key_id string, state string, since long")
    deny = spark.createDataFrame([("b4",), ("b7",)], "builder string").withColumn("denied", F.lit(True))
    rows = images(spark, d).join(F.broadcast(states), "key_id", "left").join(F.broadcast(deny), "builder", "left")
    rows = rows.withColumn("ok_key", key_check(F.col("state"), F.col("t0"), F.col("since"), F.col("image") % 10 != 0))
    return rows.withColumn("ok_builder", F.col("denied").isNull()).withColumn("ok_comp", F.col("c_nationkey") % 7 != 3)


@query("tru_key", IMAGE_SQL + " SELECT image, ok_key FROM s")
def tru_key(spark, d):
    return checked(spark, d).select("image", "ok_key")


@query("tru_builder", IMAGE_SQL + " SELECT image, ok_builder FROM s")
def tru_builder(spark, d):
    return checked(spark, d).select("image", "ok_builder")


@query("tru_component", IMAGE_SQL + " SELECT image, ok_comp FROM s")
def tru_component(spark, d):
    """A malicious-package advisory on a component fails; others are only reported."""
    found = images(spark, d).select("image", F.concat(F.when(F.col("c_nationkey") % 7 == 3, "MAL-").otherwise("CVE-"), F.col("c_nationkey")).alias("advisory"))
    return found.groupBy("image").agg((~F.bool_or(F.col("advisory").startswith("MAL-"))).alias("ok_comp"))


@query("tru_evaluate", IMAGE_SQL + " SELECT image, coalesce(ok_key, true) AND trans AND ok_builder AND ok_comp AS trusted, concat_ws(',', CASE WHEN NOT ok_key THEN 'key' END, CASE WHEN NOT trans THEN 'trans' END, CASE WHEN NOT ok_builder THEN 'builder' END, CASE WHEN NOT ok_comp THEN 'comp' END) AS failed FROM s")
def tru_evaluate(spark, d):
    """Trusted if no check is false; a null check passes."""
    names = {"key": "ok_key", "trans": "trans", "builder": "ok_builder", "comp": "ok_comp"}
    checks = F.array(*(F.col(c) for c in names.values()))
    failed = F.concat_ws(",", *(F.when(~F.col(c), n) for n, c in names.items()))
    return checked(spark, d).select("image", (~F.exists(checks, lambda x: F.coalesce(~x, F.lit(False)))).alias("trusted"), failed.alias("failed"))


@query("tru_sig_only", IMAGE_SQL + " SELECT image FROM s WHERE NOT (coalesce(ok_key, true) AND trans AND ok_builder AND ok_comp) AND ok_key IS DISTINCT FROM false AND trans")
def tru_sig_only(spark, d):
    """Untrusted for reasons other than the key and the log."""
    rows = checked(spark, d).where("not (coalesce(ok_key, true) and trans and ok_builder and ok_comp)")
    return rows.where("coalesce(ok_key, true) and trans").select("image")


def folded_root(leaf: Column, index: Column, size: Column, hashes: Column) -> Column:
    """RFC 6962 inclusion: the root that a leaf hash, its index, the tree's size and the audit path give; null if the path's length is wrong."""
    node = lambda a, b: F.sha2(F.concat(F.unhex(F.lit("01")), F.unhex(a), F.unhex(b)), 256)
    start = F.struct(index.cast("bigint").alias("fn"), (size - 1).cast("bigint").alias("sn"), leaf.alias("r"), F.lit(False).alias("err"))

    def step(s, h):
        fn, sn = s["fn"], s["sn"]
        left = (fn.bitwiseAND(F.lit(1)) == 1) | (fn == sn)
        skip = F.when(left & (fn.bitwiseAND(F.lit(1)) == 0) & (fn != 0), F.bit_count(fn.bitwiseAND(-fn) - 1)).otherwise(0)
        return F.struct(
            F.floor(fn / F.pow(F.lit(2.0), skip + 1)).cast("bigint").alias("fn"), F.floor(sn / F.pow(F.lit(2.0), skip + 1)).cast("bigint").alias("sn"), F.when(left, node(h, s["r"])).otherwise(node(s["r"], h)).alias("r"), (s["err"] | (sn == 0)).alias("err")
        )

    return F.aggregate(hashes, start, step, lambda s: F.when(~s["err"] & (s["sn"] == 0), s["r"]))


@query("tru_inclusion", "WITH l AS (SELECT c_custkey AS i, c_custkey // 5 AS tree, sha256('leaf' || c_custkey) AS h FROM customer), t AS (SELECT tree, arg_min(h, i) FILTER (i % 5 = 0) AS a, arg_min(h, i) FILTER (i % 5 = 1) AS b, arg_min(h, i) FILTER (i % 5 = 2) AS c, arg_min(h, i) FILTER (i % 5 = 3) AS d, arg_min(h, i) FILTER (i % 5 = 4) AS e FROM l GROUP BY 1) SELECT i, sha256(unhex('01' || sha256(unhex('01' || sha256(unhex('01' || a || b)) || sha256(unhex('01' || c || d)))) || e)) AS root FROM l JOIN t USING (tree)")
def tru_inclusion(spark, d):
    """Trees of five leaves, an odd number: every leaf's own audit path must fold to the tree's root."""
    c = V.load(spark, d, "customer").select(F.col("c_custkey").alias("i"), F.expr("c_custkey div 5").alias("tree"), F.sha2(F.concat(F.lit("leaf"), F.col("c_custkey").cast("string")), 256).alias("h"))
    leaves = c.groupBy("tree").agg(*(F.max(F.when(F.col("i") % 5 == j, F.col("h"))).alias(f"h{j}") for j in range(5)))
    node = lambda a, b: F.sha2(F.concat(F.unhex(F.lit("01")), F.unhex(a), F.unhex(b)), 256)
    t = leaves.withColumn("h01", node(F.col("h0"), F.col("h1"))).withColumn("h23", node(F.col("h2"), F.col("h3"))).withColumn("h0123", node(F.col("h01"), F.col("h23")))
    paths = F.array(*(F.array(*p) for p in (("h1", "h23", "h4"), ("h0", "h23", "h4"), ("h3", "h01", "h4"), ("h2", "h01", "h4"), ("h0123",))))
    at = F.col("i") % 5
    rows = c.join(t.select("tree", paths.alias("paths")), "tree")
    return rows.select("i", folded_root(F.col("h"), at, F.lit(5), F.element_at("paths", (at + 1).cast("int"))).alias("root"))


@query("tru_evidence_admit", "SELECT c_custkey AS image, c_custkey % 2 = 0 AND c_custkey % 3 <> 1 AND c_custkey % 5 <> 0 AND c_custkey % 7 <> 2 AS admitted FROM customer")
def tru_evidence_admit(spark, d):
    """Signature entry, both statements with all subjects of the digest, a builder, a commit."""
    c = V.load(spark, d, "customer").selectExpr("c_custkey AS image", "sha2(CAST(c_custkey AS STRING), 256) AS digest", "c_custkey % 2 = 0 AS signed", "CASE WHEN c_custkey % 3 = 1 THEN 'other' ELSE 'https://cyclonedx.org/bom' END AS predicate",
        "CASE WHEN c_custkey % 5 = 0 THEN array(sha2(CAST(c_custkey AS STRING), 256), 'x') ELSE array(sha2(CAST(c_custkey AS STRING), 256)) END AS subject", "CASE WHEN c_custkey % 7 = 2 THEN 'main' ELSE sha1(CAST(c_custkey AS STRING)) END AS commit")
    ok = F.col("signed") & (F.col("predicate") == "https://cyclonedx.org/bom") & F.forall("subject", lambda s: s == F.col("digest")) & F.col("commit").rlike("^[0-9a-f]{40}$")
    return c.select("image", ok.alias("admitted"))


@query("tru_admission_binding", V.with_views("v_binding") + " SELECT container_id, coalesce(run_as_root, privileged, true) AS root, privileged AND verified AS privileged, list_sort(list_distinct(list_concat(mounts, ['/proc', '/dev']))) AS mounts FROM v_binding")
def tru_admission_binding(spark, d):
    b = V.v_binding(spark, d)
    managed = F.array(F.lit("/proc"), F.lit("/dev"))
    return b.select("container_id", F.coalesce("run_as_root", "privileged", F.lit(True)).alias("root"), (F.col("privileged") & F.col("verified")).alias("privileged"), F.array_sort(F.array_union("mounts", managed)).alias("mounts"))


#: What the unknown attacks leave behind, the helper that no package owns, and the address that they call.
ARTEFACTS, ARTEFACT_DIR = ["/tmp/.x9", "/tmp/.inj.so"], "/tmp/.cache/"
HELPER, CALLED = "/usr/local/bin/helperd", "203.0.113.9"


def _address(ip: Column) -> Column:
    part = F.split(ip, r"\.")
    return sum(F.get(part, F.lit(i)).cast("long") * (1 << (24 - 8 * i)) for i in range(4))


def zero_day(runs, specs, files, egress, windows, models, baselines, advisories, known: str, rules_changed: bool | None = None) -> DataFrame:
    """(check_name, result) of seven leakage checks, each pass, fail or skip; each table is one aggregate, and only those meet.

    runs (start), specs (compiled_at), files (path, package), egress (cidr), windows (stop), models (written), baselines (written), advisories (package).
    A window that overlaps an attack ends after the first run, so its end alone is compared. Times that are null are passed over, but in specs and models one must be known.
    """
    first = runs.agg(F.min("start").alias("first"))
    none, undated = F.col("n") == 0, F.col("first").isNull()

    def check(name: str, found: DataFrame, ok: Column, skip: Column) -> DataFrame:
        return found.crossJoin(F.broadcast(first)).select(F.lit(name).alias("check_name"), F.when(skip, "skip").when(F.coalesce(ok, F.lit(False)), "pass").otherwise("fail").alias("result"))

    count = F.count("*").alias("n")
    last = lambda t, c: t.agg(count, F.max(c).alias("last"))
    left = F.col("path").isin(ARTEFACTS) | F.startswith("path", F.lit(ARTEFACT_DIR)) | ((F.col("path") == HELPER) & F.col("package").isNotNull())
    width = F.lit(32) - F.coalesce(F.get(F.split("cidr", "/"), F.lit(1)).cast("int"), F.lit(32))
    held = F.expr("shiftright(own, width) = shiftright(called, width)")
    nets = egress.select(_address(F.get(F.split("cidr", "/"), F.lit(0))).alias("own"), width.alias("width"), _address(F.lit(CALLED)).alias("called"))
    declared = files.agg(count, F.count_if(left).alias("declared")).crossJoin(nets.agg(F.count_if(held).alias("allowed")))
    other = F.count_if((F.col("package") != "") & (F.col("package") != known)).alias("other")
    checks = [
        check("spec_first", specs.agg(count, F.min("compiled_at").alias("t")), F.col("t") < F.col("first"), none | undated),
        check("artefacts_undeclared", declared, (F.col("declared") == 0) & (F.col("allowed") == 0), none),
        check("training_windows", last(windows, "stop"), ~none & F.coalesce(F.col("last") <= F.col("first"), F.lit(True)), undated),
        check("model_first", last(models, "written"), F.col("last") < F.col("first"), none | undated),
        check("baselines_first", last(baselines, "written"), F.coalesce(F.col("last") <= F.col("first"), F.lit(True)), none | undated),
        check("advisories_known", advisories.agg(other), F.col("other") == 0, F.lit(False)),
        check("rules_default", runs.agg(count), F.lit(rules_changed is False), F.lit(rules_changed is None)),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


@query(
    "tru_zero_day",
    V.with_views("v_file") + ", f AS (SELECT min(o_orderdate) AS first FROM orders), c AS (SELECT 'spec_first' AS check_name, (SELECT min(l_shipdate) FROM lineitem) < first AS ok FROM f "
    "UNION ALL SELECT 'artefacts_undeclared', (SELECT count(*) FROM v_file WHERE path IN ('/tmp/.x9', '/tmp/.inj.so') OR starts_with(path, '/tmp/.cache/')) + (SELECT count(*) FROM supplier WHERE s_suppkey % 300 = 203) = 0 "
    "UNION ALL SELECT 'training_windows', (SELECT max(ts) FROM events) - INTERVAL 40 YEAR <= first FROM f UNION ALL SELECT 'model_first', (SELECT max(ts) FROM events) - INTERVAL 40 YEAR < first FROM f "
    "UNION ALL SELECT 'baselines_first', (SELECT max(ts) FROM events) <= first FROM f UNION ALL SELECT 'advisories_known', (SELECT count(*) FROM supplier WHERE s_suppkey % 30 <> 0) = 0) "
    "SELECT check_name, CASE WHEN ok THEN 'pass' ELSE 'fail' END AS result FROM c UNION ALL SELECT 'rules_default', 'skip'",
)
def tru_zero_day(spark, d):
    """Scenario runs against specifications, training data forty years older, baselines that came later, and advisories of many packages."""
    events = V.load(spark, d, "events").selectExpr("user_id", "ts", "ts - make_interval(40) AS old")
    of = lambda name, *columns: V.load(spark, d, name).selectExpr(*columns)
    return zero_day(
        V.v_truth(spark, d), of("lineitem", "l_shipdate AS compiled_at"), V.v_file(spark, d), of("supplier", "concat(s_suppkey % 300, '.0.0.0/8') AS cidr"),
        events.selectExpr("old AS stop"), events.groupBy((F.col("user_id") / 5).cast("int")).agg(F.max("old").alias("written")), events.groupBy("user_id").agg(F.max("ts").alias("written")),
        of("supplier", "concat('n', s_suppkey % 30) AS package"), "n0",
    )


@query("tru_digest_audit", "SELECT lang AS digest, count(*) AS n, count(*) FILTER (doc_id % 10 = 0) AS wrong FROM documents GROUP BY 1")
def tru_digest_audit(spark, d):
    """Contents against declared digests; every tenth declares another."""
    rows = V.load(spark, d, "documents").select("lang", F.sha2("text", 256).alias("own"), F.when(F.col("doc_id") % 10 == 0, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.sha2("text", 256)).alias("declared"))
    return rows.groupBy(F.col("lang").alias("digest")).agg(F.count("*").alias("n"), F.count_if(F.col("own") != F.col("declared")).alias("wrong"))


@query("join_advisory_package", "WITH a AS (SELECT s_suppkey AS adv, 'n' || (s_suppkey % 30) AS name, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'ns' || (s_suppkey % 2) END AS ns, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE ['1.' || (s_suppkey % 5), '1.9'] END AS versions FROM supplier), p AS (SELECT p_partkey, 'n' || (p_partkey % 60) AS name, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 'ns' || (p_partkey % 2) END AS ns, '1.' || (p_size % 10) AS version FROM part) SELECT adv, p_partkey FROM a JOIN p ON a.name = p.name AND (a.ns IS NULL OR p.ns IS NULL OR a.ns = p.ns) AND (versions IS NULL OR list_contains(versions, version))")
def join_advisory_package(spark, d):
    """Name equal, namespace equal or either unknown, version listed or none listed."""
    a = V.load(spark, d, "supplier").selectExpr("s_suppkey AS adv", "concat('n', s_suppkey % 30) AS name", "CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE concat('ns', s_suppkey % 2) END AS namespace", "CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE array(concat('1.', s_suppkey % 5), '1.9') END AS versions")
    # Dealt out first: names take long to read from the few bytes of a file.
    purl = spread(V.load(spark, d, "part").select("p_partkey", "p_size"), "p_partkey").selectExpr("p_partkey AS package", "concat('pkg:t/', CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat('ns', p_partkey % 2, '/') END, 'n', p_partkey % 60, coalesce(concat('@1.', p_size % 10), '')) AS purl")
    p = purl.select("package", *(c.alias(n) for n, c in purl_identity(F.col("purl")).items()))
    return matches(a, p).withColumnRenamed("package", "p_partkey")


@query("join_finding_layers", V.with_views("v_file") + " SELECT digest, package, list_sort(list(DISTINCT layer)) AS layers FROM v_file WHERE package LIKE '%p1@%' GROUP BY 1, 2")
def join_finding_layers(spark, d):
    return V.v_file(spark, d).where("package like '%p1@%'").groupBy("digest", "package").agg(F.sort_array(F.collect_set("layer")).alias("layers"))


@query("agg_runtime_state", V.with_views("v_alert") + " SELECT ns, bool_or(class <> 'trust' AND bucket IN ('critical', 'high', 'medium')) AS deviating FROM v_alert GROUP BY 1")
def agg_runtime_state(spark, d):
    return V.v_alert(spark, d).groupBy("ns").agg(F.bool_or((F.col("class") != "trust") & F.col("bucket").isin("critical", "high", "medium")).alias("deviating"))


@query("join_owner_purl", "WITH f AS (SELECT p_partkey AS file, 'n' || (p_partkey % 50) AS name, CASE WHEN p_partkey % 3 = 0 THEN '2:' ELSE '' END || '1.' || (p_size % 6) AS version, CASE WHEN p_size % 2 = 0 THEN 'amd64' ELSE 'all' END AS arch FROM part), s AS (SELECT 'pkg:deb/n' || (s_suppkey % 50) || '@1.' || (s_suppkey % 6) || '?arch=' || CASE WHEN s_suppkey % 4 = 0 THEN 'amd64' ELSE 'all' END AS purl, 'n' || (s_suppkey % 50) AS name, '1.' || (s_suppkey % 6) AS version, CASE WHEN s_suppkey % 4 = 0 THEN 'amd64' ELSE 'all' END AS arch FROM supplier), j AS (SELECT f.file, s.purl, row_number() OVER (PARTITION BY f.file ORDER BY CASE WHEN f.arch = s.arch THEN 0 ELSE 1 END, s.purl) AS r FROM f JOIN s ON f.name = s.name AND (f.version = s.version OR regexp_replace(f.version, '^[0-9]+:', '') = s.version)) SELECT file, purl FROM j WHERE r = 1")
def join_owner_purl(spark, d):
    """By name and version, again without the epoch; of several, that of the own architecture, then the least."""
    f = V.load(spark, d, "part").selectExpr("p_partkey AS file", "concat('n', p_partkey % 50) AS name", "concat(CASE WHEN p_partkey % 3 = 0 THEN '2:' ELSE '' END, '1.', p_size % 6) AS version", "CASE WHEN p_size % 2 = 0 THEN 'amd64' ELSE 'all' END AS arch")
    s = V.load(spark, d, "supplier").selectExpr("concat('pkg:deb/n', s_suppkey % 50, '@1.', s_suppkey % 6, '?arch=', CASE WHEN s_suppkey % 4 = 0 THEN 'amd64' ELSE 'all' END) AS purl", "concat('n', s_suppkey % 50) AS name", "concat('1.', s_suppkey % 6) AS version", "CASE WHEN s_suppkey % 4 = 0 THEN 'amd64' ELSE 'all' END AS s_arch")
    f = f.withColumn("version", F.explode(F.array_distinct(F.array(F.col("version"), F.regexp_replace("version", "^[0-9]+:", "")))))
    return f.join(s, ["name", "version"]).groupBy("file").agg(F.min_by("purl", F.struct(F.col("arch") != F.col("s_arch"), "purl")).alias("purl"))


@query("join_library_search", "WITH n AS (SELECT p_partkey AS lib, 'lib' || (p_partkey % 40) AS name, p_partkey % 3 AS dirset FROM part), dirs AS (SELECT ds, unnest([0, 1, 2, 3]) AS rank, unnest(CASE ds WHEN 0 THEN ['/a', '/b', '/lib', '/usr/lib'] WHEN 1 THEN ['/b', '/a', '/lib', '/usr/lib'] ELSE ['/usr/lib', '/lib', '/a', '/b'] END) AS dir FROM (VALUES (0), (1), (2)) AS x(ds)), f AS (SELECT CASE s_suppkey % 4 WHEN 0 THEN '/a' WHEN 1 THEN '/b' WHEN 2 THEN '/lib' ELSE '/usr/lib' END AS dir, 'lib' || (s_suppkey % 40) AS name FROM supplier) SELECT lib, arg_min(dirs.dir || '/' || n.name, rank) AS path FROM n JOIN dirs ON dirs.ds = n.dirset JOIN (SELECT DISTINCT * FROM f) f ON f.dir = dirs.dir AND f.name = n.name GROUP BY 1")
def join_library_search(spark, d):
    """The first hit along ordered search directories."""
    orders = [("/a", "/b", "/lib", "/usr/lib"), ("/b", "/a", "/lib", "/usr/lib"), ("/usr/lib", "/lib", "/a", "/b")]
    dirs = spark.createDataFrame([(s, r, x) for s, xs in enumerate(orders) for r, x in enumerate(xs)], "ds long, rank int, dir string")
    n = V.load(spark, d, "part").selectExpr("p_partkey AS lib", "concat('lib', p_partkey % 40) AS name", "p_partkey % 3 AS ds")
    f = V.load(spark, d, "supplier").selectExpr("element_at(array('/a', '/b', '/lib', '/usr/lib'), CAST(s_suppkey % 4 + 1 AS INT)) AS dir", "concat('lib', s_suppkey % 40) AS name").distinct()
    hit = n.join(F.broadcast(dirs), "ds").join(f, ["dir", "name"])
    return hit.groupBy("lib").agg(F.min_by(F.concat_ws("/", "dir", "name"), "rank").alias("path"))


@query("join_path_search", "WITH c AS (SELECT c_custkey AS cmd, 'x' || c_custkey AS name FROM customer), f AS (SELECT 'x' || (p_partkey // 3) AS name, CASE p_partkey % 3 WHEN 0 THEN '/usr/bin' WHEN 1 THEN '/bin' ELSE '/sbin' END AS dir, p_partkey % 3 AS rank, (p_size * 13) % 512 AS mode FROM part) SELECT cmd, arg_min(dir || '/' || c.name, rank) AS path FROM c JOIN f ON f.name = c.name WHERE mode & 73 <> 0 GROUP BY 1")
def join_path_search(spark, d):
    """The first executable along the path."""
    c = V.load(spark, d, "customer").selectExpr("c_custkey AS cmd", "concat('x', c_custkey) AS name")
    f = V.load(spark, d, "part").selectExpr("concat('x', p_partkey div 3) AS name", "element_at(array('/usr/bin', '/bin', '/sbin'), CAST(p_partkey % 3 + 1 AS INT)) AS dir", "p_partkey % 3 AS rank", "p_size * 13 % 512 AS mode")
    hit = c.join(f.where(F.col("mode").bitwiseAND(F.lit(0o111)) != 0), "name")
    return hit.groupBy("cmd").agg(F.min_by(F.concat_ws("/", "dir", "name"), "rank").alias("path"))


@query("join_process_counters", "SELECT a.s_suppkey AS pid, CASE WHEN b.s_nationkey IS NULL OR b.s_nationkey <> a.s_nationkey % 20 THEN a.s_acctbal ELSE a.s_acctbal - b.s_acctbal / 2 END AS cpu FROM supplier a LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 3 > 0) b ON a.s_suppkey = b.s_suppkey")
def join_process_counters(spark, d):
    """Counter differences by pid, only if the group is the same; else the whole value."""
    s = V.load(spark, d, "supplier")
    before = s.where("s_suppkey % 3 > 0").selectExpr("s_suppkey AS pid", "s_nationkey AS g0", "s_acctbal / 2 AS cpu0")
    after = s.selectExpr("s_suppkey AS pid", "s_nationkey % 20 AS g1", "s_acctbal AS cpu1").join(before, "pid", "left")
    return after.select("pid", F.when(F.col("g0") == F.col("g1"), F.col("cpu1") - F.col("cpu0")).otherwise(F.col("cpu1")).alias("cpu"))


@query("join_k_syscalls", "SELECT DISTINCT c_nationkey AS image, 'sys' || (c_custkey % 15 + j) AS call FROM customer, (VALUES (0), (1)) AS x(j) UNION SELECT DISTINCT c_nationkey, 'exit' FROM customer")
def join_k_syscalls(spark, d):
    """Imported functions to system calls by a map table, and what every binary needs."""
    imports = V.load(spark, d, "customer").selectExpr("c_nationkey AS image", "concat('fn', c_custkey % 15) AS fn")
    table_ = spark.createDataFrame([(f"fn{i}", [f"sys{i}", f"sys{i + 1}"]) for i in range(15)], "fn string, calls array<string>")
    used = imports.join(F.broadcast(table_), "fn").select("image", F.explode("calls").alias("call"))
    return used.union(imports.select("image", F.lit("exit"))).distinct()


@query("str_binding_upsert", V.with_views("v_binding") + ", u AS (SELECT 'c' || user_id AS container_id, event_id AS v, event_type = 'error' AS gone FROM events) SELECT container_id, max(v) AS version FROM u GROUP BY 1 HAVING NOT arg_max(gone, v)")
def str_binding_upsert(spark, d):
    """Snapshots come as a stream: state keeps each container's newest; deleted ones go."""
    from ..streaming import sinks
    from .inputs import folder

    src, out, ck = (folder(spark, x) for x in ("snapshots", "bindings", "ck"))
    V.load(spark, d, "events").selectExpr("concat('c', user_id) AS container_id", "event_id AS v", "event_type = 'error' AS gone").repartition(3).write.parquet(src)
    rows = spark.readStream.schema("container_id string, v long, gone boolean").parquet(src)
    sinks.latest(rows.groupBy("container_id").agg(F.max(F.struct("v", "gone")).alias("newest")), out, ck)
    newest = spark.read.schema("container_id string, newest struct<v: long, gone: boolean>").parquet(out).groupBy("container_id").agg(F.max("newest").alias("newest"))
    return newest.where("not newest.gone").select("container_id", F.col("newest.v").alias("version"))
