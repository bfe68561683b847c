"""Queries of verification, binding and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import testviews as V
from ..operators import egress as EG, links as LK, score as S, verify as VF
from ..operators.ranks import ordered_places
from .registry import query

DECIDED_SQL = """, base AS (
 SELECT e.*, f.sha256 AS f_sha256, f.layer AS f_layer, f.package AS f_package, f.in_closure, r.reloc_path, r.reloc_n, x.in_closure AS exe_in_closure
 FROM (SELECT * REPLACE (CASE WHEN kind = 'exec' THEN path ELSE path END AS path) FROM v_event WHERE kind IN ('exec', 'load')) e
 LEFT JOIN v_file f ON f.digest = e.digest AND f.path = e.path
 LEFT JOIN (SELECT digest, sha256, min(path) AS reloc_path, count(*) AS reloc_n FROM v_file GROUP BY 1, 2) r ON r.digest = e.digest AND r.sha256 = e.hash
 LEFT JOIN v_file x ON x.digest = e.digest AND x.path = e.exe),
raw AS (SELECT *, CASE WHEN kind = 'load' AND path = exe THEN 'conforming'
  WHEN f_sha256 IS NOT NULL AND hash IS NOT NULL AND hash <> f_sha256 THEN 'D_hash/modified'
  WHEN f_sha256 IS NOT NULL AND in_closure THEN 'conforming'
  WHEN f_sha256 IS NOT NULL THEN CASE WHEN kind = 'exec' THEN 'D_exec' ELSE 'D_load' END || '/outside_closure'
  WHEN reloc_path IS NOT NULL THEN 'D_hash/relocated'
  ELSE CASE WHEN kind = 'exec' THEN 'D_exec' ELSE 'D_load' END || '/undeclared' END AS o FROM base),
decided AS (SELECT *, CASE WHEN o = 'D_load/outside_closure' AND NOT (coalesce(exe_in_closure, false)
  AND row_number() OVER (PARTITION BY cid, path, o = 'D_load/outside_closure' AND coalesce(exe_in_closure, false) ORDER BY seq) = 1) THEN 'suppressed' ELSE o END AS outcome FROM raw)"""


def decided_exec_load(spark, d):
    """Execs and loads of v_event with their outcome; an exec's path is what it runs."""
    files = V.v_file(spark, d)
    e = V.v_event(spark, d).where("kind in ('exec', 'load')")
    e = VF.with_relocated(VF.with_declared(e, files), files)
    e = e.join(files.select("digest", F.col("path").alias("exe"), F.col("in_closure").alias("exe_in_closure")), ["digest", "exe"], "left")
    e = e.withColumn("outcome", VF.exec_load_outcome(F.col("kind"), F.col("path"), F.col("exe")))
    return VF.first_weak_loads(e, F.col("exe_in_closure"))


@query("vfy_exec_load", V.with_views("v_event", "v_file") + DECIDED_SQL + " SELECT seq, kind, o AS outcome FROM raw")
def vfy_exec_load(spark, d):
    files = V.v_file(spark, d)
    e = VF.with_relocated(VF.with_declared(V.v_event(spark, d).where("kind in ('exec', 'load')"), files), files)
    return e.select("seq", "kind", VF.exec_load_outcome(F.col("kind"), F.col("path"), F.col("exe")).alias("outcome"))


@query("vfy_weak_load_once", V.with_views("v_event", "v_file") + DECIDED_SQL + " SELECT seq, outcome FROM decided")
def vfy_weak_load_once(spark, d):
    return decided_exec_load(spark, d).select("seq", "outcome")


@query("vfy_stats", V.with_views("v_event", "v_file") + DECIDED_SQL + " SELECT outcome, count(*) AS n FROM decided GROUP BY 1")
def vfy_stats(spark, d):
    return decided_exec_load(spark, d).groupBy("outcome").agg(F.count("*").alias("n"))


@query("vfy_path_only", V.with_views("v_event", "v_file") + DECIDED_SQL.replace("SELECT * REPLACE (CASE WHEN kind = 'exec' THEN path ELSE path END AS path)", "SELECT * REPLACE (CAST(NULL AS VARCHAR) AS hash)") + " SELECT o AS outcome, count(*) AS n FROM raw GROUP BY 1")
def vfy_path_only(spark, d):
    """The same decisions with hashes stripped."""
    files = V.v_file(spark, d)
    e = V.v_event(spark, d).where("kind in ('exec', 'load')").withColumn("hash", F.lit(None).cast("string"))
    e = VF.with_relocated(VF.with_declared(e, files), files)
    return e.groupBy(VF.exec_load_outcome(F.col("kind"), F.col("path"), F.col("exe")).alias("outcome")).agg(F.count("*").alias("n"))


@query("vfy_runtime_hash", V.with_views("v_event") + """, known AS (SELECT cid, pid, min(hash) AS h FROM v_event WHERE kind = 'write' GROUP BY 1, 2)
SELECT e.seq, coalesce(e.hash, k.h) AS hash FROM v_event e LEFT JOIN known k USING (cid, pid) WHERE e.kind = 'exec'""")
def vfy_runtime_hash(spark, d):
    """A missing exec hash is filled from a lookup by (container, pid)."""
    e = V.v_event(spark, d)
    known = e.where("kind = 'write'").groupBy("cid", "pid").agg(F.min("hash").alias("h"))
    return e.where("kind = 'exec'").join(known, ["cid", "pid"], "left").select("seq", F.coalesce("hash", "h").alias("hash"))


@query("vfy_detail_text", V.with_views("v_event", "v_file") + DECIDED_SQL + """ SELECT seq, CASE outcome WHEN 'D_hash/modified' THEN 'runtime sha256 ' || left(hash, 12) || ' differs from ' || left(f_sha256, 12) || ' (layer ' || f_layer || ')'
 WHEN 'D_hash/relocated' THEN 'in no layer, content is ' || reloc_path || CASE WHEN reloc_n > 1 THEN ' and ' || (reloc_n - 1) || ' more' ELSE '' END
 WHEN 'D_exec/outside_closure' THEN 'declared in layer ' || f_layer || ', not reachable' WHEN 'D_load/outside_closure' THEN 'declared in layer ' || f_layer || ', not reachable'
 ELSE 'path is in no layer' || CASE WHEN hash IS NULL THEN ' (path only)' ELSE '' END END AS detail FROM decided WHERE outcome NOT IN ('conforming', 'suppressed')""")
def vfy_detail_text(spark, d):
    rows = decided_exec_load(spark, d).where("outcome not in ('conforming', 'suppressed')")
    more = F.when(F.col("reloc_n") > 1, F.concat(F.lit(" and "), F.col("reloc_n") - 1, F.lit(" more"))).otherwise("")
    text = (
        F.when(F.col("outcome") == "D_hash/modified", F.concat(F.lit("runtime sha256 "), F.left("hash", F.lit(12)), F.lit(" differs from "), F.left("f_sha256", F.lit(12)), F.lit(" (layer "), "f_layer", F.lit(")")))
        .when(F.col("outcome") == "D_hash/relocated", F.concat(F.lit("in no layer, content is "), "reloc_path", more))
        .when(F.col("outcome").endswith("outside_closure"), F.concat(F.lit("declared in layer "), "f_layer", F.lit(", not reachable")))
        .otherwise(F.concat(F.lit("path is in no layer"), F.when(F.col("hash").isNull(), " (path only)").otherwise("")))
    )
    return rows.select("seq", text.alias("detail"))


WRITES_SQL = """, w AS (SELECT e.*, f.sha256 AS f_sha256, f.package AS f_package, b.mounts FROM v_event e LEFT JOIN v_file f ON f.digest = e.digest AND f.path = e.path
 LEFT JOIN v_binding b ON b.container_id = e.cid WHERE e.kind = 'write'),
wm AS (SELECT *, coalesce(len(list_filter(mounts, lambda m: rtrim(m, '/') = '' OR path = rtrim(m, '/') OR starts_with(path, rtrim(m, '/') || '/'))) > 0, false) AS under FROM w)"""


def writes(spark, d):
    e = VF.with_declared(V.v_event(spark, d).where("kind = 'write'"), V.v_file(spark, d))
    return e.join(V.v_binding(spark, d).select(F.col("container_id").alias("cid"), "mounts"), "cid", "left")


@query("pred_under_mount", V.with_views("v_event", "v_file", "v_binding") + WRITES_SQL + " SELECT seq, under FROM wm")
def pred_under_mount(spark, d):
    return writes(spark, d).select("seq", VF.under_mount(F.col("path"), F.col("mounts")).alias("under"))


#: Mounts of bindings, some through links, one of a loop and one that leads up out of a link.
MOUNTS = "SELECT container_id, image_digest AS digest, unnest(list_concat(list_transform(mounts, lambda m: CASE WHEN c % 2 = 0 THEN replace(m, '/d', '/lnk') ELSE m END), CASE c % 5 WHEN 0 THEN ['/loop1/x', '/up/y/'] WHEN 1 THEN ['/'] ELSE [] END)) AS m FROM (SELECT *, CAST(substr(container_id, 2) AS BIGINT) AS c FROM v_binding)"


@query("pred_mounts_canonical", V.with_views("v_binding") + f", m AS ({MOUNTS}), n AS (SELECT *, CASE WHEN rtrim(m, '/') = '' THEN '/' ELSE rtrim(m, '/') END AS given FROM m), r AS (SELECT container_id, given AS p FROM n UNION SELECT container_id, {V.REAL.format(p='given')} FROM n WHERE digest IN (SELECT 'i' || (p_partkey // 60) FROM part)) SELECT container_id, list_sort(list(p)) AS mounts FROM r WHERE p IS NOT NULL GROUP BY 1")
def pred_mounts_canonical(spark, d):
    """Each container's mounts as given and as they really are in its image; a loop is only as given."""
    c = F.expr("CAST(substr(container_id, 2) AS BIGINT)")
    more = F.when(c % 5 == 0, F.array(F.lit("/loop1/x"), F.lit("/up/y/"))).when(c % 5 == 1, F.array(F.lit("/"))).otherwise(F.array().cast("array<string>"))
    given = F.concat(F.transform("mounts", lambda m: F.when(c % 2 == 0, F.replace(m, F.lit("/d"), F.lit("/lnk"))).otherwise(m)), more)
    rows = V.v_binding(spark, d).select("container_id", F.col("image_digest").alias("digest"), F.explode(given).alias("m"))
    rows = rows.select("container_id", "digest", F.regexp_replace("m", "(?<=.)/+$", "").alias("path"))
    real = LK.with_real(rows, LK.canonical_links(V.v_link(spark, d)))
    both = real.select("container_id", F.explode(F.array("path", "real")).alias("p")).where("p is not null")
    return both.groupBy("container_id").agg(F.array_sort(F.collect_set("p")).alias("mounts"))


@query("vfy_write", V.with_views("v_event", "v_file", "v_binding") + WRITES_SQL + " SELECT seq, CASE WHEN under OR f_sha256 IS NULL THEN 'conforming' ELSE 'D_write/declared_file' END AS outcome FROM wm")
def vfy_write(spark, d):
    return writes(spark, d).select("seq", VF.write_outcome(F.col("path"), F.col("mounts")).alias("outcome"))


@query("vfy_cap", V.with_views("v_event") + """, allowed AS (SELECT digest, list(cap) AS caps FROM (SELECT DISTINCT digest, cap FROM v_event WHERE kind = 'cap' AND k % 12 < 7) GROUP BY 1)
SELECT seq, CASE WHEN granted = false OR coalesce(list_contains(caps, cap), false) THEN 'conforming' ELSE 'D_cap/not_in_envelope' END AS outcome FROM v_event LEFT JOIN allowed USING (digest) WHERE kind = 'cap'""")
def vfy_cap(spark, d):
    e = V.v_event(spark, d).where("kind = 'cap'")
    allowed = e.where("k % 12 < 7").groupBy("digest").agg(F.collect_set("cap").alias("caps"))
    return e.join(allowed, "digest", "left").select("seq", VF.cap_outcome(F.col("granted"), F.col("cap"), F.col("caps")).alias("outcome"))


#: Entries of an egress list, one for each supplier: networks and addresses of both versions, with and without ports, in brackets, for any address, and malformed ones.
ENTRIES = """CASE s_suppkey % 10 WHEN 0 THEN '10.' || s_suppkey % 4 || '.0.9/' || (16 + s_suppkey % 3) WHEN 1 THEN '10.0.' || s_suppkey % 50 || '.7'
 WHEN 2 THEN '10.1.' || s_suppkey % 50 || '.128/25:1080' WHEN 3 THEN 'fd00::' || lower(hex(s_suppkey % 16)) || ':0/112' WHEN 4 THEN '[fd00::' || lower(hex(s_suppkey % 16)) || ':' || lower(hex(s_suppkey % 256)) || ']:3080'
 WHEN 5 THEN 'FD00:0:0:0:0:0:' || hex(s_suppkey % 16) || ':80/121' WHEN 6 THEN '*:' || CASE WHEN s_suppkey % 20 = 6 THEN 5080 ELSE 9999 END
 WHEN 7 THEN '10.0.0.300/24' WHEN 8 THEN CASE s_suppkey % 3 WHEN 0 THEN '[::1' WHEN 1 THEN 'host.example:443' ELSE '10.0.0.0/33' END ELSE CASE WHEN s_suppkey % 2 = 0 THEN ' ' ELSE 'fd00::/129' END END"""
#: Connects to addresses of both versions, in several forms.
ADDRESSES = """CASE WHEN seq % 97 = 0 THEN 'not-an-ip' WHEN seq % 4 = 3 THEN CASE WHEN seq % 8 = 7 THEN 'FD00:0:0:0:0:0:' || hex(k % 16) || ':' || hex(seq % 256) ELSE 'fd00::' || lower(hex(k % 16)) || ':' || lower(hex(seq % 256)) END ELSE daddr END"""
#: The same lists as numbers, not read from texts: version, first and last address (the lower 32 bits), port.
CONNECT_SQL = """, r AS (SELECT m, CASE WHEN m IN (0, 1, 2) THEN 4 WHEN m = 6 THEN 0 ELSE 6 END AS version, CASE m WHEN 2 THEN 1080 WHEN 4 THEN 3080 WHEN 6 THEN CASE WHEN i % 20 = 6 THEN 5080 ELSE 9999 END END AS port,
 CASE m WHEN 0 THEN (10 << 24) + ((i % 4) << 16) WHEN 1 THEN (10 << 24) + ((i % 50) << 8) + 7 WHEN 2 THEN (10 << 24) + (1 << 16) + ((i % 50) << 8) + 128 WHEN 3 THEN (i % 16) << 16 WHEN 4 THEN ((i % 16) << 16) + i % 256 WHEN 5 THEN ((i % 16) << 16) + 128 END AS lo,
 CASE m WHEN 0 THEN 1 << (16 - i % 3) WHEN 1 THEN 1 WHEN 2 THEN 128 WHEN 3 THEN 65536 WHEN 4 THEN 1 WHEN 5 THEN 128 END AS size
 FROM (SELECT CAST(s_suppkey AS BIGINT) AS i, s_suppkey % 10 AS m FROM supplier) WHERE m < 7),
c AS (SELECT seq, dport, CASE WHEN seq % 97 = 0 THEN NULL WHEN seq % 4 = 3 THEN 6 ELSE 4 END AS version,
 CASE WHEN seq % 4 = 3 THEN ((k % 16) << 16) + seq % 256 ELSE (10 << 24) + ((k % 4) << 16) + ((k % 50) << 8) + seq % 250 END AS ip FROM (SELECT * REPLACE (CAST(k AS BIGINT) AS k) FROM v_event) WHERE kind = 'connect'),
a AS (SELECT seq, EXISTS (SELECT 1 FROM r WHERE (r.port IS NULL OR r.port = c.dport) AND (r.version = 0 OR (r.version = c.version AND c.ip >= r.lo AND c.ip < r.lo + r.size))) AS allowed FROM c)"""


def egress_entries(spark, d):
    return V.load(spark, d, "supplier").select(F.expr(ENTRIES).alias("entry"))


def connects(spark, d):
    """Connects with `allowed`; entries that are not understood allow nothing."""
    rows = V.v_event(spark, d).where("kind = 'connect'").withColumn("daddr", F.expr(ADDRESSES))
    return EG.allowed(rows, EG.rules_of(egress_entries(spark, d), strict=False))


@query("pred_egress_allow", V.with_views("v_event") + CONNECT_SQL + " SELECT seq, allowed FROM a")
def pred_egress_allow(spark, d):
    return connects(spark, d).select("seq", "allowed")


@query("vfy_connect", V.with_views("v_event") + CONNECT_SQL + " SELECT CASE WHEN allowed THEN 'conforming' ELSE 'D_net/not_allowed' END AS outcome, CASE WHEN allowed THEN NULL ELSE 'CONFIGURED' END AS origin, count(*) AS n, (SELECT count(*) FROM supplier WHERE s_suppkey % 10 > 6) AS refused_entries FROM a GROUP BY 1, 2")
def vfy_connect(spark, d):
    """Outcomes of connects, and how many entries of the list were refused."""
    rows = connects(spark, d).select(F.when(F.col("allowed"), "conforming").otherwise("D_net/not_allowed").alias("outcome"), F.when(~F.col("allowed"), "CONFIGURED").alias("origin"))
    refused = EG.parsed(egress_entries(spark, d)).agg(F.count_if("refused").alias("refused_entries"))
    return rows.groupBy("outcome", "origin").agg(F.count("*").alias("n")).crossJoin(F.broadcast(refused))


# ---- bindings ------------------------------------------------------------------------------------------------------------------
PREFIX = 12


@query("join_event_binding", """WITH e AS (SELECT event_id AS seq, CASE event_id % 4 WHEN 0 THEN 'runtime://' || sha256('c' || user_id) WHEN 1 THEN sha256('c' || user_id) WHEN 2 THEN left(sha256('c' || user_id), 14) ELSE left(sha256('c' || user_id), 8) END AS cid FROM events),
b AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'runtime://' ELSE '' END || sha256('c' || (c_custkey + c_custkey // 9)) AS container_id FROM customer),
bb AS (SELECT container_id, regexp_replace(container_id, '^.*://', '') AS bare FROM b), ee AS (SELECT seq, cid, regexp_replace(cid, '^.*://', '') AS bare FROM e),
p AS (SELECT ee.seq, min(bb.container_id) AS c FROM ee JOIN bb ON length(ee.bare) >= 12 AND starts_with(bb.bare, ee.bare) GROUP BY 1 HAVING count(*) = 1)
SELECT ee.seq, coalesce(f.container_id, g.container_id, p.c) AS container_id FROM ee LEFT JOIN bb f ON f.container_id = ee.cid LEFT JOIN bb g ON g.bare = ee.bare LEFT JOIN p ON p.seq = ee.seq""")
def join_event_binding(spark, d):
    """By full id, else bare id, else a unique prefix of twelve or more characters."""
    sha = F.sha2(F.concat(F.lit("c"), F.col("user_id")), 256)
    m = F.col("event_id") % 4
    e = V.load(spark, d, "events").select(F.col("event_id").alias("seq"), F.when(m == 0, F.concat(F.lit("runtime://"), sha)).when(m == 1, sha).when(m == 2, F.left(sha, F.lit(14))).otherwise(F.left(sha, F.lit(8))).alias("cid"))
    own = F.sha2(F.concat(F.lit("c"), F.expr("c_custkey + c_custkey div 9")), 256)
    b = V.load(spark, d, "customer").select(F.concat(F.when(F.col("c_custkey") % 2 == 0, "runtime://").otherwise(""), own).alias("container_id"))
    bare = lambda c: F.regexp_replace(c, "^.*://", "")
    e, b = e.withColumn("bare", bare("cid")), b.withColumn("b_bare", bare("container_id"))
    near = e.where(F.length("bare") >= PREFIX).join(b.withColumn("short", F.left("b_bare", F.lit(PREFIX))), F.left("bare", F.lit(PREFIX)) == F.col("short")).where(F.col("b_bare").startswith(F.col("bare")))
    near = near.groupBy("seq").agg(F.min("container_id").alias("by_prefix"), F.count("*").alias("n")).where("n = 1").drop("n")
    out = e.join(b.select(F.col("container_id").alias("full")), F.col("cid") == F.col("full"), "left")
    out = out.join(b.select(F.col("container_id").alias("by_bare"), F.col("b_bare").alias("bare")), "bare", "left").join(near, "seq", "left")
    return out.select("seq", F.coalesce("full", "by_bare", "by_prefix").alias("container_id"))


GIVEN_SQL = """SELECT seq, digest, CASE seq % 6 WHEN 0 THEN path WHEN 1 THEN '/lnk' || (k % 10) || '/f' || k WHEN 2 THEN '/rel/f' || k WHEN 3 THEN '/chain/f' || k WHEN 4 THEN '/loop1/f' || k ELSE '/d9/f' || k END AS given FROM v_event"""


@query("join_event_envelope", V.with_views("v_event", "v_file") + f""", e AS ({GIVEN_SQL}), r AS (SELECT *, {V.REAL.format(p='given')} AS real FROM e)
SELECT r.seq, coalesce(a.path, c.path) AS path, coalesce(a.sha256, c.sha256) AS sha256 FROM r LEFT JOIN v_file a ON a.digest = r.digest AND a.path = r.given LEFT JOIN v_file c ON c.digest = r.digest AND c.path = r.real""")
def join_event_envelope(spark, d):
    """The file by its path as given, else by the path that the image's links lead to."""
    f = V.v_file(spark, d).select("digest", "path", "sha256")
    given = F.expr("CASE seq % 6 WHEN 0 THEN path WHEN 1 THEN concat('/lnk', k % 10, '/f', k) WHEN 2 THEN concat('/rel/f', k) WHEN 3 THEN concat('/chain/f', k) WHEN 4 THEN concat('/loop1/f', k) ELSE concat('/d9/f', k) END")
    e = LK.with_real(V.v_event(spark, d).select("seq", "digest", given.alias("given")), LK.canonical_links(V.v_link(spark, d)), "given")
    a = f.withColumnsRenamed({"path": "p1", "sha256": "s1"}).withColumn("given", F.col("p1"))
    c = f.withColumnsRenamed({"path": "p2", "sha256": "s2"}).withColumn("real", F.col("p2"))
    return e.join(a, ["digest", "given"], "left").join(c, ["digest", "real"], "left").select("seq", F.coalesce("p1", "p2").alias("path"), F.coalesce("s1", "s2").alias("sha256"))


CONTEXT_SQL = DECIDED_SQL + ", ctx AS (SELECT d.*, d.f_sha256 IS NOT NULL AS declared, p.depth FROM decided d LEFT JOIN v_package p ON p.digest = d.digest AND p.purl = d.f_package)"


@query("join_context", V.with_views("v_event", "v_file", "v_package") + CONTEXT_SQL + " SELECT seq, declared, f_package AS package, depth, f_layer AS layer FROM ctx")
def join_context(spark, d):
    rows = VF.with_context(decided_exec_load(spark, d), V.v_package(spark, d))
    return rows.select("seq", "declared", F.col("f_package").alias("package"), "depth", F.col("f_layer").alias("layer"))


@query("join_hash_relocated", V.with_views("v_event", "v_file") + " SELECT e.seq, r.p AS path, r.n FROM v_event e JOIN (SELECT digest, sha256, min(path) AS p, count(*) AS n FROM v_file GROUP BY 1, 2) r ON r.digest = e.digest AND r.sha256 = e.hash LEFT JOIN v_file f ON f.digest = e.digest AND f.path = e.path WHERE f.path IS NULL")
def join_hash_relocated(spark, d):
    files = V.v_file(spark, d)
    rows = V.v_event(spark, d).join(files.select("digest", "path"), ["digest", "path"], "left_anti")
    return VF.with_relocated(rows, files).where("reloc_path is not null").select("seq", F.col("reloc_path").alias("path"), F.col("reloc_n").alias("n"))


@query("join_was_bound", V.with_views("v_event", "v_binding") + ", ever AS (SELECT container_id FROM v_binding), now AS (SELECT container_id FROM v_binding WHERE verified) SELECT cid, count(*) AS n FROM v_event WHERE cid IN (SELECT * FROM ever) AND cid NOT IN (SELECT * FROM now) GROUP BY 1")
def join_was_bound(spark, d):
    """Events of containers that were bound once and are not now."""
    b = V.v_binding(spark, d).select(F.col("container_id").alias("cid"), "verified")
    rows = V.v_event(spark, d).join(b.select("cid"), "cid", "left_semi").join(b.where("verified").select("cid"), "cid", "left_anti")
    return rows.groupBy("cid").agg(F.count("*").alias("n"))


@query("join_binding_failure", V.with_views("v_event", "v_binding") + """, j AS (SELECT e.seq, e.cid, CASE WHEN b.container_id IS NULL THEN 'unknown_container' WHEN NOT b.verified THEN 'unverified' WHEN """ + V.NO_ENVELOPE.format("b.image_digest") + """ THEN 'no_envelope' END AS subclass
 FROM v_event e LEFT JOIN v_binding b ON b.container_id = e.cid) SELECT cid, subclass, min(seq) AS seq, count(*) AS n FROM j WHERE subclass IS NOT NULL GROUP BY 1, 2""")
def join_binding_failure(spark, d):
    """The first event of each (container, failure) and how many there are; every fourth image has no envelope."""
    b = V.v_binding(spark, d).select(F.col("container_id").alias("cid"), "verified", "image_digest", F.lit(True).alias("bound"))
    sub = F.when(F.col("bound").isNull(), "unknown_container").when(~F.col("verified"), "unverified").when(F.expr(V.NO_ENVELOPE.format("image_digest")), "no_envelope")
    rows = V.v_event(spark, d).join(b, "cid", "left").select("seq", "cid", sub.alias("subclass")).where("subclass is not null")
    return rows.groupBy("cid", "subclass").agg(F.min("seq").alias("seq"), F.count("*").alias("n"))


@query("join_reference_count", V.with_views("v_binding") + " SELECT image_digest, count(*) AS n FROM v_binding WHERE verified GROUP BY 1")
def join_reference_count(spark, d):
    return V.v_binding(spark, d).where("verified").groupBy("image_digest").agg(F.count("*").alias("n"))


@query("vfy_gate", V.with_views("v_event", "v_file") + DECIDED_SQL + " SELECT seq FROM decided WHERE outcome = 'conforming'")
def vfy_gate(spark, d):
    return decided_exec_load(spark, d).where("outcome = 'conforming'").select("seq")


# ---- scores --------------------------------------------------------------------------------------------------------------------
SCORED_SQL = CONTEXT_SQL + """, parts AS (SELECT c.*, split_part(outcome, '/', 1) AS class, split_part(outcome, '/', 2) AS subclass,
 CASE WHEN NOT declared THEN 1.0::DOUBLE WHEN f_package IS NULL OR depth IS NULL OR depth < 0 THEN 0.5::DOUBLE ELSE depth / (depth + 1.0::DOUBLE) END AS rho,
 CASE WHEN b.container_id IS NOT NULL AND b.privileged THEN 1.0::DOUBLE WHEN b.container_id IS NULL OR coalesce(b.run_as_root, false) THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END AS kappa
 FROM ctx c LEFT JOIN v_binding b ON b.container_id = c.cid WHERE outcome NOT IN ('conforming', 'suppressed')),
sev AS (SELECT *, 0.4::DOUBLE * (CASE WHEN subclass = 'undeclared' AND class = 'D_exec' THEN 1.0::DOUBLE WHEN subclass = 'modified' THEN 1.0::DOUBLE WHEN subclass = 'undeclared' THEN 0.85::DOUBLE WHEN subclass = 'relocated' THEN 0.7::DOUBLE ELSE 0.25::DOUBLE END)
 + 0.2::DOUBLE * 1.0::DOUBLE + 0.4::DOUBLE * (0.5::DOUBLE * rho + 0.5::DOUBLE * kappa) AS s FROM parts),
scored AS (SELECT *, CASE WHEN subclass = 'outside_closure' THEN least(34, x) ELSE x END AS score FROM (SELECT *, CAST(floor(100 * least(1.0::DOUBLE, greatest(0.0::DOUBLE, s)) + 0.5::DOUBLE + 1e-9::DOUBLE) AS INTEGER) AS x FROM sev))"""
BUCKET_SQL = "CASE WHEN score >= 80 THEN 'critical' WHEN score >= 60 THEN 'high' WHEN score >= 35 THEN 'medium' ELSE 'low' END"
ALL_VIEWS = V.with_views("v_event", "v_file", "v_package", "v_binding")


def scored(spark, d):
    rows = VF.with_context(decided_exec_load(spark, d), V.v_package(spark, d)).where("outcome not in ('conforming', 'suppressed')")
    b = V.v_binding(spark, d).select(F.col("container_id").alias("cid"), "privileged", "run_as_root", F.lit(True).alias("bound"), "namespace", "pod")
    rows = rows.join(b, "cid", "left").withColumn("class", F.split_part("outcome", F.lit("/"), F.lit(1))).withColumn("subclass", F.split_part("outcome", F.lit("/"), F.lit(2)))
    rows = rows.withColumn("rho", S.rho(F.col("declared"), F.col("f_package"), F.col("depth"))).withColumn("kappa", S.kappa(F.coalesce("privileged", F.lit(False)), F.col("run_as_root"), F.coalesce("bound", F.lit(False))))
    rows = rows.withColumn("s", S.severity(F.col("class"), F.col("subclass"), F.lit("AUTHENTICATED"), F.col("rho"), F.col("kappa")))
    return rows.withColumn("score", S.score(F.col("class"), F.col("subclass"), F.col("s")))


@query("scr_severity", ALL_VIEWS + SCORED_SQL + " SELECT seq, outcome, score FROM scored")
def scr_severity(spark, d):
    return scored(spark, d).select("seq", "outcome", "score")


@query("scr_rho", ALL_VIEWS + SCORED_SQL + " SELECT seq, rho FROM scored")
def scr_rho(spark, d):
    return scored(spark, d).select("seq", "rho")


@query("scr_kappa", ALL_VIEWS + SCORED_SQL + " SELECT seq, kappa FROM scored")
def scr_kappa(spark, d):
    return scored(spark, d).select("seq", "kappa")


@query("scr_bucket", ALL_VIEWS + SCORED_SQL + f" SELECT {BUCKET_SQL} AS bucket, count(*) AS n FROM scored GROUP BY 1")
def scr_bucket(spark, d):
    return scored(spark, d).groupBy(S.bucket(F.col("score")).alias("bucket")).agg(F.count("*").alias("n"))


@query("scr_behaviour", """SELECT event_id AS seq, CAST(least(59, floor(100 * least(1.0::DOUBLE, 0.6::DOUBLE * (CASE WHEN event_id % 3 = 0 THEN 1.0::DOUBLE ELSE CAST('0.' || (user_id % 1000) AS DOUBLE) END) + 0.4::DOUBLE * (0.5::DOUBLE * 0.5::DOUBLE + 0.5::DOUBLE * 0.2::DOUBLE)) + 0.5::DOUBLE + 1e-9::DOUBLE)) AS INTEGER) AS score FROM events""")
def scr_behaviour(spark, d):
    """g is read from a detail text, 1 where there is none."""
    e = V.load(spark, d, "events").selectExpr("event_id AS seq", "CASE WHEN event_id % 3 <> 0 THEN concat('anomaly 0.1234, g_I 0.', user_id % 1000, ' ...') END AS detail")
    return e.select("seq", S.behaviour(S.g_of(F.col("detail")), 0.5 * F.lit(0.5) + 0.5 * F.lit(0.2)).alias("score"))


@query("top_alert_rank", ALL_VIEWS + SCORED_SQL + " SELECT seq, score, row_number() OVER (ORDER BY score DESC, s DESC, t_ns, seq) AS place FROM scored")
def top_alert_rank(spark, d):
    """Every alert's place: score, then unrounded severity, then time."""
    return ordered_places(scored(spark, d).select("seq", "score", "s", "t_ns"), [F.desc("score"), F.desc("s"), "t_ns", "seq"]).select("seq", "score", "place")


@query("att_alert_row", ALL_VIEWS + SCORED_SQL + f""" SELECT 'alr-' || seq AS alert_id, class, subclass, path AS violated_clause, score, {BUCKET_SQL} AS bucket, f_package AS package, depth, 'sha256:' || f_layer AS layer,
 exe || ' > ' || path AS process_chain, digest AS image_digest FROM scored""")
def att_alert_row(spark, d):
    rows = scored(spark, d)
    chain = F.concat_ws(" > ", F.array_compact(F.array("exe", "path")))
    return rows.select(F.concat(F.lit("alr-"), "seq").alias("alert_id"), "class", "subclass", F.col("path").alias("violated_clause"), "score", S.bucket(F.col("score")).alias("bucket"), F.col("f_package").alias("package"), "depth", F.concat(F.lit("sha256:"), "f_layer").alias("layer"), chain.alias("process_chain"), F.col("digest").alias("image_digest"))


@query("gr_process_tree", V.with_views("v_event") + " SELECT DISTINCT exe || ' > ' || path AS process_chain FROM v_event WHERE kind = 'exec'")
def gr_process_tree(spark, d):
    return V.v_event(spark, d).where("kind = 'exec'").select(F.concat_ws(" > ", F.array_compact(F.array("exe", "path"))).alias("process_chain")).distinct()
