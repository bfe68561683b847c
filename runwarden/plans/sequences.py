"""Queries over ordered rows: windows, chains, hash chains, sliding sequences, transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import testviews as V
from ..operators.sequence import chained, chains
from ..operators.windows import COUNTS, behaviour_windows
from .registry import query


def behaviour_input(spark, d):
    """Every event conforms but errors; hours stand for seconds, so that windows hold some events."""
    e = V.v_event(spark, d)
    return e.selectExpr("cid", "pid", "CAST(ppid AS BIGINT) AS ppid", "seq", "t_ns", "kind", "path", "exe", "daddr", "dport", "k >= 60 AS new_file", "NOT (kind = 'cap' AND granted IS NOT DISTINCT FROM false) AS counted")


#: The same windows one after another, each begun where the one before ends. Hours stand for seconds: 30 of them, 8 rows, 10 of age.
WINDOWS_SQL = V.with_views("v_event") + """, c AS (SELECT *, k >= 60 AS new_file, NOT (kind = 'cap' AND granted IS NOT DISTINCT FROM false) AS counted FROM v_event),
 r AS (SELECT cid, pid, seq, 0 AS rank, t_ns, CASE WHEN kind = 'exec' THEN 'birth' ELSE kind END AS what, path, daddr, dport, new_file, counted FROM c
  UNION ALL SELECT cid, ppid, seq, 1, t_ns, 'child', path, daddr, dport, new_file, counted FROM c WHERE kind = 'exec' AND counted),
 e AS (SELECT *, count(*) FILTER (what IN ('birth', 'exit')) OVER p AS ep, max(t_ns) OVER p AS t FROM r WINDOW p AS (PARTITION BY cid, pid ORDER BY seq, rank ROWS UNBOUNDED PRECEDING)),
 f AS (SELECT cid, pid, ep, coalesce(min(seq * 2 + rank) FILTER (what = 'birth'), min(seq * 2 + rank) FILTER (what NOT IN ('birth', 'exit', 'child'))) AS first_place, min(t) AS begins FROM e GROUP BY 1, 2, 3),
 g AS (SELECT f.*, e.t AS first_t, coalesce(lead(begins) OVER (PARTITION BY f.cid, f.pid ORDER BY f.ep), (SELECT max(t_ns) FROM v_event)) AS ends FROM f LEFT JOIN e ON e.cid = f.cid AND e.pid = f.pid AND e.ep = f.ep AND e.seq * 2 + e.rank = f.first_place),
 n AS (SELECT e.*, row_number() OVER (PARTITION BY e.cid, e.pid, e.ep ORDER BY e.seq, e.rank) AS j FROM e JOIN g USING (cid, pid, ep) WHERE e.counted AND what NOT IN ('birth', 'exit') AND e.seq * 2 + e.rank >= g.first_place),
 x AS (SELECT a.cid, a.pid, a.ep, a.j, least(a.j + 8, coalesce((SELECT min(b.j) FROM n b WHERE b.cid = a.cid AND b.pid = a.pid AND b.ep = a.ep AND b.t >= a.t + 108000000000000), 1000000000)) AS nxt FROM n a),
 s AS (SELECT cid, pid, ep, j, nxt FROM x WHERE j = 1 UNION ALL SELECT x.cid, x.pid, x.ep, x.j, x.nxt FROM s JOIN x ON x.cid = s.cid AND x.pid = s.pid AND x.ep = s.ep AND x.j = s.nxt),
 w AS (SELECT s.cid, s.pid, s.ep, s.j, min(n.t) AS start_ns, max(n.t) AS last_t, count(*) AS events, count(*) FILTER (what = 'child') AS exec, count(*) FILTER (what = 'write') AS write, count(*) FILTER (what = 'load') AS load,
  count(*) FILTER (what = 'cap') AS cap, count(*) FILTER (what = 'connect') AS connect, count(DISTINCT path) FILTER (what = 'write' AND new_file) AS new_files, count(DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1)) FILTER (what = 'write') AS dirs_written,
  count(DISTINCT path) FILTER (what = 'child') AS distinct_exes, count(DISTINCT daddr) FILTER (what = 'connect') AS distinct_daddrs, count(DISTINCT dport) FILTER (what = 'connect') AS distinct_dports
  FROM s JOIN n ON n.cid = s.cid AND n.pid = s.pid AND n.ep = s.ep AND n.j >= s.j AND n.j < s.nxt GROUP BY 1, 2, 3, 4),
 o AS (SELECT w.*, CASE WHEN events >= 8 THEN 'count' WHEN ends >= start_ns + 108000000000000 THEN 'time' END AS closed_by, CASE WHEN events >= 8 THEN last_t ELSE start_ns + 108000000000000 END AS end_ns, first_t,
  CASE WHEN events >= 8 THEN greatest((last_t - start_ns) / 1e9::DOUBLE, 1.0::DOUBLE) ELSE 108000.0::DOUBLE END AS span FROM w JOIN g USING (cid, pid, ep)),
 q AS (SELECT *, end_ns - first_t AS age_ns FROM o WHERE closed_by IS NOT NULL AND end_ns - first_t >= 36000000000000)"""
FEATURES_SQL = ", ".join(f"{c}::DOUBLE AS {c}, round({c} / span, 6) AS {c}_per_s" for c in COUNTS)


@query("win_behaviour", WINDOWS_SQL + " SELECT cid, pid, start_ns, end_ns, events, closed_by FROM q")
def win_behaviour(spark, d):
    hour = 3_600_000_000_000
    return behaviour_windows(behaviour_input(spark, d), 30 * hour, 8, 10 * hour).select("cid", "pid", "start_ns", "end_ns", "events", "closed_by")


@query("win_features", WINDOWS_SQL + f" SELECT cid, pid, start_ns, end_ns, events, closed_by, age_ns, {FEATURES_SQL} FROM q")
def win_features(spark, d):
    hour = 3_600_000_000_000
    return behaviour_windows(behaviour_input(spark, d), 30 * hour, 8, 10 * hour)


@query("win_behaviour_gate", V.with_views("v_event") + " SELECT kind, count(*) FILTER (NOT (kind = 'cap' AND granted IS NOT DISTINCT FROM false)) AS entered, count(*) AS n FROM v_event GROUP BY 1")
def win_behaviour_gate(spark, d):
    return behaviour_input(spark, d).groupBy("kind").agg(F.count_if("counted").alias("entered"), F.count("*").alias("n"))


@query("win_chain")
def win_chain(spark, d):
    """Detections of a container chained by pid or parent within 60 minutes of each other."""
    e = V.v_event(spark, d).where("kind = 'exec'")
    return chains(e.selectExpr("cid AS container_id", "seq AS id", "t_ns / 6e10 AS t_s", "pid", "ppid"))


@query("win_split_chrono", V.with_views("v_event") + ", n AS (SELECT digest, count(*) AS n FROM v_event GROUP BY 1) SELECT seq, digest, row_number() OVER (PARTITION BY digest ORDER BY t_ns, cid, pid, seq) <= floor(0.7::DOUBLE * n) AS train FROM v_event JOIN n USING (digest)")
def win_split_chrono(spark, d):
    e = V.v_event(spark, d)
    n = e.groupBy("digest").agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy("digest").orderBy("t_ns", "cid", "pid", "seq"))
    return e.withColumn("nth", nth).join(n, "digest").select("seq", "digest", (F.col("nth") <= F.floor(0.7 * F.col("n"))).alias("train"))


TRACE_SQL = "WITH RECURSIVE t AS (SELECT conv_id AS trace, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, length(text) AS len, left(role, 1) AS cat, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)"


def traces(spark, d):
    w = Window.partitionBy("conv_id")
    c = V.load(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("trace"), "turn", F.row_number().over(w.orderBy("turn")).alias("rn"), F.length("text").alias("len"), F.left("role", F.lit(1)).alias("cat"), F.count("*").over(w).alias("n"))


@query("win_seq_sliding", TRACE_SQL + " SELECT trace, s AS start, count(*) AS calls FROM t, (SELECT unnest(generate_series(0, 200, 2)) AS s) WHERE (s <= n - 4 OR s = 0) AND rn > s AND rn <= s + 4 GROUP BY 1, 2")
def win_seq_sliding(spark, d):
    """Windows of four turns, stride two; a shorter trace is one window. A row belongs to a few windows, which it is repeated for."""
    rows = traces(spark, d)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("n") - 4), F.lit(2)), lambda s: (F.col("rn") > s) & (F.col("rn") <= s + 4))
    return rows.select("trace", F.explode(starts).alias("start")).groupBy("trace", "start").agg(F.count("*").alias("calls"))


@query("win_seq_features", TRACE_SQL + ", l AS (SELECT *, len - lag(len) OVER (PARTITION BY trace ORDER BY turn) AS delta FROM t) SELECT trace, count(*) FILTER (cat = 'u') / count(*) AS f_u, count(*) FILTER (cat = 'a') / count(*) AS f_a, avg(CASE WHEN delta IS NOT NULL THEN greatest(delta, 0) END) AS mean_d, stddev_pop(CASE WHEN delta IS NOT NULL THEN greatest(delta, 0) END) AS std_d, max(CASE WHEN delta IS NOT NULL THEN greatest(delta, 0) END) AS max_d FROM l GROUP BY 1")
def win_seq_features(spark, d):
    delta = F.col("len") - F.lag("len").over(Window.partitionBy("trace").orderBy("turn"))
    rows = traces(spark, d).withColumn("delta", F.when(delta.isNotNull(), F.greatest(delta, F.lit(0))))
    share = lambda c: (F.count_if(F.col("cat") == c) / F.count("*")).alias(f"f_{c}")
    return rows.groupBy("trace").agg(share("u"), share("a"), F.avg("delta").alias("mean_d"), F.stddev_pop("delta").alias("std_d"), F.max("delta").alias("max_d"))


@query("win_first_violation", V.with_views("v_event") + " SELECT cid, min(seq) AS seq, arg_min(pid, seq) AS pid, arg_min(path, seq) AS path FROM v_event WHERE k % 5 <> 0 AND kind = 'exec' GROUP BY 1")
def win_first_violation(spark, d):
    """The first event outside an allow list of calls."""
    e = V.v_event(spark, d).where("kind = 'exec'")
    allowed = e.where("k % 5 = 0").select("k").distinct()
    first = e.join(allowed, "k", "left_anti").groupBy("cid").agg(F.min_by(F.struct("seq", "pid", "path"), "seq").alias("x"))
    return first.select("cid", "x.*")


@query("win_newest_statement", "SELECT c_nationkey AS digest, arg_max(c_custkey, (CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END) * 1e12 + (CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey % 50 END) * 1e8 + c_custkey) AS line FROM customer GROUP BY 1")
def win_newest_statement(spark, d):
    """A timed statement beats one without; then the later time; then the later line."""
    c = V.load(spark, d, "customer").selectExpr("c_nationkey AS digest", "c_custkey AS line", "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 50 END AS ts")
    return c.groupBy("digest").agg(F.max_by("line", F.struct(F.col("ts").isNotNull(), F.coalesce("ts", F.lit(-1)), "line")).alias("line"))


#: The predicate type of a signature's statement.
SIGN_V1 = "https://sigstore.dev/cosign/sign/v1"
#: A member named logIndex or log_index whose value is a whole number or a string of digits. Quotes within strings are escaped in JSON, so what follows a brace or
#: comma and an unescaped quote is a member's name; members stand in the text in the order of a depth-first walk.
LOG_INDEX = r'[{,]\s*"(?:logIndex|log_index)"\s*:\s*("?)([0-9]+)\1\s*(?=[,}])'


def log_index(doc: Column) -> Column:
    """The first log index of a JSON text, depth-first in document order; null for none, and for texts that are no JSON."""
    found = F.regexp_extract(doc, LOG_INDEX, 2)
    return F.when(F.try_parse_json(doc).isNotNull() & (found != ""), found.try_cast("bigint"))


def signature_index(bundles: DataFrame) -> DataFrame:
    """(image, log_index) of bundles (image, line, bundle): the entry of the newest signature that binds to the image; of equal times the last line."""
    entry = "struct<verificationMaterial: struct<tlogEntries: array<struct<logIndex: string, integratedTime: string>>>, dsseEnvelope: struct<payload: string>>"
    statement = "struct<predicateType: string, subject: array<struct<digest: struct<sha256: string>>>>"
    number = lambda c: F.when(c.rlike("^[0-9]+$"), c.try_cast("bigint"))
    rows = bundles.select("image", "line", F.from_json("bundle", entry).alias("b"))
    signed = F.from_json(F.try_to_binary("b.dsseEnvelope.payload", F.lit("base64")).cast("string"), statement)
    first = F.get("b.verificationMaterial.tlogEntries", F.lit(0))
    rows = rows.select("image", "line", signed.alias("s"), number(first["logIndex"]).alias("log_index"), F.coalesce(number(first["integratedTime"]), F.lit(-1)).alias("time"))
    rows = rows.where((F.col("s.predicateType") == SIGN_V1) & F.exists("s.subject", lambda x: x["digest"]["sha256"] == F.col("image")) & F.col("log_index").isNotNull())
    return rows.groupBy("image").agg(F.max_by("log_index", F.struct("time", "line")).alias("log_index"))


@query(
    "prj_log_index",
    "WITH s AS (SELECT o_custkey AS k, arg_max(o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE year(o_orderdate) END * 10000000000 + o_orderkey) AS i FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 7 <> 0 GROUP BY 1) "
    "SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN c_custkey * 10 WHEN 1 THEN c_custkey WHEN 3 THEN 7 WHEN 4 THEN c_custkey + 1 ELSE s.i END AS log_index FROM customer LEFT JOIN s ON s.k = c_custkey",
)
def prj_log_index(spark, d):
    """The provenance document's own index, else that of the image's newest signature bundle."""
    doc = """CASE c_custkey % 6 WHEN 0 THEN concat('{"logIndex": ', c_custkey * 10, '}') WHEN 1 THEN concat('{"v": 1.5, "log_index" : "', c_custkey, '"}')
 WHEN 2 THEN '{"logIndex": true, "log_index": -4, "x": {"logIndex": 4.5}}' WHEN 3 THEN '{"v": [1, {"a": {"logIndex": 7}}], "logIndex": 8}'
 WHEN 4 THEN concat('{"logIndex": "x", "z": {"b": [[{"logIndex": ', c_custkey + 1, '}]]}, "a": {"logIndex": 9}}') ELSE '{"note": "{\\\\"logIndex\\\\": 5}"}' END AS doc"""
    rows = V.load(spark, d, "customer").selectExpr("c_custkey", doc)
    statement = f"""concat('{{"predicateType": "', CASE WHEN o_orderkey % 3 = 0 THEN 'other' ELSE '{SIGN_V1}' END, '", "subject": [{{"digest": {{"sha256": "', CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE '' END, o_custkey, '"}}}}]}}')"""
    time = """CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat(', "integratedTime": "', year(o_orderdate), '"') END"""
    bundle = f"""concat('{{"verificationMaterial": {{"tlogEntries": [{{"inclusionProof": {{"logIndex": "1"}}, "logIndex": "', o_orderkey, '"', {time}, '}}]}}, "dsseEnvelope": {{"payload": "', translate(base64({statement}), concat(chr(13), chr(10)), ''), '"}}}}')"""
    bundles = V.load(spark, d, "orders").selectExpr("CAST(o_custkey AS STRING) AS image", "o_orderkey AS line", f"{bundle} AS bundle")
    signed = signature_index(bundles).withColumnRenamed("log_index", "signed")
    rows = rows.join(signed, F.col("c_custkey").cast("string") == F.col("image"), "left")
    return rows.select("c_custkey", F.coalesce(log_index(F.col("doc")), "signed").alias("log_index"))


@query("win_transition", V.with_views("v_event") + ", t AS (SELECT seq, cid, kind <> 'cap' AS trusted, lag(kind <> 'cap', 1, true) OVER (PARTITION BY cid ORDER BY seq) AS before FROM v_event) SELECT seq, cid FROM t WHERE before AND NOT trusted")
def win_transition(spark, d):
    """Alerts on the flip from trusted to untrusted only; the state before the first is trusted."""
    trusted = F.col("kind") != "cap"
    e = V.v_event(spark, d).select("seq", "cid", trusted.alias("trusted"), F.lag(trusted, 1, True).over(Window.partitionBy("cid").orderBy("seq")).alias("before"))
    return e.where("before and not trusted").select("seq", "cid")


CHAIN_SQL = """WITH RECURSIVE r AS (SELECT conv_id AS log, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, sha256(text) AS c FROM conversations),
h AS (SELECT log, k, sha256(unhex(repeat('0', 64) || c)) AS hash FROM r WHERE k = 1 UNION ALL SELECT r.log, r.k, sha256(unhex(h.hash || r.c)) FROM r JOIN h ON r.log = h.log AND r.k = h.k + 1)"""


def hash_chain(records, log: str, k: str, canon: str):
    """(log, k, hash): texts are hashed in parallel; only their digests are folded, per log, as they stream by in order."""
    digest = records.select(F.col(log).cast("long").alias("log"), F.col(k).cast("long").alias("place"), F.sha2(F.col(canon), 256).alias("c"))
    return chained(digest).select("log", "k", "hash")


@query("win_hash_chain", CHAIN_SQL + " SELECT log, k, hash FROM h")
def win_hash_chain(spark, d):
    return hash_chain(V.load(spark, d, "conversations"), "conv_id", "turn", "text")


def verify_chain(entries):
    """(log, first_bad): entries (log, line, k, prev, hash, canon) are checked in parallel, each against the line before it."""
    before = entries.select("log", (F.col("line") + 1).alias("line"), F.col("hash").alias("stored"))
    rows = entries.join(before, ["log", "line"], "left")
    own = F.sha2(F.concat(F.unhex("prev"), F.unhex(F.sha2("canon", 256))), 256)
    bad = (F.col("k") != F.col("line")) | (F.col("prev") != F.coalesce("stored", F.repeat(F.lit("0"), 64))) | (F.col("hash") != own)
    return rows.groupBy("log").agg(F.min(F.when(F.coalesce(bad, F.lit(True)), F.col("line"))).alias("first_bad"))


@query("win_chain_verify", "SELECT conv_id AS log, CASE WHEN conv_id % 3 = 0 AND count(*) >= 3 THEN 3 WHEN conv_id % 3 = 1 AND count(*) >= 2 THEN 2 END AS first_bad FROM conversations GROUP BY 1")
def win_chain_verify(spark, d):
    """Every third log has its third text changed, every other third its second record renumbered."""
    c = V.load(spark, d, "conversations")
    numbered = c.select(F.col("conv_id").alias("log"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("line"), F.col("text").alias("canon"))
    h = hash_chain(c, "conv_id", "turn", "text").withColumnRenamed("k", "line")
    e = numbered.join(h, ["log", "line"])
    e = e.join(h.select("log", (F.col("line") + 1).alias("line"), F.col("hash").alias("prev")), ["log", "line"], "left").withColumn("prev", F.coalesce("prev", F.repeat(F.lit("0"), 64)))
    changed = F.when((F.col("log") % 3 == 0) & (F.col("line") == 3), F.concat("canon", F.lit("!"))).otherwise(F.col("canon"))
    k = F.when((F.col("log") % 3 == 1) & (F.col("line") == 2), F.lit(9)).otherwise(F.col("line"))
    return verify_chain(e.select("log", "line", k.alias("k"), "prev", "hash", changed.alias("canon")))


@query("win_checkpoint_audit", CHAIN_SQL + ", m AS (SELECT log, max(k) AS n FROM h GROUP BY 1), c AS (SELECT m.log, s.k, h.hash IS NOT NULL AND NOT (m.log % 4 = 0 AND s.k = 4) AS ok FROM m JOIN (SELECT unnest(generate_series(2, 100, 2)) AS k) s ON s.k <= m.n LEFT JOIN h ON h.log = m.log AND h.k = s.k) SELECT log, coalesce(max(k) FILTER (ok AND k < coalesce(f, 1000)), 0) + 1 AS first_bad FROM (SELECT *, min(k) FILTER (NOT ok) OVER (PARTITION BY log) AS f FROM c) WHERE f IS NOT NULL GROUP BY 1")
def win_checkpoint_audit(spark, d):
    """A checkpoint is due every second record; log%4=0 signed another hash at 4. The first bad record follows the last good checkpoint."""
    h = hash_chain(V.load(spark, d, "conversations"), "conv_id", "turn", "text")
    signed = h.where("k % 2 = 0").select("log", "k", F.when((F.col("log") % 4 == 0) & (F.col("k") == 4), "other").otherwise(F.col("hash")).alias("signed"))
    due = h.groupBy("log").agg(F.max("k").alias("n")).where("n >= 2").select("log", F.explode(F.sequence(F.lit(2), F.col("n"), F.lit(2))).alias("k"))
    rows = due.join(signed, ["log", "k"], "left").join(h, ["log", "k"], "left").withColumn("ok", F.coalesce(F.col("signed") == F.col("hash"), F.lit(False)))
    rows = rows.withColumn("f", F.min(F.when(~F.col("ok"), F.col("k"))).over(Window.partitionBy("log"))).where("f is not null")
    return rows.groupBy("log").agg((F.coalesce(F.max(F.when(F.col("ok") & (F.col("k") < F.col("f")), F.col("k"))), F.lit(0)) + 1).alias("first_bad"))


@query("win_cold_start", V.with_views("v_event", "v_binding") + ", r AS (SELECT container_id AS cid, (epoch_us(TIMESTAMP '2024-01-01') + CAST(substr(container_id, 2) AS BIGINT) % 48 * 3600000000) * 1000 AS ready_ns FROM v_binding) SELECT cid, min(t_ns) AS first_ns, min(ready_ns) AS ready_ns, count(*) AS held, (min(ready_ns) - min(t_ns)) / 1e9 AS window_s FROM v_event JOIN r USING (cid) WHERE t_ns < ready_ns GROUP BY 1")
def win_cold_start(spark, d):
    """Per container: the first event held before its specification was ready (here the first two days, by the container's number), how many, and for how long."""
    start = V.MICROS.format("TIMESTAMP_NTZ'2024-01-01 00:00:00'")
    b = V.v_binding(spark, d).selectExpr("container_id AS cid", f"({start} + CAST(substr(container_id, 2) AS BIGINT) % 48 * 3600000000) * 1000 AS ready_ns")
    held = V.v_event(spark, d).join(b, "cid").where("t_ns < ready_ns")
    return held.groupBy("cid").agg(F.min("t_ns").alias("first_ns"), F.min("ready_ns").alias("ready_ns"), F.count("*").alias("held"), ((F.min("ready_ns") - F.min("t_ns")) / F.lit(1e9)).alias("window_s"))


@query("win_layer_of", V.with_views("v_file") + " SELECT digest, 'pkg' || (k % 9) AS path, arg_max(layer, layer * 1000 + k) AS layer FROM v_file GROUP BY 1, 2")
def win_layer_of(spark, d):
    """The highest layer that has the path."""
    f = V.v_file(spark, d)
    return f.groupBy("digest", F.concat(F.lit("pkg"), F.col("k") % 9).alias("path")).agg(F.max("layer").alias("layer"))
