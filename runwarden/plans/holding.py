"""Queries of held events: streams of events and of what opens their containers, run in three arrivals from one checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import testviews as V
from ..operators.graph import shared_folder
from ..streaming import hold
from .registry import query

STEPS, HOUR = 3, 3_600_000_000_000
SOURCE = "cid string, seq long, t_ns long, what string"
#: Hours stand for seconds, so that grace periods end between arrivals.
GRACE, TIMEOUT = 30 * HOUR, 300 * HOUR


def arrivals(events: DataFrame, opens: DataFrame, make) -> tuple[DataFrame, str]:
    """(outcomes, checkpoint): events (cid, seq, t_ns) arrive in order of seq in three parts, opens (cid, step) before their part. The stream stops
    after each part and goes on from its checkpoint with the next one."""
    spark = events.sparkSession
    src, out, checkpoint = (shared_folder(spark, n) for n in ("held-events", "held-outcomes", "held-state"))
    most = events.agg(F.max("seq")).first()[0] or 0
    rows = events.select("cid", "seq", "t_ns", F.lit("event").alias("what"), F.least(F.lit(STEPS - 1), F.floor(F.col("seq") * STEPS / (most + 1))).alias("step"))
    got = None
    for step in range(STEPS):
        part = rows.where(F.col("step") == step).drop("step")
        last = part.agg(F.max("t_ns").alias("t_ns"))
        key = opens.where(F.col("step") == step).select("cid", F.lit(-1).cast("long").alias("seq")).crossJoin(F.broadcast(last)).where("t_ns is not null").withColumn("what", F.lit("open"))
        part.unionByName(key.select("cid", "seq", "t_ns", "what")).write.mode("append").parquet(src)
        got = hold.run(make(spark.readStream.schema(SOURCE).parquet(src)), out, checkpoint)
    return got, checkpoint


def steps_sql(events: str, opens: str, grace: int, drop: bool) -> str:
    """The same three arrivals by plain rules: what waits, since when, and what the clock lets expire after each part."""
    sql = f""", ev AS ({events}), op AS ({opens}), es AS (SELECT *, least({STEPS - 1}, seq * {STEPS} // ((SELECT max(seq) FROM ev) + 1)) AS step FROM ev),
 a AS (SELECT cid, step, count(*) AS c, arg_min(t_ns, seq) AS ft, min(seq) AS fs FROM es GROUP BY 1, 2),
 s_0 AS (SELECT cid, false AS opened, 0 AS n, NULL::BIGINT AS f_t, NULL::BIGINT AS f_seq, false AS told, 0 AS released, false AS fire, NULL::BIGINT AS fired_seq, 0 AS fired, false AS again FROM (SELECT DISTINCT cid FROM ev))"""
    for s in range(STEPS):
        sql += f""",
 i_{s + 1} AS (SELECT p.cid, p.told, p.opened OR op.step IS NOT NULL AS opened, p.n + coalesce(a.c, 0) AS n, CASE WHEN p.n > 0 THEN p.f_t ELSE a.ft END AS f_t, CASE WHEN p.n > 0 THEN p.f_seq ELSE a.fs END AS f_seq
  FROM s_{s} p LEFT JOIN a ON a.cid = p.cid AND a.step = {s} LEFT JOIN op ON op.cid = p.cid AND op.step = {s}),
 f_{s + 1} AS (SELECT *, NOT opened AND n > 0 AND {"true" if drop else "NOT told"} AND (f_t + {grace}) // 1000000 <= (SELECT max(t_ns) // 1000000 FROM es WHERE step <= {s}) AS fire FROM i_{s + 1}),
 s_{s + 1} AS (SELECT cid, opened, CASE WHEN opened {"OR fire" if drop else ""} THEN 0 ELSE n END AS n, f_t, f_seq, told OR fire AS told, CASE WHEN opened THEN n ELSE 0 END AS released, fire, f_seq AS fired_seq, n AS fired, told AS again FROM f_{s + 1})"""
    return sql + ", every AS (" + " UNION ALL ".join(f"SELECT * FROM s_{s + 1}" for s in range(STEPS)) + ")"


def bound_events(spark, d):
    return V.v_event(spark, d).select("cid", "seq", "t_ns")


def bindings(spark, d):
    """Bindings come with the part that their container's number says; some never come."""
    b = V.v_binding(spark, d).select(F.col("container_id").alias("cid"), F.expr("CAST(CAST(substr(container_id, 2) AS BIGINT) % 4 AS INT)").alias("step"))
    return b.where(F.col("step") < STEPS)


BOUND_SQL = V.with_views("v_event", "v_binding") + steps_sql("SELECT cid, seq, t_ns FROM v_event", "SELECT container_id AS cid, CAST(substr(container_id, 2) AS BIGINT) % 4 AS step FROM v_binding", GRACE, True)


@query(
    "str_hold_until_bound",
    BOUND_SQL + " SELECT cid, sum(released) AS released, count(*) FILTER (fire AND NOT again) AS unknown_container, max(CASE WHEN fire AND NOT again THEN fired_seq END) AS unknown_seq, coalesce(sum(CASE WHEN fire AND again THEN fired WHEN fire THEN fired - 1 END), 0) AS unbound_events FROM every GROUP BY 1",
)
def str_hold_until_bound(spark, d):
    """Events wait for their container's binding; it comes, or the grace period ends and the container is told of once, with its first event. How many went, failed, and were unbound besides."""
    got, _ = arrivals(bound_events(spark, d), bindings(spark, d), lambda s: hold.until_bound(s, GRACE))
    late = F.col("outcome") == "unknown_container"
    out = got.groupBy("cid").agg(
        F.count_if(F.col("outcome") == "released").alias("released"), F.count_if(late).alias("unknown_container"), F.max(F.when(late, F.col("seq"))).alias("unknown_seq"),
        F.coalesce(F.sum(F.when(late, F.col("n") - 1).when(F.col("outcome") == "unbound_events", F.col("n"))), F.lit(0)).alias("unbound_events"),
    )
    every = bound_events(spark, d).select("cid").distinct().join(out, "cid", "left")
    return every.select("cid", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("released", "unknown_container")), "unknown_seq", F.coalesce("unbound_events", F.lit(0)).alias("unbound_events"))


@query("str_hold_cap", V.with_views("v_event") + " SELECT cid, greatest(count(*) - 30, 0) AS lost, least(count(*), 30) AS held, min(seq) FILTER (nth <= 30) AS first_seq FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY seq DESC) AS nth FROM v_event) GROUP BY 1")
def str_hold_cap(spark, d):
    """At most 30 wait for each container; the oldest are lost, and counted, and the newest are still there at the end."""
    events = bound_events(spark, d)
    got, checkpoint = arrivals(events, events.select("cid", F.lit(0).alias("step")).where("false"), lambda s: hold.until_bound(s, 1 << 60, 30))
    lost = got.where("outcome = 'lost'").groupBy("cid").agg(F.sum("n").alias("lost"))
    left = hold.still_held(spark, checkpoint).groupBy("cid").agg(F.count("*").alias("held"), F.min("seq").alias("first_seq"))
    return left.join(lost, "cid", "left").select("cid", F.coalesce("lost", F.lit(0)).alias("lost"), "held", "first_seq")


VERIFIED_SQL = "SELECT e.cid, e.seq, e.t_ns FROM v_event e JOIN v_binding b ON b.container_id = e.cid WHERE b.verified"
SPECS_SQL = f"SELECT container_id AS cid, CAST(substr(container_id, 2) AS BIGINT) % 3 AS step FROM v_binding WHERE verified AND NOT ({V.NO_ENVELOPE.format('image_digest')})"


def verified(spark, d):
    """Events of verified containers, and when their image's specification comes."""
    b = V.v_binding(spark, d).where("verified").select(F.col("container_id").alias("cid"), "image_digest")
    opens = b.where(f"NOT ({V.NO_ENVELOPE.format('image_digest')})").select("cid", F.expr("CAST(CAST(substr(cid, 2) AS BIGINT) % 3 AS INT)").alias("step"))
    return bound_events(spark, d).join(b.select("cid"), "cid", "left_semi"), opens


@query(
    "str_hold_until_envelope",
    V.with_views("v_event", "v_binding") + steps_sql(VERIFIED_SQL, SPECS_SQL, TIMEOUT, False) + " SELECT cid, sum(released) AS released, count(*) FILTER (fire) AS no_envelope, max(CASE WHEN fire THEN fired_seq END) AS no_envelope_seq, max(CASE WHEN fire THEN fired END) AS waiting FROM every GROUP BY 1",
)
def str_hold_until_envelope(spark, d):
    """Events of verified containers wait for their image's specification, that of every fourth image in vain; a long wait is told of once, and the events wait on."""
    events, opens = verified(spark, d)
    got, _ = arrivals(events, opens, lambda s: hold.until_envelope(s, TIMEOUT))
    late = F.col("outcome") == "no_envelope"
    out = got.groupBy("cid").agg(F.count_if(F.col("outcome") == "released").alias("released"), F.count_if(late).alias("no_envelope"), F.max(F.when(late, F.col("seq"))).alias("no_envelope_seq"), F.max(F.when(late, F.col("n"))).alias("waiting"))
    every = events.select("cid").distinct().join(out, "cid", "left")
    return every.select("cid", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("released", "no_envelope")), "no_envelope_seq", "waiting")


@query("str_close", V.with_views("v_event", "v_binding") + steps_sql(VERIFIED_SQL, SPECS_SQL, TIMEOUT, False) + " SELECT cid, n AS unverified_at_close, f_seq AS first_seq FROM s_3 WHERE n > 0")
def str_close(spark, d):
    """At the end of the stream, what still waits is counted and not verified: it is read from the operator's state."""
    events, opens = verified(spark, d)
    _, checkpoint = arrivals(events, opens, lambda s: hold.until_envelope(s, TIMEOUT))
    return hold.still_held(spark, checkpoint).groupBy("cid").agg(F.count("*").alias("unverified_at_close"), F.min("seq").alias("first_seq"))
