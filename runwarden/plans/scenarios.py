"""Queries that hold alerts against labelled scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import testviews as V
from .registry import query

RANKS = ("critical", "high", "medium", "low")


def bucket_rank(b: Column) -> Column:
    """Unknown buckets rank last."""
    out = F.lit(len(RANKS))
    for i, name in enumerate(RANKS):
        out = F.when(F.lower(F.trim(b)) == name, i).otherwise(out)
    return out


def scenario_candidates(truth: DataFrame, alerts: DataFrame) -> DataFrame:
    """Pairs of runs and alerts of one namespace, pod prefix and bin of time, by one join on equal keys.

    An alert is looked up once for each length of prefix that occurs (names of pods are bounded, and so are their lengths); bins are as wide as the median run, so that a run is in two bins or so, and most of
    what meets in a bin belongs together.
    """
    runs = truth.where("pod_prefix <> ''")
    found = runs.agg(F.collect_set(F.length("pod_prefix")).alias("lengths"), F.percentile_approx(V.micros("stop") - V.micros("start"), 0.5).alias("median")).first()
    width = max(found["median"] or 0, 3_600_000_000)
    floor = lambda c: F.floor(V.micros(c) / width)
    t = runs.withColumn("bin", F.explode(F.sequence(floor("start"), floor("stop"))))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, sorted(found["lengths"]))).cast("array<int>"), lambda n: n <= F.length("pod")), lambda n: F.left("pod", n))
    a = alerts.withColumn("bin", floor("time")).withColumn("prefix", F.explode(prefixes))
    return t.join(a, (t.namespace == a.ns) & (t.pod_prefix == a.prefix) & (t.bin == a.bin)).drop(t.bin).drop(a.bin).drop("prefix")


def scenario_join(truth: DataFrame, alerts: DataFrame) -> DataFrame:
    """truth joined with its alerts: namespace equal, pod prefix (not empty), closed interval."""
    return scenario_candidates(truth, alerts).where("time >= start and time <= stop")


MATCH = "a.ns = t.namespace AND t.pod_prefix <> '' AND starts_with(a.pod, t.pod_prefix) AND a.time >= t.start AND a.time <= t.stop"
VIEWS = V.with_views("v_truth", "v_alert")
RANK_SQL = "CASE a.bucket WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"


def hits(spark, d):
    return scenario_join(V.v_truth(spark, d), V.v_alert(spark, d))


@query("join_scenario", VIEWS + f" SELECT t.line, a.alert_id FROM v_truth t JOIN v_alert a ON {MATCH}")
def join_scenario(spark, d):
    return hits(spark, d).select("line", "alert_id")


@query("pred_in_scenario", VIEWS + f" SELECT a.alert_id, a.class FROM v_alert a WHERE EXISTS (SELECT 1 FROM v_truth t WHERE {MATCH})")
def pred_in_scenario(spark, d):
    a = V.v_alert(spark, d)
    return a.join(hits(spark, d).select(*a.columns).distinct(), a.columns, "left_semi").select("alert_id", "class")


ROWS_SQL = VIEWS + f""", m AS (SELECT t.line, a.class, {RANK_SQL} AS r FROM v_truth t JOIN v_alert a ON {MATCH}),
rows_ AS (SELECT t.line, t.scenario, t.label, count(m.line) AS alerts, min(r) AS top, coalesce(bool_or(r < 3), false) AS detected, coalesce(bool_or(r < 3 AND class <> 'D_cap'), false) AS detected_no_cap, coalesce(bool_or(class = 'trust'), false) AS tool
 FROM v_truth t LEFT JOIN m ON m.line = t.line GROUP BY 1, 2, 3)"""


def scenario_rows(spark, d) -> DataFrame:
    t = V.v_truth(spark, d)
    r = bucket_rank(F.col("bucket"))
    m = hits(spark, d).groupBy("line").agg(
        F.count("*").alias("alerts"), F.min(r).alias("top"), F.bool_or(r < 3).alias("detected"), F.bool_or((r < 3) & (F.col("class") != "D_cap")).alias("detected_no_cap"), F.bool_or(F.col("class") == "trust").alias("tool")
    )
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return t.join(m, "line", "left").select("line", "scenario", "label", F.coalesce("alerts", F.lit(0)).alias("alerts"), "top", no("detected"), no("detected_no_cap"), no("tool"))


@query("agg_scenario_rows", ROWS_SQL + " SELECT * FROM rows_")
def agg_scenario_rows(spark, d):
    return scenario_rows(spark, d)


@query("pred_detected", ROWS_SQL + " SELECT line, detected, tool FROM rows_")
def pred_detected(spark, d):
    return scenario_rows(spark, d).select("line", "detected", "tool")


LONG_SQL = ROWS_SQL + """, long_ AS (SELECT line, scenario, label, 'ours' AS system, detected AS hit FROM rows_ UNION ALL SELECT line, scenario, label, 'ours_no_cap', detected_no_cap FROM rows_ UNION ALL SELECT line, scenario, label, 'tool', tool FROM rows_)"""
COUNTS = "count(*) FILTER (label = 'malicious' AND hit) AS tp, count(*) FILTER (label <> 'malicious' AND hit) AS fp, count(*) FILTER (label = 'malicious' AND NOT hit) AS fn, count(*) FILTER (label <> 'malicious' AND NOT hit) AS tn"


def by_system(rows: DataFrame) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(n).alias("system"), F.col(c).alias("hit")) for n, c in (("ours", "detected"), ("ours_no_cap", "detected_no_cap"), ("tool", "tool"))))
    return rows.select("line", "scenario", "label", F.inline(pairs))


def confusion(long_: DataFrame, *keys: str) -> DataFrame:
    """TP, FP, FN and TN; every label but malicious counts as benign."""
    bad, hit = F.col("label") == "malicious", F.col("hit")
    return long_.groupBy(*keys).agg(F.count_if(bad & hit).alias("tp"), F.count_if(~bad & hit).alias("fp"), F.count_if(bad & ~hit).alias("fn"), F.count_if(~bad & ~hit).alias("tn"))


@query("agg_confusion", LONG_SQL + f" SELECT system, {COUNTS} FROM long_ GROUP BY 1")
def agg_confusion(spark, d):
    return confusion(by_system(scenario_rows(spark, d)), "system")


def half_even(x: Column, places: int = 4) -> Column:
    return F.bround(x, places)


def metrics(c: DataFrame) -> DataFrame:
    """Null where a denominator is zero; F1 is taken of the rounded precision and recall."""
    n = lambda x: F.nullif(x, F.lit(0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    c = c.withColumn("precision", half_even(tp / n(tp + fp))).withColumn("recall", half_even(tp / n(tp + fn)))
    p, r = F.col("precision"), F.col("recall")
    f1 = F.when(p + r > 0, half_even(2 * p * r / (p + r)))
    return c.withColumn("f1", f1).withColumn("fpr", half_even(fp / n(fp + tn))).withColumn("accuracy", half_even((tp + tn) / n(tp + fp + fn + tn)))


METRICS_SQL = """ SELECT *, CASE WHEN precision + recall > 0 THEN round_even(2 * precision * recall / (precision + recall), 4) END AS f1 FROM (SELECT *, round_even(tp / nullif(tp + fp, 0), 4) AS precision, round_even(tp / nullif(tp + fn, 0), 4) AS recall,
 round_even(fp / nullif(fp + tn, 0), 4) AS fpr, round_even((tp + tn) / nullif(tp + fp + fn + tn, 0), 4) AS accuracy FROM c)"""


@query("agg_metrics", LONG_SQL + f", c AS (SELECT system, {COUNTS} FROM long_ GROUP BY 1)" + METRICS_SQL)
def agg_metrics(spark, d):
    return metrics(confusion(by_system(scenario_rows(spark, d)), "system"))


@query("agg_scoring_matrix", LONG_SQL + f""", s AS (SELECT *, unnest(CASE WHEN scenario = '1-URGENT' THEN ['all'] ELSE ['all', 'runtime'] END) AS scope FROM long_ WHERE scenario <> '3-MEDIUM')
 SELECT scope, system, {COUNTS}, count(DISTINCT scenario) AS scenarios FROM s GROUP BY 1, 2""")
def agg_scoring_matrix(spark, d):
    """Two scopes in one pass: trust scenarios (here 1-URGENT) are left out of `runtime`; 3-MEDIUM is never counted."""
    long_ = by_system(scenario_rows(spark, d)).where("scenario <> '3-MEDIUM'")
    scopes = F.when(F.col("scenario") == "1-URGENT", F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("runtime")))
    long_ = long_.withColumn("scope", F.explode(scopes))
    n = long_.groupBy("scope", "system").agg(F.count_distinct("scenario").alias("scenarios"))
    return confusion(long_, "scope", "system").join(n, ["scope", "system"])


@query("agg_comparison", LONG_SQL + " SELECT scenario, system, count(*) FILTER (hit) AS detected, count(*) AS runs FROM long_ GROUP BY 1, 2")
def agg_comparison(spark, d):
    return by_system(scenario_rows(spark, d)).groupBy("scenario", "system").agg(F.count_if("hit").alias("detected"), F.count("*").alias("runs"))


@query("agg_stage", ROWS_SQL + " SELECT line, CASE WHEN scenario = '1-URGENT' THEN 'admission' WHEN tool THEN 'trust' WHEN detected THEN 'runtime' END AS stage FROM rows_")
def agg_stage(spark, d):
    return scenario_rows(spark, d).select("line", F.when(F.col("scenario") == "1-URGENT", "admission").when(F.col("tool"), "trust").when(F.col("detected"), "runtime").alias("stage"))


@query("agg_known_unknown_recall", ROWS_SQL + " SELECT scenario IN ('1-URGENT', '2-HIGH') AS known, sum(CASE WHEN detected THEN 1 ELSE 0 END) / count(*) AS recall FROM rows_ WHERE label = 'malicious' GROUP BY 1")
def agg_known_unknown_recall(spark, d):
    rows = scenario_rows(spark, d).where("label = 'malicious'")
    return rows.groupBy(F.col("scenario").isin("1-URGENT", "2-HIGH").alias("known")).agg((F.sum(F.col("detected").cast("int")) / F.count("*")).alias("recall"))


@query("agg_c2_metrics", LONG_SQL + f", c AS (SELECT system, {COUNTS} FROM long_ WHERE scenario <> '1-URGENT' OR label = 'benign' GROUP BY 1) SELECT system, round_even(tp / nullif(tp + fn, 0), 4) AS recall, round_even(fp / nullif(fp + tn, 0), 4) AS fpr FROM c")
def agg_c2_metrics(spark, d):
    """Recall and FPR over runtime and benign runs."""
    long_ = by_system(scenario_rows(spark, d)).where("scenario <> '1-URGENT' or label = 'benign'")
    return metrics(confusion(long_, "system")).select("system", "recall", "fpr")


@query("agg_heatmap", LONG_SQL + " SELECT scenario, system, sum(CASE WHEN hit THEN 1 ELSE 0 END) / count(*) AS share FROM long_ GROUP BY 1, 2")
def agg_heatmap(spark, d):
    return by_system(scenario_rows(spark, d)).groupBy("scenario", "system").agg((F.sum(F.col("hit").cast("int")) / F.count("*")).alias("share"))


@query("agg_outcome_cell", LONG_SQL + f", c AS (SELECT scenario, system, {COUNTS} FROM long_ GROUP BY 1, 2) SELECT scenario, system, CASE WHEN tp + fp + fn + tn = 0 THEN 'na' WHEN fp + fn = 0 THEN 'right' WHEN tp + tn = 0 THEN 'wrong' ELSE 'partial' END AS cell FROM c")
def agg_outcome_cell(spark, d):
    c = confusion(by_system(scenario_rows(spark, d)), "scenario", "system")
    return c.select("scenario", "system", F.when(F.expr("tp + fp + fn + tn = 0"), "na").when(F.expr("fp + fn = 0"), "right").when(F.expr("tp + tn = 0"), "wrong").otherwise("partial").alias("cell"))


@query("pred_in_image_alert", VIEWS + " SELECT alert_id, class IN ('D_exec', 'D_write') AND bucket NOT IN ('odd', 'low') AS in_image FROM v_alert")
def pred_in_image_alert(spark, d):
    return V.v_alert(spark, d).select("alert_id", (F.col("class").isin("D_exec", "D_write") & ~F.col("bucket").isin("odd", "low")).alias("in_image"))


@query("agg_attribution_share", VIEWS + f""", m AS (SELECT DISTINCT a.* FROM v_truth t JOIN v_alert a ON {MATCH} WHERE t.label = 'malicious' AND a.bucket IN ('critical', 'high', 'medium'))
 SELECT avg(CASE WHEN l_partkey % 3 > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS process, avg(CASE WHEN l_suppkey % 4 > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (class IN ('D_exec', 'D_write')) AS layer, count(*) AS n FROM m""")
def agg_attribution_share(spark, d):
    """Share of medium or higher alerts in attack intervals that name a field; a layer is asked of in-image alerts only."""
    rows = hits(spark, d).where("label = 'malicious' and bucket in ('critical', 'high', 'medium')").select("alert_id", "class", "l_partkey", "l_suppkey").distinct()
    in_image = F.col("class").isin("D_exec", "D_write")
    return rows.agg(F.avg((F.col("l_partkey") % 3 > 0).cast("double")).alias("process"), F.avg(F.when(in_image, (F.col("l_suppkey") % 4 > 0).cast("double"))).alias("layer"), F.count("*").alias("n"))


@query("agg_trust_matrix", LONG_SQL + ", st AS (SELECT scenario, CASE WHEN tool THEN 'trust' WHEN detected THEN 'runtime' ELSE 'none' END AS stage FROM rows_), r AS (SELECT scenario, stage, row_number() OVER (PARTITION BY scenario ORDER BY count(*) DESC, stage) AS k FROM st GROUP BY 1, 2) SELECT l.scenario, count(*) FILTER (hit AND system = 'ours') AS ours, count(*) FILTER (hit AND system = 'tool') AS tool, min(r.stage) AS stage FROM long_ l JOIN r ON r.scenario = l.scenario AND r.k = 1 GROUP BY 1")
def agg_trust_matrix(spark, d):
    """Caught per system, and the commonest stage (ties: the least name)."""
    rows = scenario_rows(spark, d)
    stage = F.when(F.col("tool"), "trust").when(F.col("detected"), "runtime").otherwise("none")
    modal = rows.groupBy("scenario", stage.alias("stage")).agg(F.count("*").alias("n")).groupBy("scenario").agg(F.min_by("stage", F.struct(-F.col("n"), "stage")).alias("stage"))
    caught = rows.groupBy("scenario").agg(F.count_if("detected").alias("ours"), F.count_if("tool").alias("tool"))
    return caught.join(modal, "scenario")


@query("join_window_counts", VIEWS + f" SELECT t.line, count(a.alert_id) FILTER (a.class = 'D_exec') AS d_exec, count(a.alert_id) FILTER (a.class = 'D_write') AS d_write, count(a.alert_id) FILTER (a.class = 'trust') AS trust FROM v_truth t LEFT JOIN v_alert a ON {MATCH} GROUP BY 1")
def join_window_counts(spark, d):
    """Alerts by class inside each run; empty runs stay."""
    n = hits(spark, d).groupBy("line").agg(*(F.count_if(F.col("class") == c).alias(a) for c, a in (("D_exec", "d_exec"), ("D_write", "d_write"), ("trust", "trust"))))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return V.v_truth(spark, d).select("line").join(n, "line", "left").select("line", zero("d_exec"), zero("d_write"), zero("trust"))


@query("join_interval_overlap", V.with_views("v_truth") + " SELECT b.line FROM v_truth b WHERE b.label = 'benign' AND EXISTS (SELECT 1 FROM v_truth a WHERE a.label = 'malicious' AND a.namespace = b.namespace AND a.scenario = b.scenario AND b.start < a.stop AND b.stop > a.start)")
def join_interval_overlap(spark, d):
    """Benign runs that overlap an attack of their namespace and scenario; by common days, so keys are equal."""
    t = V.v_truth(spark, d)
    day = lambda c: F.floor(V.micros(c) / 86_400_000_000)
    t = t.withColumn("bin", F.explode(F.sequence(day("start"), day("stop"))))
    a = t.where("label = 'malicious'").select("namespace", "scenario", "bin", F.col("start").alias("a0"), F.col("stop").alias("a1"))
    b = t.where("label = 'benign'")
    hit = b.join(a, ["namespace", "scenario", "bin"]).where("start < a1 and stop > a0")
    return hit.select("line").distinct()


@query("join_trace_to_run", V.with_views("v_truth") + """, tr AS (SELECT o_orderpriority || '-ns' || (o_custkey // 15) || '-' || row_number() OVER (PARTITION BY o_orderpriority, o_custkey // 15 ORDER BY o_orderkey) || '.txt' AS name FROM orders),
 p AS (SELECT name, regexp_extract(name, '^(.*)-([0-9]+)\\.txt$', 1) AS scenario, CAST(regexp_extract(name, '^(.*)-([0-9]+)\\.txt$', 2) AS BIGINT) AS k FROM tr), g AS (SELECT line, scenario || '-' || namespace AS scenario, row_number() OVER (PARTITION BY scenario, namespace ORDER BY line) AS k FROM v_truth)
 SELECT name, line FROM p JOIN g USING (scenario, k)""")
def join_trace_to_run(spark, d):
    """The k-th trace of a scenario in a namespace belongs to its k-th run there."""
    o = V.load(spark, d, "orders").selectExpr("concat(o_orderpriority, '-ns', o_custkey div 15) AS own", "o_orderkey")
    k = F.row_number().over(Window.partitionBy("own").orderBy("o_orderkey"))
    traces = o.select(F.concat("own", F.lit("-"), k, F.lit(".txt")).alias("name"))
    pattern = r"^(.*)-([0-9]+)\.txt$"
    traces = traces.select("name", F.regexp_extract("name", pattern, 1).alias("scenario"), F.regexp_extract("name", pattern, 2).cast("long").alias("k"))
    runs = V.v_truth(spark, d).select("line", F.concat_ws("-", "scenario", "namespace").alias("scenario"))
    runs = runs.select("line", "scenario", F.row_number().over(Window.partitionBy("scenario").orderBy("line")).cast("long").alias("k"))
    return traces.join(runs, ["scenario", "k"]).select("name", "line")


@query("join_snapshot_asof", V.with_views("v_truth") + " SELECT t.line, count(c.c_custkey) AS bindings FROM v_truth t LEFT JOIN (SELECT c_custkey, 'ns' || (c_custkey // 15) AS ns, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE TIMESTAMP '1995-01-01' + to_days(CAST(c_custkey % 2400 AS INTEGER)) END AS at FROM customer) c ON c.ns = t.namespace AND (c.at IS NULL OR c.at BETWEEN t.start AND t.stop) GROUP BY 1")
def join_snapshot_asof(spark, d):
    """Saved rows count for the run whose interval holds them, live rows (no time) for every run of their namespace: one by bins, the other as a count."""
    c = V.load(spark, d, "customer").selectExpr("concat('ns', c_custkey div 15) AS namespace", "CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE TIMESTAMP_NTZ '1995-01-01' + make_interval(0, 0, 0, CAST(c_custkey % 2400 AS INT)) END AS at")
    t = V.v_truth(spark, d).select("line", "namespace", "start", "stop")
    day = lambda x: F.floor(V.micros(x) / 86_400_000_000)
    saved = t.withColumn("bin", F.explode(F.sequence(day("start"), day("stop")))).join(c.where("at is not null").withColumn("bin", day("at")), ["namespace", "bin"]).where("at between start and stop").groupBy("line").agg(F.count("*").alias("saved"))
    live = c.where("at is null").groupBy("namespace").agg(F.count("*").alias("live"))
    out = t.join(saved, "line", "left").join(live, "namespace", "left")
    return out.select("line", (F.coalesce("saved", F.lit(0)) + F.coalesce("live", F.lit(0))).alias("bindings"))
