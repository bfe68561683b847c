"""Queries of set algebra over arrays and tables, and of plain aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import testviews as V
from ..operators.ranks import nearest_ranks, quantiles
from .registry import query

ALLOWED = ["CAP_0", "CAP_1", "CAP_2", "CAP_3", "CAP_4", "CAP_5"]
_LIST = "[" + ", ".join(f"'{c}'" for c in ALLOWED) + "]"


def lits(xs) -> Column:
    return F.array(*map(F.lit, xs))


@query("set_cap_infer", f"WITH p AS (SELECT c_custkey, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS j FROM customer), q AS (SELECT c_custkey, 'CAP_' || j AS cap, ((c_custkey * 7 + j * 13) % 100) / 100.0::DOUBLE AS pr, (c_custkey + j) % 5 = 0 AS declared FROM p), r AS (SELECT * FROM q WHERE list_contains({_LIST}, cap) AND (pr >= 0.5 OR declared)) SELECT c_custkey, cap, CASE WHEN declared THEN 'AUTHENTICATED' ELSE 'INFERRED' END AS origin FROM r")
def set_cap_infer(spark, d):
    """Likely capabilities and declared ones, both within what is allowed; declared ones are authenticated."""
    caps = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.struct(F.concat(F.lit("CAP_"), j).alias("cap"), ((F.col("c_custkey") * 7 + j * 13) % 100 / F.lit(100.0)).alias("p"), ((F.col("c_custkey") + j) % 5 == 0).alias("declared")))
    c = V.load(spark, d, "customer").select("c_custkey", caps.alias("caps"))
    likely = F.transform(F.filter("caps", lambda x: x["p"] >= 0.5), lambda x: x["cap"])
    declared = F.transform(F.filter("caps", lambda x: x["declared"]), lambda x: x["cap"])
    c = c.select("c_custkey", F.array_intersect(likely, lits(ALLOWED)).alias("inferred"), F.array_intersect(declared, lits(ALLOWED)).alias("declared"))
    cap = F.explode(F.array_union("inferred", "declared"))
    return c.select("c_custkey", "declared", cap.alias("cap")).select("c_custkey", "cap", F.when(F.array_contains("declared", F.col("cap")), "AUTHENTICATED").otherwise("INFERRED").alias("origin"))


@query("set_cap_effective", f"SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN {_LIST} ELSE list_sort(list_filter(list_distinct(list_concat(CASE WHEN c_custkey % 3 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['CAP_0', 'CAP_1'] END, ['CAP_' || (c_custkey % 6)])), lambda x: x <> 'CAP_' || (c_custkey % 4))) END AS caps FROM customer")
def set_cap_effective(spark, d):
    """Privileged: all. Else the base (none if ALL is dropped), with additions, without drops."""
    c = V.load(spark, d, "customer").select("c_custkey")
    base = F.when(F.col("c_custkey") % 3 == 0, F.array().cast("array<string>")).otherwise(lits(ALLOWED[:2]))
    added = F.array_union(base, F.array(F.concat(F.lit("CAP_"), F.col("c_custkey") % 6)))
    left = F.array_sort(F.array_except(added, F.array(F.concat(F.lit("CAP_"), F.col("c_custkey") % 4))))
    return c.select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, lits(ALLOWED)).otherwise(left).alias("caps"))


@query("set_cap_allowlist", "WITH x AS (SELECT c_nationkey AS image, 'CAP_' || (c_custkey % 3) AS cap FROM customer WHERE c_custkey % 4 = 0 UNION SELECT c_nationkey, 'CAP_BIND' FROM customer WHERE (c_custkey * 17) % 5000 < 1024) SELECT image, list_sort(list(cap)) AS caps FROM x GROUP BY 1")
def set_cap_allowlist(spark, d):
    """What packages are known to need, and binding for ports below 1024."""
    c = V.load(spark, d, "customer")
    known = spark.createDataFrame([("p0", "CAP_0"), ("p4", "CAP_1"), ("p8", "CAP_2")], "package string, cap string")
    named = c.where("c_custkey % 4 = 0").selectExpr("c_nationkey AS image", "concat('p', (c_custkey % 3) * 4) AS package").join(F.broadcast(known), "package").select("image", "cap")
    ports = c.where("c_custkey * 17 % 5000 < 1024").select(F.col("c_nationkey").alias("image"), F.lit("CAP_BIND").alias("cap"))
    return named.union(ports).groupBy("image").agg(F.array_sort(F.collect_set("cap")).alias("caps"))


@query("set_allow_final", "((SELECT DISTINCT l_partkey AS call FROM lineitem UNION SELECT DISTINCT l_suppkey FROM lineitem) INTERSECT SELECT DISTINCT CAST(p_partkey AS BIGINT) FROM part WHERE p_size < 40) EXCEPT (SELECT DISTINCT CAST(s_suppkey AS BIGINT) FROM supplier WHERE s_suppkey % 10 = 3 EXCEPT SELECT DISTINCT p_partkey FROM part WHERE p_size < 5)")
def set_allow_final(spark, d):
    """((static or dynamic) and template) without (blocked without template)."""
    li, p, s = (V.load(spark, d, t) for t in ("lineitem", "part", "supplier"))
    either = li.selectExpr("l_partkey AS call").union(li.select("l_suppkey"))
    blocked = s.where("s_suppkey % 10 = 3").select("s_suppkey").subtract(p.where("p_size < 5").select("p_partkey"))
    return either.intersect(p.where("p_size < 40").select("p_partkey")).subtract(blocked)


@query("set_allow_static", "SELECT DISTINCT p_size AS call FROM part UNION SELECT 99")
def set_allow_static(spark, d):
    return V.load(spark, d, "part").select(F.col("p_size").alias("call")).union(spark.range(1).select(F.lit(99))).distinct()


@query("set_executed", V.with_views("v_event") + " SELECT DISTINCT cid, exe FROM v_event WHERE kind = 'exec'")
def set_executed(spark, d):
    return V.v_event(spark, d).where("kind = 'exec'").select("cid", "exe").distinct()


@query("set_baselines", "WITH r AS (SELECT doc_id % 5 AS fold, 'q' AS label, sum(quality) AS pos, count(*) AS n FROM labels GROUP BY 1 UNION ALL SELECT doc_id % 5, 't', sum(toxic), count(*) FROM labels GROUP BY 1) SELECT fold, label FROM r WHERE 2 * pos > n")
def set_baselines(spark, d):
    """Labels that more than half of a fold's rows have."""
    l = V.load(spark, d, "labels").select((F.col("doc_id") % 5).alias("fold"), F.inline(F.array(F.struct(F.lit("q").alias("label"), F.col("quality").alias("y")), F.struct(F.lit("t").alias("label"), F.col("toxic").alias("y")))))
    return l.groupBy("fold", "label").agg(F.sum("y").alias("pos"), F.count("*").alias("n")).where("2 * pos > n").select("fold", "label")


# ---- aggregates ----------------------------------------------------------------------------------------------------------------
@query("agg_overhead_table", "WITH o AS (SELECT CASE WHEN l_returnflag = 'A' THEN 'none' ELSE l_returnflag END AS config, l_linestatus AS kind, l_quantity AS v FROM lineitem), m AS (SELECT config, kind, quantile_cont(v, 0.5) AS median, min(v) AS low, max(v) AS high FROM o GROUP BY 1, 2) SELECT m.config, m.kind, m.median, m.low, m.high, round_even((m.median - b.median) / b.median * 100 * CASE WHEN m.kind = 'F' THEN -1 ELSE 1 END, 1) AS overhead FROM m LEFT JOIN m b ON b.config = 'none' AND b.kind = m.kind")
def agg_overhead_table(spark, d):
    """Median, least and greatest per configuration; overhead against `none`, its sign turned for throughput."""
    o = V.load(spark, d, "lineitem").select(F.when(F.col("l_returnflag") == "A", "none").otherwise(F.col("l_returnflag")).alias("config"), F.col("l_linestatus").alias("kind"), F.col("l_quantity").alias("v"))
    m = o.groupBy("config", "kind").agg(F.min("v").alias("low"), F.max("v").alias("high")).join(quantiles(o, ["config", "kind"], "v", 0.5).select("config", "kind", F.col("value").alias("median")), ["config", "kind"])
    base = m.where("config = 'none'").select("kind", F.col("median").alias("base"))
    sign = F.when(F.col("kind") == "F", -1).otherwise(1)
    return m.join(base, "kind", "left").select("config", "kind", "median", "low", "high", F.bround((F.col("median") - F.col("base")) / F.col("base") * 100 * sign, 1).alias("overhead"))


@query("agg_overhead_verdict", "WITH m AS (SELECT l_returnflag AS config, l_linestatus AS kind, avg(l_discount) AS v, count(DISTINCT l_linenumber) AS reps FROM lineitem GROUP BY 1, 2), b AS (SELECT kind, v FROM m WHERE config = 'A') SELECT config, round_even(max((m.v - b.v) / b.v), 6) AS worst, max((m.v - b.v) / b.v) <= 0.05::DOUBLE AS within, max(reps) AS reps FROM m JOIN b USING (kind) GROUP BY 1")
def agg_overhead_verdict(spark, d):
    m = V.load(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("config"), F.col("l_linestatus").alias("kind")).agg(F.avg("l_discount").alias("v"), F.count_distinct("l_linenumber").alias("reps"))
    rows = m.join(m.where("config = 'A'").select("kind", F.col("v").alias("b")), "kind").withColumn("over", (F.col("v") - F.col("b")) / F.col("b"))
    return rows.groupBy("config").agg(F.bround(F.max("over"), 6).alias("worst"), (F.max("over") <= 0.05).alias("within"), F.max("reps").alias("reps"))


@query("agg_overhead_history", "SELECT year(l_shipdate) AS run, avg(l_quantity) FILTER (l_returnflag = 'A') AS a, avg(l_quantity) FILTER (l_returnflag = 'N') AS n, avg(l_quantity) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1")
def agg_overhead_history(spark, d):
    li = V.load(spark, d, "lineitem").select(F.year("l_shipdate").alias("run"), "l_returnflag", "l_quantity")
    return li.groupBy("run").pivot("l_returnflag", ["A", "N", "R"]).agg(F.avg("l_quantity")).withColumnsRenamed({"A": "a", "N": "n", "R": "r"})


@query("agg_cpu_groups", "SELECT s_nationkey % 4 AS grp, sum(s_acctbal) AS cpu, count(*) AS n, max(s_acctbal) AS top FROM supplier GROUP BY 1")
def agg_cpu_groups(spark, d):
    return V.load(spark, d, "supplier").groupBy((F.col("s_nationkey") % 4).alias("grp")).agg(F.sum("s_acctbal").alias("cpu"), F.count("*").alias("n"), F.max("s_acctbal").alias("top"))


@query("top_cpu_users", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def top_cpu_users(spark, d):
    return V.load(spark, d, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(10)


@query("agg_fraction_by_scenario", "WITH t AS (SELECT o_orderpriority || '-' || o_custkey || '.txt' AS name, avg(CASE WHEN o_totalprice > 250000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS f FROM orders GROUP BY 1) SELECT regexp_extract(name, '^(.*)-[0-9]+\\.txt$', 1) AS scenario, avg(f) AS mean, max(f) AS top, count(*) FILTER (f > 0.6::DOUBLE) AS over FROM t GROUP BY 1")
def agg_fraction_by_scenario(spark, d):
    """Anomalous fraction per trace, grouped by the scenario in its name."""
    t = V.load(spark, d, "orders").groupBy(F.concat("o_orderpriority", F.lit("-"), "o_custkey", F.lit(".txt")).alias("name")).agg(F.avg((F.col("o_totalprice") > 250000).cast("double")).alias("f"))
    return t.groupBy(F.regexp_extract("name", r"^(.*)-[0-9]+\.txt$", 1).alias("scenario")).agg(F.avg("f").alias("mean"), F.max("f").alias("top"), F.count_if(F.col("f") > 0.6).alias("over"))


@query("agg_event_rate", "SELECT CASE WHEN event_type IN ('purchase', 'signup') THEN 'process' WHEN event_type IN ('click', 'view') THEN 'file' ELSE 'other' END AS category, count(*) / (SELECT count(*) FROM orders) AS per_request FROM events GROUP BY 1")
def agg_event_rate(spark, d):
    requests = V.load(spark, d, "orders").agg(F.count("*").alias("requests"))
    category = F.when(F.col("event_type").isin("purchase", "signup"), "process").when(F.col("event_type").isin("click", "view"), "file").otherwise("other")
    n = V.load(spark, d, "events").groupBy(category.alias("category")).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(requests)).select("category", (F.col("n") / F.col("requests")).alias("per_request"))


@query("agg_latency_percentiles", "WITH r AS (SELECT o_orderpriority AS system, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) SELECT system, max(v) FILTER (i = round_even(0.5 * (n - 1), 0)) AS p50, max(v) FILTER (i = round_even(0.99 * (n - 1), 0)) AS p99, avg(v) AS mean FROM r GROUP BY 1")
def agg_latency_percentiles(spark, d):
    return nearest_ranks(V.load(spark, d, "orders").withColumnRenamed("o_orderpriority", "system"), ["system"], "o_totalprice", p50=0.5, p99=0.99)


@query("agg_trust_latency", "WITH r AS (SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'key' WHEN c_mktsegment = 'MACHINERY' THEN 'comp' ELSE 'other' END AS changed, c_acctbal AS v FROM customer), n AS (SELECT changed, v, row_number() OVER (PARTITION BY changed ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY changed) AS n FROM r) SELECT changed, max(v) FILTER (i = round_even(0.5 * (n - 1), 0)) AS p50, avg(v) AS mean FROM n GROUP BY 1")
def agg_trust_latency(spark, d):
    changed = F.when(F.col("c_mktsegment") == "BUILDING", "key").when(F.col("c_mktsegment") == "MACHINERY", "comp").otherwise("other")
    return nearest_ranks(V.load(spark, d, "customer").withColumn("changed", changed), ["changed"], "c_acctbal", p50=0.5)


@query("agg_verify_cost", "SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.99) AS p99 FROM events GROUP BY 1")
def agg_verify_cost(spark, d):
    q = quantiles(V.load(spark, d, "events"), ["event_type"], "value", 0.5, 0.99)
    return q.groupBy("event_type").agg(F.max(F.when(F.col("p") == 0.5, F.col("value"))).alias("p50"), F.max(F.when(F.col("p") == 0.99, F.col("value"))).alias("p99"))


@query("agg_compile_steps", "SELECT p_type AS step, quantile_cont(p_retailprice, 0.5) AS median_ms FROM part GROUP BY 1")
def agg_compile_steps(spark, d):
    steps = V.load(spark, d, "part").select(F.explode(F.create_map("p_type", "p_retailprice")).alias("step", "ms"))
    return quantiles(steps, ["step"], "ms", 0.5).select("step", F.col("value").alias("median_ms"))


@query("agg_prep_summary", "SELECT o_orderpriority AS system, arg_max(o_totalprice, o_orderkey) AS seconds, max(o_orderkey) AS line, count(*) AS n FROM orders GROUP BY 1")
def agg_prep_summary(spark, d):
    return V.load(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("system")).agg(F.max_by("o_totalprice", "o_orderkey").alias("seconds"), F.max("o_orderkey").alias("line"), F.count("*").alias("n"))


CAPS_SQL = V.with_views("v_event") + ", c AS (SELECT digest AS image, pid % 3 AS run, cap, granted, k FROM v_event WHERE kind = 'cap')"


def cap_checks(spark, d):
    return V.v_event(spark, d).where("kind = 'cap'").selectExpr("digest AS image", "pid % 3 AS run", "cap", "granted", "k")


@query("agg_label_sets", CAPS_SQL + ", g AS (SELECT image, run, cap, bool_or(granted IS DISTINCT FROM false) AS used FROM c GROUP BY 1, 2, 3) SELECT image, run, coalesce(list_sort(list(cap) FILTER (used)), CAST([] AS VARCHAR[])) AS granted, coalesce(list_sort(list(cap) FILTER (NOT used)), CAST([] AS VARCHAR[])) AS denied_only FROM g GROUP BY 1, 2")
def agg_label_sets(spark, d):
    c = cap_checks(spark, d)
    used = F.coalesce("granted", F.lit(True))
    sets = c.groupBy("image", "run").agg(F.collect_set(F.when(used, F.col("cap"))).alias("granted"), F.collect_set(F.when(~used, F.col("cap"))).alias("denied"))
    return sets.select("image", "run", F.array_sort("granted").alias("granted"), F.array_sort(F.array_except("denied", "granted")).alias("denied_only"))


@query("agg_label_union", CAPS_SQL + ", g AS (SELECT image, cap, count(DISTINCT run) AS runs FROM c WHERE k % 12 <> run + 3 GROUP BY 1, 2), n AS (SELECT image, count(DISTINCT run) AS n FROM c GROUP BY 1) SELECT image, count(*) AS in_any, count(*) FILTER (runs < n) AS disagree, round_even(count(*) FILTER (runs < n) / count(*), 4) AS fraction FROM g JOIN n USING (image) GROUP BY 1")
def agg_label_union(spark, d):
    """Union over runs, and what not all runs have."""
    c = cap_checks(spark, d)
    n = c.groupBy("image").agg(F.count_distinct("run").alias("n"))
    g = c.where("k % 12 <> run + 3").groupBy("image", "cap").agg(F.count_distinct("run").alias("runs")).join(n, "image")
    differ = F.count_if(F.col("runs") < F.col("n"))
    return g.groupBy("image").agg(F.count("*").alias("in_any"), differ.alias("disagree"), F.bround(differ / F.count("*"), 4).alias("fraction"))


@query("agg_rare_labels", CAPS_SQL + " SELECT cap, count(DISTINCT image) AS images FROM c WHERE k % 5 = 0 GROUP BY 1 HAVING count(DISTINCT image) < 3")
def agg_rare_labels(spark, d):
    return cap_checks(spark, d).where("k % 5 = 0").groupBy("cap").agg(F.count_distinct("image").alias("images")).where("images < 3")


@query("agg_workload_filter", CAPS_SQL + " SELECT image, count(*) AS kept FROM c WHERE run <> 1 OR NOT (SELECT bool_or(run = 0) FROM c) GROUP BY 1")
def agg_workload_filter(spark, d):
    """Checks of processes with more than the default set are skipped, if the input carries sets at all (here: a run 0)."""
    c = cap_checks(spark, d)
    present = c.agg(F.bool_or(F.col("run") == 0).alias("present"))
    own = F.when(F.col("run") == 1, lits(["CAP_0", "CAP_99"])).otherwise(lits(["CAP_0"]))
    kept = (F.size(F.array_except(own, lits(["CAP_0", "CAP_1"]))) == 0) | ~F.col("present")
    return c.crossJoin(F.broadcast(present)).where(kept).groupBy("image").agg(F.count("*").alias("kept"))


@query("agg_vocabulary", V.with_views("v_file") + " SELECT package, count(DISTINCT digest) AS df FROM v_file WHERE package IS NOT NULL GROUP BY 1 ORDER BY df DESC, package LIMIT 100")
def agg_vocabulary(spark, d):
    """The hundred packages in most images, ties by name."""
    f = V.v_file(spark, d).where("package is not null")
    return f.groupBy("package").agg(F.count_distinct("digest").alias("df")).orderBy(F.desc("df"), "package").limit(100)


@query("agg_image_features", V.with_views("v_file") + " SELECT digest, count(*) AS files, count(DISTINCT package) AS packages, count(*) FILTER (in_closure) AS closure, bool_or(package LIKE '%/p3@%') AS has_p3, bool_or(package LIKE '%/p7@%') AS has_p7 FROM v_file GROUP BY 1")
def agg_image_features(spark, d):
    has = lambda p: F.coalesce(F.bool_or(F.col("package").rlike(f"/{p}@")), F.lit(False)).alias(f"has_{p}")
    return V.v_file(spark, d).groupBy("digest").agg(F.count("*").alias("files"), F.count_distinct("package").alias("packages"), F.count_if("in_closure").alias("closure"), has("p3"), has("p7"))


@query("agg_unresolved_fraction", V.with_views("v_package") + " SELECT digest, avg(CASE WHEN depth IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS fraction FROM v_package GROUP BY 1")
def agg_unresolved_fraction(spark, d):
    return V.v_package(spark, d).groupBy("digest").agg(F.avg(F.col("depth").isNull().cast("double")).alias("fraction"))


@query("agg_capability_report", "SELECT p_brand AS test, p_size % 3 AS priority, coalesce(max(CASE WHEN s_acctbal > 5000 THEN 'pass' WHEN s_acctbal IS NOT NULL THEN 'fail' END), 'not_run') AS status FROM part LEFT JOIN supplier ON s_suppkey = p_partkey GROUP BY 1, 2")
def agg_capability_report(spark, d):
    s = V.load(spark, d, "supplier").select(F.col("s_suppkey").alias("p_partkey"), F.when(F.col("s_acctbal") > 5000, "pass").otherwise("fail").alias("status"))
    return V.load(spark, d, "part").join(s, "p_partkey", "left").groupBy(F.col("p_brand").alias("test"), (F.col("p_size") % 3).alias("priority")).agg(F.coalesce(F.max("status"), F.lit("not_run")).alias("status"))


def set_metrics(rows: DataFrame) -> DataFrame:
    """Rates of an (id, label, truth, predicted) table: under- and over-prediction, micro F1."""
    t, p = F.col("truth"), F.col("predicted")
    n = rows.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    return n.selectExpr("fn / (tp + fn) AS under", "fp / (tp + fp) AS over", "2 * tp / (2 * tp + fp + fn) AS micro_f1", "(fp + fn) / (tp + fp + fn + tn) AS hamming")


@query("agg_set_metrics", "WITH r AS (SELECT quality = 1 AS t, n_chars > 400 AS p FROM labels JOIN documents USING (doc_id) UNION ALL SELECT toxic = 1, n_chars > 3000 FROM labels JOIN documents USING (doc_id)), n AS (SELECT count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn FROM r) SELECT fn / (tp + fn) AS under, fp / (tp + fp) AS over, 2 * tp / (2 * tp + fp + fn) AS micro_f1, (fp + fn) / (tp + fp + fn + tn) AS hamming FROM n")
def agg_set_metrics(spark, d):
    rows = V.load(spark, d, "labels").join(V.load(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    pairs = F.array(F.struct(F.lit("quality").alias("label"), (F.col("quality") == 1).alias("truth"), (F.col("n_chars") > 400).alias("predicted")), F.struct(F.lit("toxic").alias("label"), (F.col("toxic") == 1).alias("truth"), (F.col("n_chars") > 3000).alias("predicted")))
    return set_metrics(rows.select("doc_id", F.inline(pairs)))


@query("agg_contract_check", V.with_views("v_binding") + " SELECT count(*) FILTER (run_as_root IS NULL) AS no_user, count(*) FILTER (len(list_filter(mounts, lambda m: right(m, 1) = '/')) > 0) AS trailing_slash, count(*) AS n FROM v_binding")
def agg_contract_check(spark, d):
    return V.v_binding(spark, d).agg(F.count_if(F.col("run_as_root").isNull()).alias("no_user"), F.count_if(F.exists("mounts", lambda m: m.endswith("/"))).alias("trailing_slash"), F.count("*").alias("n"))


@query("pred_real_result", "SELECT count(*) AS n FROM documents WHERE NOT contains(text, '###') AND n_chars >= 300")
def pred_real_result(spark, d):
    return V.load(spark, d, "documents").where(~F.contains("text", F.lit("###")) & (F.col("n_chars") >= 300)).agg(F.count("*").alias("n"))


@query("join_features_labels", "WITH l AS (SELECT doc_id % 300 AS digest, max(doc_id) AS line FROM labels GROUP BY 1), f AS (SELECT vec_id % 400 AS digest, max(vec_id) AS fline FROM embeddings GROUP BY 1) SELECT digest, CASE WHEN fline IS NULL THEN 'left' WHEN line IS NULL THEN 'right' ELSE 'both' END AS side FROM l FULL JOIN f USING (digest)")
def join_features_labels(spark, d):
    """The last line of each digest counts; rows of one side only are reported."""
    last = lambda t, c, m, n: V.load(spark, d, t).groupBy((F.col(c) % m).alias("digest")).agg(F.max(c).alias(n))
    rows = last("labels", "doc_id", 300, "line").join(last("embeddings", "vec_id", 400, "fline"), "digest", "full")
    return rows.select("digest", F.when(F.col("fline").isNull(), "left").when(F.col("line").isNull(), "right").otherwise("both").alias("side"))
