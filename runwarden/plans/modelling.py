"""Queries of models: forests, thresholds, guards, capability prediction and its evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import testviews as V
from ..operators import detector, forest
from ..operators.ranks import quantiles
from .inputs import folder
from .registry import query
from .scenarios import confusion, metrics


def v_feature(spark, d) -> DataFrame:
    """Vectors of four images."""
    return V.load(spark, d, "embeddings").select(F.concat(F.lit("i"), F.coalesce("label", F.lit(0)) % 4).alias("digest"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))


@query("ml_iforest_train")
def ml_iforest_train(spark, d):
    return forest.train(v_feature(spark, d))


@query("ml_iforest_score")
def ml_iforest_score(spark, d):
    rows = v_feature(spark, d)
    return forest.score(rows, forest.train(rows.where("id % 10 < 7")))


@query("ml_forest_check", "SELECT DISTINCT CASE kind WHEN 0 THEN '' ELSE 'bad' || kind || '-' END || 'i' || (coalesce(label, 0) % 4) AS digest, kind = 0 AS ok FROM embeddings, generate_series(0, 4) AS g(kind)")
def ml_forest_check(spark, d):
    """Grown forests are usable; each altered in one tree of one way (a child outside the tree, an unknown feature, arrays of different lengths, a child before its root) is not."""
    good = forest.train(v_feature(spark, d))
    first = F.row_number().over(Window.partitionBy("digest").orderBy("tree")) == 1
    altered = {
        1: ("lefts", F.transform("lefts", lambda c, i: F.when(i == 0, F.size("lefts") + 5).otherwise(c).cast("int"))),
        2: ("features", F.transform("features", lambda f, i: F.when(i == 0, 10_000).otherwise(f).cast("int"))),
        3: ("thresholds", F.slice("thresholds", 1, F.size("thresholds") - 1)),
        4: ("rights", F.transform("rights", lambda c, i: F.when(i == 0, -7).otherwise(c).cast("int"))),
    }
    width = v_feature(spark, d).select(F.max(F.size("x"))).first()[0] or 0
    rows = good.withColumn("one", first)
    for n, (column, change) in altered.items():
        bad = good.withColumn("one", first).withColumn(column, F.when(F.col("one"), change).otherwise(F.col(column)).cast(good.schema[column].dataType)).withColumn("digest", F.concat(F.lit(f"bad{n}-"), "digest"))
        rows = rows.unionByName(bad)
    return forest.usable(rows.drop("one"), width)


WINDOWS_SQL = "WITH w AS (SELECT event_id AS id, 'i' || (user_id // 5) AS digest, value AS score, event_id % 10 < 7 AS train, event_type = 'error' AS attack, value / 3 AS f1, CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS f2 FROM events), th AS (SELECT digest, CASE WHEN count(*) < 100 THEN quantile_cont(score, 0.95) ELSE quantile_cont(score, 0.99) END AS theta FROM w WHERE NOT train GROUP BY 1), mx AS (SELECT digest, max(f1) AS m1, max(f2) AS m2 FROM w WHERE train AND f2 < 40 AND f1 < 6 GROUP BY 1), j AS (SELECT w.*, theta, m1, m2, score > theta AS forest, f1 > 2 * m1 OR f2 > 2 * m2 AS guard FROM w JOIN th USING (digest) JOIN mx USING (digest))"


def windows(spark, d) -> DataFrame:
    """Scored windows with two features, from events."""
    e = V.load(spark, d, "events")
    return e.selectExpr("event_id AS id", "concat('i', user_id div 5) AS digest", "value AS score", "event_id % 10 < 7 AS train", "event_type = 'error' AS attack", "value / 3 AS f1", "CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) AS f2")


def thresholds(validation: DataFrame) -> DataFrame:
    """The 99th percentile of the validation scores, linearly interpolated; the 95th below 100 windows."""
    return quantiles(validation, ["digest"], "score", 0.95, 0.99).where("(n < 100) = (p = 0.95)").select("digest", F.col("value").alias("theta"))


@query("ml_threshold", WINDOWS_SQL + " SELECT * FROM th")
def ml_threshold(spark, d):
    return thresholds(windows(spark, d).where("not train"))


@query("ml_percentile_rank", WINDOWS_SQL + ", v AS (SELECT digest, score FROM w WHERE NOT train), n AS (SELECT digest, count(*) AS n FROM v GROUP BY 1) SELECT w.id, (SELECT count(*) FROM v WHERE v.digest = w.digest AND v.score <= w.score) / n.n AS g FROM w JOIN n USING (digest) WHERE w.train")
def ml_percentile_rank(spark, d):
    """Share of validation scores at or below: one sorted pass over both, counting what has gone before, not a range join."""
    w = windows(spark, d)
    own = F.col("train").cast("int")
    below = F.sum(1 - own).over(Window.partitionBy("digest").orderBy("score").rangeBetween(Window.unboundedPreceding, 0))
    n = F.sum(1 - own).over(Window.partitionBy("digest"))
    return w.select("id", "train", F.when(n > 0, below / n).otherwise(1.0).alias("g")).where("train").select("id", "g")


def guarded(spark, d) -> DataFrame:
    w = windows(spark, d)
    most = w.where("train and f2 < 40 and f1 < 6").groupBy("digest").agg(F.max("f1").alias("m1"), F.max("f2").alias("m2"))
    w = w.join(most, "digest").join(thresholds(w.where("not train")), "digest")
    beyond = F.exists(F.array(F.struct(F.col("f1").alias("x"), F.col("m1").alias("m")), F.struct(F.col("f2").alias("x"), F.col("m2").alias("m"))), lambda p: p["x"] > 2 * p["m"])
    return w.withColumn("forest", F.col("score") > F.col("theta")).withColumn("guard", beyond)


@query("ml_range_guard", WINDOWS_SQL + " SELECT id, guard FROM j")
def ml_range_guard(spark, d):
    return guarded(spark, d).select("id", "guard")


@query("ml_window_decision", WINDOWS_SQL + " SELECT id, 'D_beh' AS class, 'INFERRED' AS origin FROM j WHERE forest OR guard")
def ml_window_decision(spark, d):
    return guarded(spark, d).where("forest or guard").select("id", F.lit("D_beh").alias("class"), F.lit("INFERRED").alias("origin"))


@query("ml_window_fpr", WINDOWS_SQL + " SELECT avg(CASE WHEN forest OR guard THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS overall, avg(CASE WHEN forest THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS forest, avg(CASE WHEN guard THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS guard FROM j WHERE NOT attack")
def ml_window_fpr(spark, d):
    share = lambda c, n: F.avg(c.cast("double")).alias(n)
    return guarded(spark, d).where("not attack").agg(share(F.col("forest") | F.col("guard"), "overall"), share(F.col("forest"), "forest"), share(F.col("guard"), "guard"))


@query("ml_global_vs_image", WINDOWS_SQL + ", g AS (SELECT CASE WHEN count(*) < 100 THEN quantile_cont(score, 0.95) ELSE quantile_cont(score, 0.99) END AS theta FROM w WHERE NOT train) SELECT digest, avg(CASE WHEN NOT attack THEN CASE WHEN score > j.theta THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END) AS own_fpr, avg(CASE WHEN NOT attack THEN CASE WHEN score > g.theta THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END) AS pooled_fpr, count(*) FILTER (attack AND score > j.theta) AS own_hits, count(*) FILTER (attack AND score > g.theta) AS pooled_hits FROM j, g GROUP BY 1")
def ml_global_vs_image(spark, d):
    w = guarded(spark, d)
    pooled = thresholds(w.where("not train").withColumn("digest", F.lit("global"))).select(F.col("theta").alias("pooled"))
    w = w.crossJoin(F.broadcast(pooled))
    fpr = lambda t: F.avg(F.when(~F.col("attack"), (F.col("score") > F.col(t)).cast("double")))
    hits = lambda t: F.count_if(F.col("attack") & (F.col("score") > F.col(t)))
    return w.groupBy("digest").agg(fpr("theta").alias("own_fpr"), fpr("pooled").alias("pooled_fpr"), hits("theta").alias("own_hits"), hits("pooled").alias("pooled_hits"))


@query("ml_seq_detector")
def ml_seq_detector(spark, d):
    """Calls of a container are two traces: the earlier half is a baseline of its image, the later half is judged."""
    e = V.v_event(spark, d)
    w = Window.partitionBy("digest", "cid")
    early = F.row_number().over(w.orderBy("t_ns", "seq")) * 2 <= F.count("*").over(w)
    calls = e.select("digest", F.col("cid").alias("trace"), "seq", "t_ns", "kind", early.alias("early"))
    windows = lambda rows: detector.call_windows(rows, ["exec", "write", "load", "connect", "cap"])
    return detector.judge(windows(calls.where("early")), windows(calls.where("not early")))


FEATURE_SQL = "WITH f AS (SELECT doc_id, n_chars, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE n_chars / 100.0::DOUBLE END AS size, CASE WHEN contains(text, 'the') THEN 1 ELSE 0 END AS has_the, CASE WHEN contains(text, 'que') THEN 1 ELSE 0 END AS has_que FROM documents)"


def features(spark, d) -> DataFrame:
    has = lambda w: F.contains("text", F.lit(w)).cast("int").alias(f"has_{w}")
    return V.load(spark, d, "documents").select("doc_id", "n_chars", F.when(F.col("doc_id") % 9 != 0, F.col("n_chars") / 100.0).alias("size"), has("the"), has("que"))


@query("ml_feature_matrix", FEATURE_SQL + " SELECT doc_id, size, has_the, has_que, quality AS y FROM f JOIN labels USING (doc_id)")
def ml_feature_matrix(spark, d):
    """Fixed features, 0/1 per vocabulary entry, missing ones null."""
    return features(spark, d).join(V.load(spark, d, "labels"), "doc_id").select("doc_id", "size", "has_the", "has_que", F.col("quality").alias("y"))


def folds(rows: DataFrame, key: str, n: int = 5, repeats: int = 3, seed: int = 0) -> DataFrame:
    """rows repeated, with a fold: every key in one fold of each repetition; folds' sizes differ by one at most.

    Keys are ordered by hash; ranks come from counts of hash buckets and places within them, so no task ranks all keys.
    """
    keys = rows.select(key).distinct().withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    keys = keys.withColumn("h", F.xxhash64(key, F.col("repeat") + seed)).withColumn("bucket", F.shiftright("h", 54))
    counts = keys.groupBy("repeat", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("repeat").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = keys.withColumn("r", F.row_number().over(Window.partitionBy("repeat", "bucket").orderBy("h", key)))
    ranked = ranked.join(counts.withColumn("before", before).drop("n"), ["repeat", "bucket"])
    return rows.join(ranked.select(key, "repeat", F.pmod(F.col("before") + F.col("r") - 1, F.lit(n)).alias("fold")), key)


@query("ml_group_kfold", "WITH n AS (SELECT count(DISTINCT doc_id) AS n FROM labels) SELECT r AS repeat, f AS fold, n // 5 + CASE WHEN f < n % 5 THEN 1 ELSE 0 END AS images FROM n, (SELECT unnest([0, 1, 2]) AS r) , (SELECT unnest([0, 1, 2, 3, 4]) AS f)")
def ml_group_kfold(spark, d):
    return folds(V.load(spark, d, "labels"), "doc_id").groupBy("repeat", "fold").agg(F.count_distinct("doc_id").alias("images"))


def assembled(rows: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=["n_chars", "has_the", "has_que"], outputCol="features", handleInvalid="keep").transform(rows)


LABELS = ("quality", "toxic")


def predicted(spark, d, repeats: int = 1) -> DataFrame:
    """(repeat, fold, doc_id, label, p, truth): for each label a boosted model per fold of each repetition, fitted on the other folds and applied to it."""
    src = folder(spark, "folds")
    folds(features(spark, d).join(V.load(spark, d, "labels"), "doc_id"), "doc_id", repeats=repeats).write.parquet(src)
    rows = assembled(spark.read.parquet(src))
    out = None
    for repeat in range(repeats):
        for fold in range(5):
            own = rows.where(f"repeat = {repeat}")
            for label in LABELS:
                p = applied(own.where(f"fold <> {fold}"), own.where(f"fold = {fold}"), label, "repeat", "fold").withColumn("truth", F.col("truth") == 1)
                out = p if out is None else out.unionByName(p)
    return out


def applied(train: DataFrame, rows: DataFrame, label: str, *keys: str) -> DataFrame:
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import vector_to_array

    fit = GBTClassifier(labelCol=label, maxIter=5, maxDepth=3, seed=0).fit(train.withColumn(label, F.col(label).cast("double")))
    return fit.transform(rows).select(*keys, "doc_id", F.lit(label).alias("label"), vector_to_array("probability")[1].alias("p"), F.col(label).alias("truth"))


@query("ml_cap_train")
def ml_cap_train(spark, d):
    return predicted(spark, d).groupBy("label").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"))


@query("ml_cap_predict")
def ml_cap_predict(spark, d):
    """Every document: out of fold where it has labels, else by a model of all that have."""
    labels = V.load(spark, d, "labels")
    known, rest = features(spark, d).join(labels, "doc_id"), features(spark, d).join(labels, "doc_id", "left_anti")
    out = predicted(spark, d).select("doc_id", "label", "p")
    for label in LABELS:
        own = applied(assembled(known), assembled(rest).withColumn(label, F.lit(None).cast("double")), label)
        out = out.unionByName(own.select("doc_id", "label", "p"))
    return out


@query("ml_cv_evaluate")
def ml_cv_evaluate(spark, d):
    """Metrics of out-of-fold predictions, five folds by three repetitions: mean and population deviation over repetitions, per label, for the
    model and for three baselines: nothing, everything, and what most rows of the other folds are."""
    out = folder(spark, "out-of-fold")
    predicted(spark, d, repeats=3).write.parquet(out)
    rows = spark.read.parquet(out)
    n = rows.groupBy("repeat", "label", "fold").agg(F.count("*").alias("n"), F.count_if("truth").alias("pos"))
    others = lambda c: F.sum(c).over(Window.partitionBy("repeat", "label")) - F.col(c)
    rows = rows.join(n.select("repeat", "label", "fold", (2 * others("pos") > others("n")).alias("most")), ["repeat", "label", "fold"])
    methods = {"model": F.col("p") >= 0.5, "nothing": F.lit(False), "everything": F.lit(True), "majority": F.col("most")}
    hits = rows.select("repeat", F.col("label").alias("which"), F.when(F.col("truth"), "malicious").otherwise("benign").alias("label"), F.inline(F.array(*(F.struct(F.lit(m).alias("method"), h.alias("hit")) for m, h in methods.items()))))
    each = metrics(confusion(hits, "repeat", "which", "method"))
    return each.groupBy("which", "method").agg(F.count("*").alias("repeats"), F.sum(F.expr("tp + fp + fn + tn")).alias("n"), *(f(c).alias(f"{a}_{c}") for c in ("precision", "recall", "f1", "fpr", "accuracy") for a, f in (("mean", F.avg), ("std", F.stddev_pop))))


@query("ml_theta_sweep", WINDOWS_SQL + ", t AS (SELECT unnest([0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8]) AS theta) SELECT CAST(t.theta AS DOUBLE) AS theta, count(*) FILTER (attack AND score / 100 >= t.theta) AS tp, count(*) FILTER (NOT attack AND score / 100 >= t.theta) AS fp FROM w, t GROUP BY 1")
def ml_theta_sweep(spark, d):
    """Thirteen thresholds in one pass: each row is counted at those it reaches."""
    ts = [round(0.2 + 0.05 * i, 2) for i in range(13)]
    rows = windows(spark, d).agg(*(f(F.col("attack") == a, t).alias(f"{n}_{i}") for i, t in enumerate(ts) for n, a, f in (("tp", True, lambda c, t: F.count_if(c & (F.col("score") / 100 >= t))), ("fp", False, lambda c, t: F.count_if(c & (F.col("score") / 100 >= t))))))
    return rows.select(F.inline(F.array(*(F.struct(F.lit(t).alias("theta"), F.col(f"tp_{i}").alias("tp"), F.col(f"fp_{i}").alias("fp")) for i, t in enumerate(ts)))))


@query("top_unusual_features", WINDOWS_SQL + ", s AS (SELECT digest, avg(f1) AS a1, stddev_pop(f1) AS s1, avg(f2) AS a2, stddev_pop(f2) AS s2 FROM w WHERE train GROUP BY 1) SELECT id, CASE WHEN z1 > 0 AND z2 > 0 THEN CASE WHEN z1 >= z2 THEN ['f1', 'f2'] ELSE ['f2', 'f1'] END WHEN z1 > 0 THEN ['f1'] WHEN z2 > 0 THEN ['f2'] ELSE CAST([] AS VARCHAR[]) END AS top FROM (SELECT id, (f1 - a1) / s1 AS z1, (f2 - a2) / s2 AS z2 FROM w JOIN s USING (digest))")
def top_unusual_features(spark, d):
    """The features furthest above their training mean, in deviations; three at most."""
    w = windows(spark, d)
    s = w.where("train").groupBy("digest").agg(*(f(c).alias(f"{n}_{c}") for c in ("f1", "f2") for n, f in (("a", F.avg), ("s", F.stddev_pop))))
    w = w.join(s, "digest")
    z = lambda c: F.struct((-(F.col(c) - F.col(f"a_{c}")) / F.col(f"s_{c}")).alias("minus_z"), F.lit(c).alias("f"))
    ordered = F.array_sort(F.filter(F.array(z("f1"), z("f2")), lambda x: x["minus_z"] < 0))
    return w.select("id", F.transform(F.slice(ordered, 1, 3), lambda x: x["f"]).alias("top"))


@query("top_guard_reasons", WINDOWS_SQL + " SELECT id, list_filter([CASE WHEN f1 > 2 * m1 THEN 'f1' END, CASE WHEN f2 > 2 * m2 THEN 'f2' END], lambda x: x IS NOT NULL) AS reasons FROM j WHERE guard")
def top_guard_reasons(spark, d):
    over = lambda c, m: F.when(F.col(c) > 2 * F.col(m), F.lit(c))
    return guarded(spark, d).where("guard").select("id", F.slice(F.array_compact(F.array(over("f1", "m1"), over("f2", "m2"))), 1, 3).alias("reasons"))
