"""Queries of sources, sinks and streams. Files are written from the driver's tables to the shared folder, then read as the source would."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import testviews as V
from ..operators import normalise as N
from ..operators.graph import shared_folder as folder
from ..sources import readers as R
from ..streaming import sinks
from .normalising import RAW_SQL, v_raw
from .registry import query


def lines_file(df: DataFrame, name: str) -> str:
    """One text column written as lines."""
    path = folder(df.sparkSession, name)
    df.write.text(path)
    return path


@query("src_events_jsonl", RAW_SQL + " SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM n GROUP BY 1")
def src_events_jsonl(spark, d):
    """Sensor lines from text files; broken ones are counted, blank ones skipped."""
    raw = v_raw(spark, d)
    path = lines_file(raw.select(F.when(F.col("seq") % 1000 == 7, F.concat("line", F.lit("\n"))).otherwise(F.col("line"))), "lines")
    return N.normalised(R.json_lines(spark, path)).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("src_events_live", RAW_SQL + " SELECT kind, count(*) AS n FROM n WHERE reason IS NULL GROUP BY 1")
def src_events_live(spark, d):
    """The same lines as a stream that is run until nothing is left; each batch is appended."""
    path, out = lines_file(v_raw(spark, d).select("line"), "live"), folder(spark, "live-out")
    rows = spark.readStream.schema("value string").text(path).selectExpr("CAST(NULL AS BIGINT) AS seq", "value AS line")
    sinks.append(N.normalised(rows).where("reason is null").select("kind", "namespace", "container_id"), out, folder(spark, "ck"))
    return spark.read.parquet(out).groupBy("kind").agg(F.count("*").alias("n"))


@query("src_replay", V.with_views("v_event") + " SELECT kind, count(*) AS n FROM v_event WHERE kind IN ('exec', 'write') GROUP BY 1")
def src_replay(spark, d):
    """Records that are normalised already re-enter by their own fields."""
    e = V.v_event(spark, d).where("kind in ('exec', 'write')").select(F.to_json(F.struct("kind", "cid", "pid", "path", "t_ns")).alias("line"))
    path = lines_file(e, "replay")
    v = F.try_parse_json("line")
    back = R.json_lines(spark, path).select(F.try_variant_get(v, "$.kind", "string").alias("kind"), F.try_variant_get(v, "$.pid", "bigint").alias("pid"))
    return back.where("kind is not null and pid is not null").groupBy("kind").agg(F.count("*").alias("n"))


@query("src_envelopes", V.with_views("v_file") + f" SELECT digest, count(*) AS files FROM v_file WHERE NOT ({V.NO_ENVELOPE.format('digest')}) GROUP BY 1")
def src_envelopes(spark, d):
    """Documents count if complete and named by their own digest; every fourth is not."""
    path = folder(spark, "envelopes")
    docs = V.v_file(spark, d).groupBy("digest").agg(F.to_json(F.struct(F.first("digest").alias("image"), F.collect_list(F.struct("path", "sha256", "layer")).alias("files"))).alias("value"))
    docs.select(F.when(F.expr(V.NO_ENVELOPE.format("digest")), "other").otherwise(F.col("digest")).alias("name"), "value").write.partitionBy("name").text(path)
    return R.named_documents(spark, path, "image string, files array<struct<path: string, sha256: string, layer: int>>").select(F.col("image").alias("digest"), F.size("files").cast("long").alias("files"))


@query("src_bindings", V.with_views("v_binding") + " SELECT container_id, image_digest, verified FROM v_binding")
def src_bindings(spark, d):
    """Objects keyed by container, one a line."""
    b = V.v_binding(spark, d).select(F.to_json(F.create_map("container_id", F.struct("image_digest", "verified"))))
    path = lines_file(b, "bindings")
    doc = spark.read.text(path).select(F.from_json("value", "map<string, struct<image_digest: string, verified: boolean>>").alias("m"))
    return doc.select(F.explode("m").alias("container_id", "b")).select("container_id", "b.*")


@query("src_jsonl_tolerant", "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 10 <> 0")
def src_jsonl_tolerant(spark, d):
    """Bad lines are skipped; a missing folder is an empty table."""
    c = V.load(spark, d, "customer")
    line = F.when(F.col("c_custkey") % 10 == 0, F.lit("{oops")).otherwise(F.to_json(F.struct("c_custkey", "c_acctbal")))
    path = lines_file(c.select(line), "tolerant")
    schema = "c_custkey long, c_acctbal double"
    return R.tolerant_json(spark, path, schema).unionByName(R.tolerant_json(spark, path + "-absent", schema))


@query("src_ground_truth_csv", V.with_views("v_truth") + " SELECT line, scenario, label FROM v_truth WHERE line % 13 <> 0")
def src_ground_truth_csv(spark, d):
    """Rows without a scenario are dropped."""
    path = folder(spark, "truth")
    t = V.v_truth(spark, d).select("line", F.when(F.col("line") % 13 != 0, F.col("scenario")).alias("scenario"), "label")
    t.write.option("header", True).csv(path)
    return spark.read.schema("line long, scenario string, label string").option("header", True).csv(path).where("scenario is not null and scenario <> ''")


@query("src_syscall_trace", "SELECT event_type AS call, count(*) AS n FROM events WHERE user_id % 5 <> 0 AND event_id % 7 <> 0 GROUP BY 1")
def src_syscall_trace(spark, d):
    """Time, process, name and call by tabs; comments and runtime processes are skipped, prefixes taken off."""
    e = V.load(spark, d, "events")
    comm = F.when(F.col("user_id") % 5 == 0, "runc:[2:INIT]").otherwise("app")
    line = F.when(F.col("event_id") % 7 == 0, F.lit("# comment")).otherwise(F.concat_ws("\t", F.col("event_id").cast("string"), F.col("user_id").cast("string"), comm, F.concat(F.lit("sys_enter_"), "event_type")))
    return R.syscall_trace(spark, lines_file(e.select(line), "trace")).groupBy("call").agg(F.count("*").alias("n"))


@query("src_package_db", "SELECT p_name || '-' || p_partkey AS name, '1.' || p_size AS version FROM part WHERE p_partkey % 4 <> 0")
def src_package_db(spark, d):
    """Stanzas of a package database whose status ends in installed."""
    p = V.load(spark, d, "part")
    status = F.when(F.col("p_partkey") % 4 == 0, "deinstall ok config-files").otherwise("install ok installed")
    stanza = F.concat(F.lit("Package: "), "p_name", F.lit("-"), "p_partkey", F.lit("\nStatus: "), status, F.lit("\nArchitecture: amd64\nVersion: 1."), "p_size", F.lit("\n"))
    return R.package_stanzas(spark, lines_file(p.select(stanza), "status")).select("name", "version")


@query("src_package_lists", "SELECT 'pkg' || (p_partkey % 7) AS package, '/usr/share/' || p_partkey AS path FROM part")
def src_package_lists(spark, d):
    """List files name their package; each line is a claimed path."""
    path = folder(spark, "lists")
    V.load(spark, d, "part").selectExpr("concat('pkg', p_partkey % 7) AS package", "concat('/usr/share/', p_partkey) AS value").repartition("package").write.partitionBy("package").text(path)
    return R.claimed_paths(spark, path)


@query("src_attestations", "SELECT c_custkey AS line, 'https://slsa.dev/' || c_nationkey AS predicate_type FROM customer WHERE c_custkey % 6 <> 0")
def src_attestations(spark, d):
    """Payloads in standard or URL-safe base64, padded or not; others give nothing."""
    c = V.load(spark, d, "customer")
    payload = F.base64(F.to_json(F.struct(F.concat(F.lit("https://slsa.dev/"), "c_nationkey").alias("predicateType"), F.lit("~~~???").alias("x"))).cast("binary"))
    payload = F.when(F.col("c_custkey") % 2 == 0, F.regexp_replace(F.translate(payload, "+/", "-_"), "=+$", "")).otherwise(payload)
    rows = c.select(F.col("c_custkey").alias("line"), F.when(F.col("c_custkey") % 6 == 0, F.lit("!")).otherwise(payload).alias("payload"))
    return R.statements(rows).select("line", "predicate_type").where("predicate_type is not null")


@query("src_advisories", "SELECT 'ADV-' || s_suppkey AS id, 'n' || (s_suppkey % 9 + j) AS name FROM supplier, (VALUES (0), (1)) AS x(j)")
def src_advisories(spark, d):
    """A file of advisories, each with affected packages."""
    s = V.load(spark, d, "supplier")
    doc = F.to_json(F.struct(F.concat(F.lit("ADV-"), "s_suppkey").alias("id"), F.transform(F.array(F.lit(0), F.lit(1)), lambda j: F.struct(F.struct(F.concat(F.lit("n"), F.col("s_suppkey") % 9 + j).alias("name")).alias("package"))).alias("affected")))
    path = lines_file(s.select(doc), "advisories")
    schema = "id string, affected array<struct<package: struct<name: string>, versions: array<string>>>"
    return spark.read.schema(schema).json(path).select("id", F.explode("affected").alias("a")).select("id", "a.package.name")


@query("src_sbom_components", "SELECT s_suppkey AS sbom, 'pkg:t/a' || s_suppkey AS purl FROM supplier UNION ALL SELECT s_suppkey, 'pkg:t/b' || s_suppkey FROM supplier WHERE s_suppkey % 2 = 0")
def src_sbom_components(spark, d):
    """Libraries, applications and frameworks with a purl, nested ones too (to a depth that the documents have)."""
    s = V.load(spark, d, "supplier")
    child = F.struct(F.when(F.col("s_suppkey") % 2 == 0, "library").otherwise("file").alias("type"), F.concat(F.lit("pkg:t/b"), "s_suppkey").alias("purl"))
    doc = F.to_json(F.struct(F.array(F.struct(F.lit("application").alias("type"), F.concat(F.lit("pkg:t/a"), "s_suppkey").alias("purl"), F.array(child).alias("components"))).alias("components")))
    return R.sbom_components(s.select(F.col("s_suppkey").alias("sbom"), doc.alias("doc")))


@query("src_image_manifest", "SELECT c_custkey AS image, j AS idx, 'sha256:' || sha256('l' || c_custkey || '-' || j) AS layer FROM customer, (VALUES (0), (1)) AS x(j)")
def src_image_manifest(spark, d):
    """An index leads to the linux/amd64 manifest, whose layers come in order."""
    c = V.load(spark, d, "customer").select(F.col("c_custkey").alias("image"))
    digest = lambda p: F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit(p), F.col("image").cast("string")), 256))
    layers = F.transform(F.array(F.lit(0), F.lit(1)), lambda j: F.struct(F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit("l"), F.col("image").cast("string"), F.lit("-"), j.cast("string")), 256)).alias("digest")))
    index = c.select("image", digest("x").alias("digest"), F.to_json(F.struct(F.array(F.struct(digest("arm").alias("digest"), F.struct(F.lit("linux").alias("os"), F.lit("arm64").alias("architecture")).alias("platform")), F.struct(digest("m").alias("digest"), F.struct(F.lit("linux").alias("os"), F.lit("amd64").alias("architecture")).alias("platform"))).alias("manifests"))).alias("doc"), F.lit(True).alias("top"))
    leaf = c.select("image", digest("m").alias("digest"), F.to_json(F.struct(layers.alias("layers"))).alias("doc"), F.lit(False).alias("top"))
    return R.manifest_layers(index.unionByName(leaf))


# ---- sinks and streams ---------------------------------------------------------------------------------------------------------
@query("snk_append_jsonl", V.with_views("v_event") + " SELECT seq, kind FROM v_event WHERE kind = 'exec'")
def snk_append_jsonl(spark, d):
    """A stream appended exactly once: a second run over the same checkpoint adds nothing."""
    src, out, ck = folder(spark, "src"), folder(spark, "out"), folder(spark, "ck")
    V.v_event(spark, d).select("seq", "kind").repartition(4).write.parquet(src)
    for _ in range(2):
        sinks.append(spark.readStream.schema("seq long, kind string").parquet(src).where("kind = 'exec'"), out, ck)
    return spark.read.parquet(out)


@query("snk_detection_ids", V.with_views("v_event") + " SELECT seq, 'det-' || lpad(CAST(row_number() OVER (ORDER BY t_ns, seq) AS VARCHAR), 4, '0') AS id FROM v_event WHERE kind = 'exec'")
def snk_detection_ids(spark, d):
    """Two batches, the earlier and the later events; the second goes on from the greatest number so far."""
    e = V.v_event(spark, d).where("kind = 'exec'")
    half = e.agg(F.expr("percentile_approx(t_ns, 0.5)")).first()[0] or 0
    first = sinks.numbered(e.where(F.col("t_ns") < half), 0, "t_ns", "seq")
    last = first.agg(F.coalesce(F.max("number"), F.lit(0))).first()[0]
    return first.unionByName(sinks.numbered(e.where((F.col("t_ns") >= half) | F.col("t_ns").isNull()), last, "t_ns", "seq")).select("seq", F.concat(F.lit("det-"), F.lpad(F.col("number").cast("string"), F.greatest(F.lit(4), F.length(F.col("number").cast("string"))), F.lit("0"))).alias("id"))


@query("snk_alert_once", V.with_views("v_event") + " SELECT seq FROM v_event WHERE kind = 'exec'")
def snk_alert_once(spark, d):
    """Batches that overlap alert each detection once."""
    out = folder(spark, "alerts")
    e = V.v_event(spark, d).where("kind = 'exec'").select("seq")
    for batch in (e.where("seq < 6000"), e.where("seq >= 3000"), e):
        sinks.append_new(batch, out, ["seq"])
    return spark.read.parquet(out)


@query("snk_checkpoint_due", "SELECT event_id AS k FROM events WHERE (event_id % 100 = 0 AND event_id % 300 <> 0) OR event_id = (SELECT max(event_id) FROM events)")
def snk_checkpoint_due(spark, d):
    """Every hundredth record and the head, unless signed."""
    k = V.load(spark, d, "events").select(F.col("event_id").alias("k"))
    signed = k.where("k % 300 = 0")
    head = k.agg(F.max("k").alias("k"))
    return k.where("k % 100 = 0").unionByName(head).distinct().join(signed, "k", "left_anti")


@query("snk_atomic_replace", V.with_views("v_file") + " SELECT digest, count(*) AS n, max(CASE WHEN digest = 'i1' THEN 2 ELSE 1 END) AS version FROM v_file GROUP BY 1")
def snk_atomic_replace(spark, d):
    """Overwriting one digest's partition leaves the others."""
    out = folder(spark, "envelopes")
    f = V.v_file(spark, d).select("digest", "path", F.lit(1).alias("version"))
    sinks.replace_partitions(f, out, "digest")
    sinks.replace_partitions(f.where("digest = 'i1'").withColumn("version", F.lit(2)), out, "digest")
    return spark.read.parquet(out).groupBy("digest").agg(F.count("*").alias("n"), F.max("version").alias("version"))


@query("snk_graph_upsert", V.with_views("v_file") + " SELECT 'file' AS kind, count(DISTINCT digest || path) AS n FROM v_file UNION ALL SELECT 'package', count(DISTINCT package) FROM v_file UNION ALL SELECT 'owns', count(DISTINCT package || digest || path) FROM v_file")
def snk_graph_upsert(spark, d):
    """Nodes and edges written twice stay once."""
    out = folder(spark, "graph")
    f = V.v_file(spark, d).withColumn("path", F.concat("digest", "path"))
    rows = f.select(F.lit("file").alias("kind"), F.col("path").alias("a"), F.lit("").alias("b")).unionByName(f.where("package is not null").select(F.lit("package").alias("kind"), F.col("package").alias("a"), F.lit("").alias("b"))).unionByName(f.where("package is not null").select(F.lit("owns").alias("kind"), F.col("package").alias("a"), F.col("path").alias("b")))
    for _ in range(2):
        sinks.append_new(rows.distinct(), out, ["kind", "a", "b"])
    return spark.read.parquet(out).groupBy("kind").agg(F.count("*").alias("n"))


@query("snk_log_append", "WITH RECURSIVE r AS (SELECT row_number() OVER (ORDER BY conv_id, turn) AS k, sha256(text) AS c FROM conversations), h AS (SELECT k, sha256(unhex(repeat('0', 64) || c)) AS hash FROM r WHERE k = 1 UNION ALL SELECT r.k, sha256(unhex(h.hash || r.c)) FROM r JOIN h ON r.k = h.k + 1) SELECT k, hash FROM h")
def snk_log_append(spark, d):
    """Batches of records are appended to one chain, each going on from the head; a batch that comes again adds nothing."""
    out = folder(spark, "log")
    c = V.load(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("order"), F.col("text").alias("canon"))
    for i, batch in enumerate((c.where("order < 2000"), c.where("order < 2000"), c.where("order >= 2000"))):
        sinks.append_chain(batch, out, batch_id=max(0, i - 1))
    return spark.read.parquet(out).select("k", "hash")


@query("snk_report_tables", "SELECT c_mktsegment AS name, '| ' || c_mktsegment || ' | ' || count(*) || ' |' AS line FROM customer GROUP BY 1")
def snk_report_tables(spark, d):
    n = V.load(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("name")).agg(F.count("*").alias("n"))
    return n.select("name", F.format_string("| %s | %d |", "name", "n").alias("line"))


@query("str_clock", V.with_views("v_event") + " SELECT cid, max(t_ns) AS clock FROM v_event GROUP BY 1")
def str_clock(spark, d):
    """The clock is the greatest time seen, however late rows come."""
    src, out, ck = folder(spark, "clock"), folder(spark, "clock-out"), folder(spark, "ck")
    V.v_event(spark, d).select("cid", "t_ns").repartition(3).write.parquet(src)
    rows = spark.readStream.schema("cid string, t_ns long").parquet(src).groupBy("cid").agg(F.max("t_ns").alias("clock"))
    sinks.latest(rows, out, ck)
    return spark.read.parquet(out).groupBy("cid").agg(F.max("clock").alias("clock"))


@query("str_dimension_refresh", V.with_views("v_event", "v_binding") + " SELECT e.cid, b.image_digest, count(*) AS n FROM v_event e JOIN v_binding b ON b.container_id = e.cid GROUP BY 1, 2")
def str_dimension_refresh(spark, d):
    """The binding table is read anew for each batch of the stream."""
    src, dim, out, ck = (folder(spark, x) for x in ("src", "dim", "out", "ck"))
    V.v_event(spark, d).select("cid", "seq").repartition(2).write.parquet(src)
    V.v_binding(spark, d).select(F.col("container_id").alias("cid"), "image_digest").write.parquet(dim)
    sinks.joined_batches(spark.readStream.schema("cid string, seq long").parquet(src), dim, ["cid"], out, ck)
    return spark.read.parquet(out).groupBy("cid", "image_digest").agg(F.count("*").alias("n"))


@query("str_alert_tail", V.with_views("v_event") + " SELECT kind, count(*) AS n FROM v_event WHERE path IS NOT NULL GROUP BY 1")
def str_alert_tail(spark, d):
    src, out, ck = folder(spark, "tail"), folder(spark, "tail-out"), folder(spark, "ck")
    V.v_event(spark, d).select("kind", "path").write.parquet(src)
    sinks.append(spark.readStream.schema("kind string, path string").parquet(src).where("path is not null"), out, ck)
    return spark.read.parquet(out).groupBy("kind").agg(F.count("*").alias("n"))


@query("str_live_latency", "SELECT event_type, count(*) AS n, min(CAST(floor(value * 1000) AS BIGINT)) AS least_us, max(CAST(floor(value * 1000) AS BIGINT)) AS most_us, avg(CAST(floor(value * 1000) AS BIGINT)) AS mean_us FROM events WHERE value IS NOT NULL GROUP BY 1")
def str_live_latency(spark, d):
    """Arrival less event time of a stream as it runs. Rows carry when they arrived (here `value` milliseconds after the event), as a source's ingest time would say."""
    src, out, ck = (folder(spark, x) for x in ("arrivals", "latencies", "ck"))
    e = V.load(spark, d, "events").where("value is not null").withColumn("at_us", V.micros("ts"))
    e.select("event_type", "at_us", (F.col("at_us") + F.floor(F.col("value") * 1000)).alias("arrived_us")).write.parquet(src)
    rows = spark.readStream.schema("event_type string, at_us long, arrived_us long").parquet(src)
    sinks.append(rows.select("event_type", (F.col("arrived_us") - F.col("at_us")).alias("us")), out, ck)
    return spark.read.schema("event_type string, us long").parquet(out).groupBy("event_type").agg(F.count("*").alias("n"), F.min("us").alias("least_us"), F.max("us").alias("most_us"), F.avg("us").alias("mean_us"))


@query("str_window_timer", "WITH w AS (SELECT user_id AS c, (epoch_us(ts) // 3600000000) * 3600000000 AS start_us, count(*) AS n FROM events GROUP BY 1, 2) SELECT * FROM w WHERE start_us + 3600000000 <= (SELECT max(epoch_us(ts)) FROM events)")
def str_window_timer(spark, d):
    """Windows close when the stream's clock, the watermark, passes their end; those still open at the end are not given."""
    src, out, ck = folder(spark, "timer"), folder(spark, "timer-out"), folder(spark, "ck")
    V.load(spark, d, "events").select(F.col("user_id").cast("long").alias("c"), F.timestamp_micros(V.micros("ts")).alias("at")).write.parquet(src)
    rows = spark.readStream.schema("c long, at timestamp").parquet(src).withWatermark("at", "0 seconds")
    closed = rows.groupBy("c", F.window("at", "1 hour")).agg(F.count("*").alias("n")).select("c", F.unix_micros("window.start").alias("start_us"), "n")
    sinks.append(closed, out, ck)
    return spark.read.schema("c long, start_us long, n long").parquet(out)


@query("str_trust_loop", "WITH k AS (SELECT n_nationkey % 6 AS key_id, max(n_nationkey) AS version FROM nation GROUP BY 1) SELECT c_custkey AS image, version % 2 = 0 AS trusted FROM customer JOIN k ON key_id = c_custkey % 6")
def str_trust_loop(spark, d):
    """Changes of key states come as a stream; each batch evaluates the images of the changed keys, and the newest evaluation counts."""
    src, dim, out, ck = (folder(spark, x) for x in ("keys", "images", "trust", "ck"))
    V.load(spark, d, "nation").select((F.col("n_nationkey") % 6).cast("long").alias("key_id"), F.col("n_nationkey").cast("long").alias("version")).repartition(3).write.parquet(src)
    V.load(spark, d, "customer").select((F.col("c_custkey") % 6).alias("key_id"), F.col("c_custkey").alias("image")).write.parquet(dim)
    sinks.joined_batches(spark.readStream.schema("key_id long, version long").parquet(src), dim, ["key_id"], out, ck)
    newest = spark.read.parquet(out).groupBy("image").agg(F.max("version").alias("version"))
    return newest.select("image", (F.col("version") % 2 == 0).alias("trusted"))
