"""Readers of the sources: text, JSON and CSV files as Spark reads them, with what cannot be read left out or kept as reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(seq, line): lines of text files, blank ones skipped. seq orders lines within a file only."""
    return spark.read.text(path).where("trim(value) <> ''").select(F.monotonically_increasing_id().alias("seq"), F.col("value").alias("line"))


def tolerant_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Bad lines are dropped; a path that is not there is an empty table."""
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def named_documents(spark: SparkSession, path: str, schema: str, own: str = "image") -> DataFrame:
    """JSON documents in folders name=<own name>: those that parse, are complete and have the name in them."""
    rows = spark.read.option("wholetext", True).text(path)
    doc = rows.select("name", F.from_json("value", schema).alias("d")).where("d is not null")
    complete = F.lit(True)
    for f in doc.schema["d"].dataType.names:
        complete = complete & F.col(f"d.{f}").isNotNull()
    return doc.where(complete & (F.col(f"d.{own}") == F.col("name"))).select("d.*")


def syscall_trace(spark: SparkSession, path: str) -> DataFrame:
    """(t_ns, pid, comm, call) of tab-separated lines, or lines with a call alone."""
    part = F.split("value", "\t")
    rows = spark.read.text(path).where("value not like '#%' and trim(value) <> ''")
    many = F.size(part) >= 4
    call = F.regexp_replace(F.when(many, F.get(part, F.lit(3))).otherwise(F.trim("value")), "^(sys_enter_|sys_exit_|__x64_sys_|sys_)", "")
    out = rows.select(F.when(many, F.get(part, F.lit(0)).try_cast("bigint")).alias("t_ns"), F.when(many, F.get(part, F.lit(1)).try_cast("bigint")).alias("pid"), F.when(many, F.get(part, F.lit(2))).alias("comm"), call.alias("call"))
    return out.where(F.col("call").rlike("^[a-z_][a-z0-9_]*$") & ~F.coalesce(F.col("comm").startswith("runc"), F.lit(False)))


def package_stanzas(spark: SparkSession, path: str) -> DataFrame:
    """(name, version, arch) of installed packages: stanzas are parted by blank lines."""
    field = lambda f: F.regexp_extract("value", rf"(?m)^{f}: *(.*)$", 1)
    rows = spark.read.option("lineSep", "\n\n").text(path).where("trim(value) <> ''")
    status = F.try_element_at(F.split(F.trim(field("Status")), " +"), F.lit(3))
    return rows.where(status == "installed").select(F.trim(field("Package")).alias("name"), F.trim(field("Version")).alias("version"), F.trim(field("Architecture")).alias("arch"))


def claimed_paths(spark: SparkSession, path: str) -> DataFrame:
    """(package, path) of list files in folders package=<name>."""
    return spark.read.text(path).where("value <> '' and value <> '/.'").select("package", F.col("value").alias("path"))


def statements(rows: DataFrame) -> DataFrame:
    """rows (line, payload) with predicate_type and subjects of the payload's JSON; base64 of either alphabet, padded or not."""
    plain = F.regexp_replace(F.translate("payload", "-_", "+/"), "[=\\s]+$", "")
    padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), "=")
    ok = plain.rlike("^[A-Za-z0-9+/]+$") & (F.length(plain) % 4 != 1)
    text = F.when(ok, F.unbase64(F.when(ok, padded)).cast("string"))
    v = F.try_parse_json(text)
    return rows.withColumn("predicate_type", F.try_variant_get(v, "$.predicateType", "string")).withColumn("subject", F.try_variant_get(v, "$.subject", "array<variant>"))


def _walked(level: DataFrame, step, name: str):
    """Every level of a nesting, one after another, until there is none further down: step(level) gives the next. A level is a table of its own, in text form."""
    from ..operators.graph import written

    while True:
        level = written(level, name)
        if level.isEmpty():
            return
        yield level
        level = step(level)


def sbom_components(rows: DataFrame) -> DataFrame:
    """(sbom, purl) of documents (sbom, doc): each round takes the components one level further down, as deep as they go."""
    inner = lambda doc: F.explode(F.transform(F.try_variant_get(F.try_parse_json(doc), "$.components", "array<variant>"), lambda c: F.to_json(c))).alias("c")
    out = rows.sparkSession.createDataFrame([], "sbom long, c string")
    for level in _walked(rows.select("sbom", inner("doc")), lambda x: x.select("sbom", inner("c")), "components"):
        out = out.unionByName(level)
    c = F.try_parse_json("c")
    kind, purl = F.try_variant_get(c, "$.type", "string"), F.try_variant_get(c, "$.purl", "string")
    return out.where(kind.isin("library", "application", "framework") & purl.isNotNull()).select("sbom", purl.alias("purl"))


def manifest_layers(documents: DataFrame, levels: int = 3) -> DataFrame:
    """(image, idx, layer): documents (image, digest, doc, top) are followed from the top through indexes to the linux/amd64 manifest."""
    schema = "manifests array<struct<digest: string, platform: struct<os: string, architecture: string>>>, layers array<struct<digest: string>>"
    docs = documents.select("image", "digest", "top", F.from_json("doc", schema).alias("m"))
    now = docs.where("top").select("image", "m")
    for _ in range(levels):
        child = F.get(F.filter("m.manifests", lambda x: (x["platform"]["os"] == "linux") & (x["platform"]["architecture"] == "amd64")), F.lit(0))["digest"]
        step = now.where("m.layers is null").select("image", child.alias("digest")).join(docs.select("image", "digest", "m"), ["image", "digest"]).select("image", "m")
        now = now.where("m.layers is not null").unionByName(step)
    return now.where("m.layers is not null").select("image", F.posexplode("m.layers").alias("idx", "l")).select("image", "idx", F.col("l.digest").alias("layer"))
