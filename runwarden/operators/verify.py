"""Decide events against their image's specification: joins with the dimensions, then one CASE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

ORIGIN_AUTHENTICATED, ORIGIN_INFERRED, ORIGIN_CONFIGURED = "AUTHENTICATED", "INFERRED", "CONFIGURED"


def under_mount(path: Column, mounts: Column) -> Column:
    """path is a mount or inside one; / covers all; a trailing / is ignored."""

    def inside(m):
        bare = F.regexp_replace(m, "(?<=.)/+$", "")
        return (bare == "/") | (path == bare) | path.startswith(F.concat(bare, F.lit("/")))

    return F.coalesce(F.exists(mounts, inside), F.lit(False))


def with_declared(events: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """events plus the declared file at `path` in their image: f_sha256, f_layer, f_package, in_closure (null: undeclared)."""
    f = files.select(F.col("digest"), F.col("path").alias(path), F.col("sha256").alias("f_sha256"), F.col("layer").alias("f_layer"), F.col("package").alias("f_package"), "in_closure")
    return events.join(f, ["digest", path], "left")


def with_relocated(events: DataFrame, files: DataFrame) -> DataFrame:
    """events plus where else their content is declared: reloc_path (the least path) and reloc_n."""
    by_hash = files.groupBy("digest", F.col("sha256").alias("hash")).agg(F.min("path").alias("reloc_path"), F.count("*").alias("reloc_n"))
    return events.join(by_hash, ["digest", "hash"], "left")


def with_context(rows: DataFrame, packages: DataFrame) -> DataFrame:
    """rows plus declared, depth: of the package that owns the declared file."""
    p = packages.select("digest", F.col("purl").alias("f_package"), F.col("depth"))
    return rows.join(p, ["digest", "f_package"], "left").withColumn("declared", F.col("f_sha256").isNotNull())


def exec_load_outcome(kind: Column, path: Column, exe: Column) -> Column:
    """class/subclass, or `conforming`, of an exec or load; needs with_declared and with_relocated."""
    prefix = F.when(kind == "exec", "D_exec").otherwise("D_load")
    declared = F.col("f_sha256").isNotNull()
    return (
        F.when((kind == "load") & (path == exe), "conforming")
        .when(declared & F.col("hash").isNotNull() & (F.col("hash") != F.col("f_sha256")), "D_hash/modified")
        .when(declared & F.col("in_closure"), "conforming")
        .when(declared, F.concat(prefix, F.lit("/outside_closure")))
        .when(F.col("reloc_path").isNotNull(), "D_hash/relocated")
        .otherwise(F.concat(prefix, F.lit("/undeclared")))
    )


def first_weak_loads(decided: DataFrame, loader_in_closure: Column, cid: str = "cid", path: str = "path", seq: str = "seq") -> DataFrame:
    """Weak loads are reported once per (container, file), if the loader is in the closure; others become `suppressed`."""
    weak = F.col("outcome") == "D_load/outside_closure"
    eligible = weak & F.coalesce(loader_in_closure, F.lit(False))
    nth = F.row_number().over(Window.partitionBy(cid, path, eligible).orderBy(seq))
    return decided.withColumn("outcome", F.when(weak & ~(eligible & (nth == 1)), "suppressed").otherwise(F.col("outcome")))


def write_outcome(path: Column, mounts: Column) -> Column:
    """A write conforms under a mount, without a path, or to an undeclared file."""
    return F.when(path.isNull() | under_mount(path, mounts) | F.col("f_sha256").isNull(), "conforming").otherwise("D_write/declared_file")


def cap_outcome(granted: Column, cap: Column, allowed: Column) -> Column:
    """Null granted counts as used."""
    conforms = (F.coalesce(granted, F.lit(True)) == F.lit(False)) | cap.isNull() | F.coalesce(F.array_contains(allowed, cap), F.lit(False))
    return F.when(conforms, "conforming").otherwise("D_cap/not_in_envelope")
