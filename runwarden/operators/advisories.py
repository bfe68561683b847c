"""Advisories and the packages that they fit: unknown namespaces and versions become keys of their own, so that pairs come from equal keys alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .forest import spread
from .graph import written

#: Advisories and packages of a key that meet in one unit of work, about: its pairs are the square.
BLOCK = 2000


def matches(advisories: DataFrame, packages: DataFrame, block: int = BLOCK) -> DataFrame:
    """(adv, package) of advisories (adv, name, namespace, versions) and packages (package, name, namespace, version): name equal, namespace equal or either
    null, version in versions or versions null.

    Either side gives a row for each key that it can meet the other by, and a pair has one key in common: the namespace itself, `any` if the advisory has none
    or `none` if only the package has none; the version, or `any`. A key of many rows is dealt to units of about `block` times `block` pairs, whose rows
    are sorted and joined by themselves, so no task holds a name and no pair is made that is not returned.
    """
    how = lambda h, v: F.named_struct(F.lit("how"), F.lit(h), F.lit("of"), v)
    any_, none = how("any", F.lit("")), how("none", F.lit(""))
    own = how("own", F.col("namespace"))
    a = advisories.where("name is not null").select(
        "adv", "name", F.explode(F.when(F.col("namespace").isNull(), F.array(any_)).otherwise(F.array(own, none))).alias("ns"),
        F.when(F.col("versions").isNull(), F.array(any_)).otherwise(F.transform(F.array_distinct(F.array_compact("versions")), lambda v: how("own", v))).alias("vs"),
    ).select("adv", "name", "ns", F.explode("vs").alias("v")).select("adv", F.struct("name", "ns", "v").alias("key"))
    p = written(packages.where("name is not null").select("package", "name", "namespace", "version"), "packages")
    p = p.select(
        "package", "name", F.explode(F.array(any_, F.when(F.col("namespace").isNull(), none).otherwise(own))).alias("ns"),
        F.when(F.col("version").isNull(), F.array(any_)).otherwise(F.array(any_, how("own", F.col("version")))).alias("vs"),
    ).select("package", "name", "ns", F.explode("vs").alias("v")).select("package", F.struct("name", "ns", "v").alias("key"))
    count = lambda rows, n: rows.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias(n))
    # Numbered once, in a table.
    units = written(count(a, "rows").join(count(p, "columns"), "key").select(F.monotonically_increasing_id().alias("unit"), "*"), "units")
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int").alias(n[:-1])
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(n[:-1])
    at = ["unit", "row", "column"]
    a = spread(a.join(units, "key").select("adv", "unit", part("adv", "rows"), every("columns")), *at)
    p = spread(p.join(units, "key").select("package", "unit", every("rows"), part("package", "columns")), *at)
    return p.hint("merge").join(a, at).select("adv", "package")
