"""Places and exact quantiles of whole tables and of large groups, without one task that holds a group.

Rows are dealt by ranges of their order; each partition is numbered by itself and told how many rows stand before it. Quantiles are found from counts of values that narrow: a
histogram of a group's value range, the step that holds the wanted place, a histogram of that step, until a step holds one value or few rows, which are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .graph import written


def ordered_places(rows: DataFrame, order: list) -> DataFrame:
    """rows plus place: 1, 2, ... in the given order of the whole table. Partitions are ranges, so no task sorts more than its range; only their sizes are put in one order."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # What is numbered must not change between the two passes over it, so it is a written table in range order.
    kept = written(ranged.select("*", F.monotonically_increasing_id().alias("nth_")), "ordered")
    part = F.shiftright("nth_", 33)
    sizes = kept.groupBy(part.alias("part_")).agg(F.count("*").alias("n_"))
    before = sizes.select("part_", F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
    inside = F.col("nth_").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return kept.withColumn("part_", part).join(before, "part_").withColumn("place", F.col("before_") + inside).drop("nth_", "part_", "n_", "before_")


#: Steps of a histogram, and rows that are sorted once a step holds no more.
STEPS, FEW = 1024, 100_000


def _counted(rows: DataFrame, keys: list[str], value: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(group, v) of the values that are not null, as a table, (group, n, lo, hi), and (group, keys): a group is its keys as one text, nulls included."""
    group = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("group")
    own = written(rows.where(F.col(value).isNotNull()).select(group, F.col(value).cast("double").alias("v"), F.struct(*keys).alias("keys")), "values")
    counted = own.groupBy("group").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.any_value("keys").alias("keys"))
    counted = written(counted, "groups")
    return own.select("group", "v"), counted.drop("keys"), counted.select("group", "keys.*")


def quantiles(rows: DataFrame, keys: list[str], value: str, *at: float) -> DataFrame:
    """(keys, n, p, value) for each p in `at`: the linear quantile of the finite doubles of each group, exact. Nulls are left out; groups without values have no rows.

    The place (n - 1) * p lies between two values, which are found as the k-th and the next smallest.
    """
    own, counted, names = _counted(rows, keys, value)
    place = (F.col("n") - 1) * F.col("p")
    wanted = counted.select("*", F.explode(F.array(*map(F.lit, at))).alias("p")).withColumn("k0", F.floor(place)).withColumn("k1", F.ceil(place)).withColumn("share", place - F.floor(place))
    found = kth(own, wanted.select("group", "n", "lo", "hi", F.explode(F.array("k0", "k1")).alias("k")))
    low, high = found.withColumnsRenamed({"k": "k0", "v": "v0"}), found.withColumnsRenamed({"k": "k1", "v": "v1"})
    # Between equal values nothing is added, so that what is exact stays exact.
    out = wanted.join(low, ["group", "k0"]).join(high, ["group", "k1"]).select("group", "n", "p", (F.col("v0") + (F.col("v1") - F.col("v0")) * F.col("share")).alias("value"))
    return names.join(out, "group").drop("group")


def nearest_ranks(rows: DataFrame, keys: list[str], value: str, **at: float) -> DataFrame:
    """(keys, mean) and, by name, the value at place round-half-even(p * (n - 1)) of each group."""
    own, counted, names = _counted(rows, keys, value)
    wanted = counted.select("*", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(p).alias("p")) for n, p in at.items()))).alias("w"))
    wanted = wanted.select("group", "n", "lo", "hi", F.col("w.name").alias("name"), F.bround(F.col("w.p") * (F.col("n") - 1), 0).cast("long").alias("k"))
    named = wanted.join(kth(own, wanted.select("group", "n", "lo", "hi", "k")), ["group", "k"]).groupBy("group").agg(*(F.max(F.when(F.col("name") == n, F.col("v"))).alias(n) for n in at))
    return names.join(named.join(own.groupBy("group").agg(F.avg("v").alias("mean")), "group"), "group").drop("group")


def kth(own: DataFrame, want: DataFrame, few: int = FEW, steps: int = STEPS) -> DataFrame:
    """(group, k, v): the value at place k (from 0) of each group of own (group, v); want has (group, k, n, lo, hi)."""
    todo = written(want.distinct().select("group", "k", F.lit(0).cast("long").alias("before"), F.col("n").alias("held"), "lo", "hi"), "wanted")
    done = None
    for _ in range(200):
        # One value alone, or few rows: settled. Else the step that holds the place.
        ready = todo.where((F.col("lo") == F.col("hi")) | (F.col("held") <= few))
        flat = ready.where("lo = hi").select("group", "k", F.col("lo").alias("v"))
        spans = ready.where("lo < hi").select("group", "lo", "hi", "before").distinct()
        inside = own.join(spans, "group").where("v >= lo and v <= hi").groupBy("group", "lo", "hi", "before", "v").agg(F.count("*").alias("c"))
        inside = inside.withColumn("till", F.col("before") + F.sum("c").over(Window.partitionBy("group", "lo", "hi").orderBy("v")))
        hit = ready.where("lo < hi").join(inside, ["group", "lo", "hi", "before"]).where("k < till and k >= till - c").select("group", "k", "v")
        settled = written(flat.unionByName(hit), "settled")
        done = settled if done is None else done.unionByName(settled)
        todo = written(todo.where((F.col("lo") < F.col("hi")) & (F.col("held") > few)), "wanted")
        if todo.isEmpty():
            break
        # Both ends of a span are values, so that every round shrinks it.
        spans = todo.select("group", "lo", "hi").distinct()
        width = F.col("hi") / steps - F.col("lo") / steps
        step = F.when(width > 0, F.least(F.lit(steps - 1), F.floor((F.col("v") - F.col("lo")) / width))).otherwise((F.col("v") > F.col("lo")).cast("long")).cast("long")
        hist = own.join(spans, "group").where("v >= lo and v <= hi").groupBy("group", "lo", "hi", step.alias("step")).agg(F.count("*").alias("c"), F.min("v").alias("a"), F.max("v").alias("b"))
        hist = hist.withColumn("till", F.sum("c").over(Window.partitionBy("group", "lo", "hi").orderBy("step")))
        at = F.col("k") - F.col("before")
        narrower = todo.join(hist, ["group", "lo", "hi"]).where((at < F.col("till")) & (at >= F.col("till") - F.col("c")))
        todo = written(narrower.select("group", "k", (F.col("before") + F.col("till") - F.col("c")).alias("before"), F.col("c").alias("held"), F.col("a").alias("lo"), F.col("b").alias("hi")), "wanted")
    else:
        raise RuntimeError("places were not found")
    return done


def running(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, maxes: dict[str, Column] | None = None) -> DataFrame:
    """rows plus running sums and maxima of each key's rows up to and with each row, in order; keys must not be null.

    Rows are dealt by ranges of (keys, order), so that a hot key is many partitions' work: each partition has its own running values, and takes over what the partitions before it came to.
    """
    sums, maxes = sums or {}, maxes or {}
    wanted = {n: F.sum(c) for n, c in sums.items()} | {n: F.max(c) for n, c in maxes.items()}
    ranged = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    kept = written(ranged.withColumn("part_", F.spark_partition_id()), "ranges")
    pieces = kept.groupBy(*keys, "part_").agg(*(c.alias(n) for n, c in wanted.items()))
    before = Window.partitionBy(*keys).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    carry = pieces.select(*keys, "part_", *((F.sum if n in sums else F.max)(n).over(before).alias(f"{n}_before") for n in wanted))
    till = Window.partitionBy(*keys, "part_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = kept.select("*", *(c.over(till).alias(n) for n, c in wanted.items())).join(carry, [*keys, "part_"])
    both = {n: F.coalesce(F.col(f"{n}_before"), F.lit(0)) + F.col(n) if n in sums else F.greatest(f"{n}_before", n) for n in wanted}
    return out.withColumns(both).drop("part_", *(f"{n}_before" for n in wanted))
