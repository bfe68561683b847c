"""Egress allow lists over IPv4 and IPv6: entries become prefixes of address bits, connects look them up by equal prefixes.

An address is its bits as text, so a network is the first `bits` characters of each of its addresses, and its addresses are the interval of all texts with that beginning.
Networks either lie within each other or are disjoint: those within another one of the same port, or of any port, are dropped, which leaves disjoint
intervals for each version and port. Rules are looked up by equality on (version, prefix, port), once for each prefix length that occurs (129 and 33 at
most), so no connect is held against rules that do not fit it, however many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .graph import written

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"


def with_bits(rows: DataFrame, address: str, out: str) -> DataFrame:
    """rows plus `out`: the bits of an IPv4 or IPv6 address as text, whose length tells the version; null if it is neither.

    Of IPv6, the last two groups may be in IPv4 form, and a zone after % is left out. Each step is a column of its own, so that no step is computed twice.
    """
    c = lambda n: F.col(f"{out}_{n}")
    v6 = F.contains(F.col(address), F.lit(":"))
    steps = {
        "text": F.when(v6, F.lower(F.regexp_replace(address, r"%[^%/:]+$", ""))).otherwise(F.col(address)),
        "v4": F.regexp_extract(c("text"), rf"(?:^|:)({_V4})$", 1),
        "octets": F.transform(F.split(c("v4"), r"\."), lambda p: p.try_cast("long")),
        # What stands before an IPv4 part, with two groups for it.
        "plain": F.when(
            c("v4") != "",
            F.concat(F.left(c("text"), F.length(c("text")) - F.length(c("v4"))), F.lower(F.hex(c("octets")[0] * 256 + c("octets")[1])), F.lit(":"), F.lower(F.hex(c("octets")[2] * 256 + c("octets")[3]))),
        ).otherwise(c("text")),
        "halves": F.split(c("plain"), "::"),
        "head": F.filter(F.split(c("halves")[0], ":"), lambda g: (g != "") | (c("halves")[0] != "")),
        "tail": F.filter(F.split(F.coalesce(F.get(c("halves"), F.lit(1)), F.lit("")), ":"), lambda g: (g != "") | (F.coalesce(F.get(c("halves"), F.lit(1)), F.lit("")) != "")),
        "gap": 8 - F.size(c("head")) - F.size(c("tail")),
        "groups": F.concat(c("head"), F.array_repeat(F.lit("0"), F.greatest(c("gap"), F.lit(0))), c("tail")),
        "whole": F.when(F.size(c("halves")) == 2, c("gap") >= 1).otherwise((F.size(c("halves")) == 1) & (c("gap") == 0)) & F.forall(c("groups"), lambda g: g.rlike("^[0-9a-f]{1,4}$")),
    }
    known = rows
    for name, column in steps.items():
        known = known.withColumn(f"{out}_{name}", column)
    bits4 = F.array_join(F.transform(c("octets"), lambda p: F.lpad(F.bin(p), 8, "0")), "")
    bits6 = F.array_join(F.transform(c("groups"), lambda g: F.lpad(F.conv(g, 16, 2), 16, "0")), "")
    bits = F.when(~v6, F.when(c("v4") == c("text"), F.when(c("v4") != "", bits4))).otherwise(F.when(c("whole"), bits6))
    return known.withColumn(out, bits).drop(*(f"{out}_{n}" for n in steps))


def parsed(entries: DataFrame) -> DataFrame:
    """(entry, version, prefix, port, refused) of entries (entry): `net`, `net:port`, `[v6]:port`, `*`, `*:port`.

    version is 4, 6, or 0 for any address, which only `*` or nothing before the port says; prefix is the network's bits, host bits left out; a null port is any port. What is not
    understood has refused true and allows nothing. Null and blank entries are refused.
    """
    rows = entries.select("entry", F.trim("entry").alias("e")).withColumn("inside", F.col("e").startswith("["))
    colons = F.length("e") - F.length(F.replace("e", F.lit(":"), F.lit("")))
    rows = rows.withColumn("one", (colons == 1) & ~F.col("inside"))
    rows = rows.withColumn("net", F.when(F.col("inside"), F.regexp_extract("e", r"^\[([^\]]*)\]", 1)).when(F.col("one"), F.split_part("e", F.lit(":"), F.lit(1))).otherwise(F.col("e")))
    rows = rows.withColumn("has_port", F.when(F.col("inside"), ~F.col("e").endswith("]")).otherwise(F.col("one")))
    rows = rows.withColumn("port_text", F.when(F.col("inside"), F.regexp_extract("e", r"^\[[^\]]*\]:(.*)$", 1)).otherwise(F.split_part("e", F.lit(":"), F.lit(2))))
    port = F.when(F.col("has_port") & F.col("port_text").rlike(r"^\d{1,5}$"), F.col("port_text").try_cast("int"))
    rows = rows.withColumn("port", F.when(port <= 65535, port))
    rows = with_bits(rows.withColumn("address", F.split_part("net", F.lit("/"), F.lit(1))), "address", "bits")
    mask = F.regexp_extract("net", r"^[^/]*/(\d{1,3})$", 1).try_cast("int")
    rows = rows.withColumn("size", F.when(F.contains("net", F.lit("/")), mask).otherwise(F.length("bits")))
    rows = rows.withColumn("anywhere", F.col("net").isin("*", "") & ~F.col("inside"))
    closed = ~F.col("inside") | F.col("e").rlike(r"^\[[^\]]*\](:.*)?$")
    fits = F.col("anywhere") | (F.col("bits").isNotNull() & F.col("size").isNotNull() & (F.col("size") <= F.length("bits")))
    rows = rows.withColumn("good", F.coalesce((F.col("e") != "") & closed & fits & (~F.col("has_port") | F.col("port").isNotNull()), F.lit(False)))
    version = F.when(F.col("anywhere"), 0).when(F.length("bits") == 32, 4).otherwise(6)
    prefix = F.when(F.col("anywhere"), "").otherwise(F.left("bits", F.col("size")))
    return rows.select("entry", *(F.when(F.col("good"), x).alias(n) for n, x in (("version", version), ("prefix", prefix), ("port", F.col("port")))), (~F.col("good")).alias("refused"))


def rules_of(entries: DataFrame, strict: bool = True) -> DataFrame:
    """(version, prefix, port): the disjoint rules of entries. A refused entry is an error, or with strict=False left out, never a rule."""
    rows = written(parsed(entries), "egress-entries")
    if strict:
        bad = [r.entry for r in rows.where("refused").select("entry").limit(5).collect()]
        if bad:
            raise ValueError(f"egress entries that are not understood: {bad}")
    return written(disjoint(written(rows.where("not refused").select("version", "prefix", "port").distinct(), "egress-rules")), "egress-disjoint")


def _lengths(rules: DataFrame) -> dict[int, list[int]]:
    """The prefix lengths that occur for each version: 33 and 129 at most."""
    out: dict[int, list[int]] = {}
    for r in rules.where("version > 0").select("version", F.length("prefix").alias("n")).distinct().collect():
        out.setdefault(r.version, []).append(r.n)
    return {v: sorted(ns) for v, ns in out.items()}


def _beginnings(bits: Column, version: Column, lengths: dict[int, list[int]]) -> Column:
    """The beginnings of an address that can be a rule's prefix."""
    none = F.array().cast("array<string>")
    of = lambda v: F.transform(F.array(*map(F.lit, lengths[v])), lambda n: F.left(bits, n)) if v in lengths else none
    return F.when(version == 4, of(4)).when(version == 6, of(6)).otherwise(none)


def disjoint(rules: DataFrame) -> DataFrame:
    """rules without those that another rule of the same port, or of any port, covers."""
    lengths = _lengths(rules)
    rows = rules.withColumn("row", F.struct("version", "prefix", "port"))
    shorter = F.filter(_beginnings(F.col("prefix"), F.col("version"), lengths), lambda p: F.length(p) <= F.length("prefix"))
    up = rows.select("row", "version", "port", F.explode(F.array_distinct(shorter)).alias("up"))
    w = rules.select(F.col("version").alias("w_version"), F.col("prefix").alias("w_prefix"), F.col("port").alias("w_port"))
    wider = (F.col("version") == F.col("w_version")) & (F.col("up") == F.col("w_prefix"))
    covers = F.when(F.col("w_port").isNull(), (F.col("up") != F.col("row.prefix")) | F.col("port").isNotNull()).otherwise((F.col("w_port") == F.col("port")) & (F.col("up") != F.col("row.prefix")))
    covered = up.join(w, wider).where(F.coalesce(covers, F.lit(False))).select("row").distinct()
    # Rules for any address cover those of their port, and all if they have none; there is one of each port at most.
    star = rules.where("version = 0").select(F.coalesce("port", F.lit(-1)).alias("star_port")).distinct()
    own = rows.where("version > 0").select("row", F.explode(F.array(F.lit(-1), F.coalesce("port", F.lit(-1)))).alias("star_port")).join(star, "star_port", "left_semi").select("row")
    return rows.join(covered.unionByName(own).distinct(), "row", "left_anti").select("version", "prefix", "port")


def allowed(connects: DataFrame, rules: DataFrame, address: str = "daddr", port: str = "dport") -> DataFrame:
    """connects plus allowed: a rule has their port, or none, and their address, or any. A null or malformed address fits rules for any address only.

    Addresses and ports are looked up once each, however many connects have them.
    """
    lengths = _lengths(rules)
    asked = with_bits(connects.select(F.col(address).alias("a_"), F.col(port).alias("p_")).distinct(), "a_", "bits")
    version = F.when(F.length("bits") == 32, 4).when(F.length("bits") == 128, 6)
    tries = F.transform(_beginnings(F.col("bits"), version, lengths), lambda p: F.struct(version.alias("version"), p.alias("prefix")))
    tries = F.concat(F.array(F.struct(F.lit(0).alias("version"), F.lit("").alias("prefix"))), tries)
    tried = asked.select("a_", "p_", F.explode(tries).alias("t")).select("a_", "p_", "t.version", "t.prefix", F.explode(F.array_distinct(F.array(F.lit(-1), F.coalesce("p_", F.lit(-1))))).alias("on"))
    found = tried.join(rules.select("version", "prefix", F.coalesce("port", F.lit(-1)).alias("on")), ["version", "prefix", "on"], "left_semi").select("a_", "p_").distinct()
    same = connects[address].eqNullSafe(found["a_"]) & connects[port].eqNullSafe(found["p_"])
    return connects.join(found.withColumn("allowed", F.lit(True)), same, "left").withColumn("allowed", F.coalesce("allowed", F.lit(False))).drop("a_", "p_")
