"""Symlinks of images: paths resolved as a kernel does, by rounds over whole tables, and one table of resolved folders that lookups share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .graph import written

MAX_HOPS = 40


def _plain(path: Column) -> Column:
    """Without empty parts and `.`; `..` stays."""
    return F.concat(F.lit("/"), F.array_join(F.filter(F.split(path, "/"), lambda p: (p != "") & (p != ".")), "/"))


def folder_of(path: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(path, "/[^/]*$", ""), F.lit("")), F.lit("/"))


def below(folder: Column, base: Column) -> Column:
    """base in a folder; null if the folder is."""
    return F.concat(F.when(folder == "/", "").otherwise(folder), F.lit("/"), base)


def resolve_links(paths: DataFrame, links: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """(digest, path, real) of the distinct absolute paths (digest, path) under links (digest, path, target).

    Each round takes the first linked part of every path that still has one, and puts the link's target in its place; `..` leads out of the resolved folder, not out of the link. A path that comes
    back to where it was, or needs more than `max_hops` links, is a loop: null. Targets are absolute or relative to the link's folder; a link without target gives null.
    """
    todo = paths.select("digest", "path").where("path is not null").distinct().select("digest", "path", _plain(F.col("path")).alias("now"), F.lit(0).alias("hops"), F.array().cast("array<string>").alias("been"))
    todo = written(todo, "paths")
    links = written(links.select("digest", F.col("path").alias("link"), "target").distinct(), "links")
    done = None
    while True:
        parts = F.slice(F.split("now", "/"), 2, 1 << 30)
        up = F.array_position(parts, "..")  # only what stands before the first `..` can be looked up
        known = F.when(up > 0, F.slice(parts, F.lit(1), (up - 1).cast("int"))).otherwise(parts)
        prefixes = F.transform(F.sequence(F.lit(1), F.size("known")), lambda n: F.concat(F.lit("/"), F.array_join(F.slice("known", F.lit(1), n), "/")))
        todo = todo.withColumn("up", up).withColumn("parts", parts).withColumn("known", known)
        each = todo.where(F.size("known") > 0).select("digest", "path", F.explode(prefixes).alias("link")).join(links, ["digest", "link"])
        first = each.groupBy("digest", "path").agg(F.min_by(F.struct("link", "target"), F.length("link")).alias("l"))
        rows = todo.join(first, ["digest", "path"], "left")
        rest = F.substring("now", F.length("l.link") + 1, F.lit(1 << 30))
        target = F.when(F.col("l.target").startswith("/"), F.col("l.target")).otherwise(below(folder_of(F.col("l.link")), F.col("l.target")))
        out_of = F.concat(F.lit("/"), F.array_join(F.concat(F.slice("parts", F.lit(1), F.greatest(F.col("up") - 2, F.lit(0)).cast("int")), F.slice("parts", (F.col("up") + 1).cast("int"), F.lit(1 << 30))), "/"))
        linked = F.col("l").isNotNull()
        then = F.when(linked & F.col("l.target").isNotNull(), _plain(F.concat(target, rest))).when(~linked & (F.col("up") > 0), out_of).when(~linked, F.col("now"))
        rows = written(rows.select("digest", "path", then.alias("then"), (~linked & (F.col("up") == 0)).alias("ended"), (F.col("hops") + linked.cast("int")).alias("hops"), F.when(linked, F.array_append("been", F.col("now"))).otherwise(F.col("been")).alias("been")), "hops")
        looped = F.array_contains("been", F.col("then")) | (F.col("hops") > max_hops) | F.col("then").isNull()
        settled = rows.where(F.col("ended") | looped).select("digest", "path", F.when(F.col("ended"), F.col("then")).alias("real"))
        done = settled if done is None else done.unionByName(settled)
        todo = rows.where(~F.col("ended") & ~looped).select("digest", "path", F.col("then").alias("now"), "hops", "been")
        if todo.isEmpty():
            return done


def resolved_folders(paths: DataFrame, links: DataFrame) -> DataFrame:
    """(digest, folder, real): the folders of paths (digest, path), each once."""
    rows = paths.select("digest", folder_of(F.col("path")).alias("path")).distinct()
    return written(resolve_links(rows, links).select("digest", F.col("path").alias("folder"), "real"), "folders")


def with_key(rows: DataFrame, folders: DataFrame, path: str = "path", out: str = "key") -> DataFrame:
    """rows plus `out`: their path with its folder resolved, null if that is a loop; folders as resolved_folders gives them."""
    known = folders.select("digest", F.col("folder").alias("folder_"), F.col("real").alias("real_"))
    joined = rows.withColumn("folder_", folder_of(F.col(path))).join(known, ["digest", "folder_"], "left")
    return joined.withColumn(out, below(F.col("real_"), F.regexp_extract(path, "([^/]*)$", 1))).drop("folder_", "real_")


def with_real(rows: DataFrame, links: DataFrame, path: str = "path", out: str = "real") -> DataFrame:
    """rows plus `out`: their path fully resolved. Folders are resolved once each; only keys that are links themselves are resolved further."""
    keyed = with_key(rows, resolved_folders(rows.select("digest", F.col(path).alias("path")), links), path, out)
    own = keyed.select("digest", F.col(out).alias("path")).join(links.select("digest", "path"), ["digest", "path"], "left_semi")
    last = resolve_links(own, links).select("digest", F.col("path").alias(out), F.col("real").alias("last_"), F.lit(True).alias("again_"))
    return keyed.join(last, ["digest", out], "left").withColumn(out, F.when(F.col("again_"), F.col("last_")).otherwise(F.col(out))).drop("last_", "again_")


def _offered(rows: DataFrame, by: DataFrame, kind: str) -> DataFrame:
    keyed = with_key(rows, resolved_folders(rows, by)).where("key is not null")
    return keyed.select("digest", "key", "layer", (F.col("key") == F.col("path")).alias("own"), F.lit(kind).alias("kind"), "target")


_RANK = ("layer", "own", "kind")


def canonical_links(links: DataFrame) -> DataFrame:
    """(digest, path, target, layer) of links of the same columns, at keys whose folders are resolved; the winner of each key, as `canonical` says. What lookups go by."""
    own = _offered(links, links, "link")
    won = own.groupBy("digest", "key").agg(F.max_by(F.struct("target", "layer"), F.struct(*_RANK)).alias("w"))
    return written(won.select("digest", F.col("key").alias("path"), "w.*"), "canonical-links")


def canonical(files: DataFrame, links: DataFrame) -> DataFrame:
    """(digest, path, layer, kind): the keys of files (digest, path, layer) and links (digest, path, target, layer) with their folders resolved.

    Of those that meet at one key the highest layer wins, then what was there by its own name, then a link. Links come first, and files are resolved against the links that won. Keys in loops are dropped.
    """
    both = _offered(links, links, "link").unionByName(_offered(files.withColumn("target", F.lit(None).cast("string")), canonical_links(links), "file"))
    return both.groupBy("digest", F.col("key").alias("path")).agg(F.max(F.struct(*_RANK)).alias("r")).select("digest", "path", "r.layer", "r.kind")
