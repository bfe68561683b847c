"""Queries over graphs: dependency depth and paths, closure, links, layers, owners."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import testviews as V
from ..operators import graph as G, links as L
from ..operators.links import resolve_links
from .registry import query

EDGE_SQL = "WITH RECURSIVE e AS (SELECT DISTINCT digest, src, src + 1 + s % 13 AS dst FROM (SELECT l_partkey // 60 AS digest, l_partkey % 60 + CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 0 END AS src, l_suppkey AS s FROM lineitem))"


def v_edge(spark, d):
    """Dependency edges of images of 60 parts, always from a smaller to a greater node; nodes 0, 5, 10, ... depend on nothing."""
    e = V.load(spark, d, "lineitem").selectExpr("l_partkey div 60 AS digest", "l_partkey % 60 + CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 0 END AS src", "l_suppkey AS s")
    return e.selectExpr("digest", "src", "src + 1 + s % 13 AS dst").distinct()


@query("gr_dependency_depth", EDGE_SQL + ", root AS (SELECT DISTINCT digest, src AS node FROM e EXCEPT SELECT digest, dst FROM e), r AS (SELECT digest, node, 1 AS depth FROM root UNION SELECT r.digest, e.dst, r.depth + 1 FROM r JOIN e ON e.digest = r.digest AND e.src = r.node), n AS (SELECT digest, src AS node FROM e UNION SELECT digest, dst FROM e) SELECT n.digest, n.node, min(r.depth) AS depth FROM n LEFT JOIN r ON r.digest = n.digest AND r.node = n.node GROUP BY 1, 2")
def gr_dependency_depth(spark, d):
    return G.depths(v_edge(spark, d), ["digest"])


@query("gr_sbom_edges", EDGE_SQL + " SELECT digest, src, dst FROM e WHERE src <> dst")
def gr_sbom_edges(spark, d):
    return v_edge(spark, d).where("src <> dst")


@query("gr_dependency_path", EDGE_SQL + ", root AS (SELECT DISTINCT digest, src AS node FROM e EXCEPT SELECT digest, dst FROM e), r AS (SELECT digest, node, 0 AS hops FROM root UNION SELECT r.digest, e.dst, r.hops + 1 FROM r JOIN e ON e.digest = r.digest AND e.src = r.node WHERE r.hops < 8) SELECT digest, node, min(hops) AS hops FROM r GROUP BY 1, 2")
def gr_dependency_path(spark, d):
    """Shortest paths of at most eight edges from all roots (ties by nodes); their lengths are compared."""
    e = v_edge(spark, d)
    roots = e.select("digest", F.col("src").alias("node")).distinct().join(e.select("digest", F.col("dst").alias("node")).distinct(), ["digest", "node"], "left_anti")
    return G.shortest_paths(roots, e, ["digest"]).select("digest", "node", (F.size("path") - 1).alias("hops"))


@query("gr_closure_reach", EDGE_SQL + ", r AS (SELECT DISTINCT digest, 7 AS node FROM e UNION SELECT r.digest, e.dst FROM r JOIN e ON e.digest = r.digest AND e.src = r.node) SELECT digest, node FROM r")
def gr_closure_reach(spark, d):
    """What each image's entry point, its node 7, leads to."""
    e = v_edge(spark, d)
    node = lambda c: F.struct("digest", F.col(c).cast("long").alias("node"))
    start = e.select("digest").distinct().select(F.struct("digest", F.lit(7).cast("long").alias("node")).alias("id"))
    return G.reachable(start, e.select(node("src").alias("src"), node("dst").alias("dst"))).select("id.digest", "id.node")


@query("gr_symlink_resolve", V.with_views("v_file") + " SELECT digest, replace(path, '/d1/', '/alias/') AS path, CASE WHEN k % 10 = 2 THEN NULL WHEN k % 10 = 4 THEN NULL WHEN k % 10 = 3 THEN '/d5/real/f' || k ELSE path END AS real FROM v_file")
def gr_symlink_resolve(spark, d):
    """/alias leads over /hop to /d1; /d3 is relative; /d2 dangles; /d4 is a loop."""
    links = spark.createDataFrame([("/alias", "hop"), ("/hop", "/d1"), ("/d3", "./d5/x/../real"), ("/d2", None), ("/d4", "/d4x"), ("/d4x", "/d4")], "path string, target string")
    digests = V.v_file(spark, d).select("digest").distinct()
    files = V.v_file(spark, d).select("digest", F.replace("path", F.lit("/d1/"), F.lit("/alias/")).alias("path"))
    return resolve_links(files, digests.crossJoin(F.broadcast(links)))


#: Files under their own names, through linked folders, and in a folder that is a link.
GIVEN_SQL = "SELECT digest, k, layer, CASE k % 3 WHEN 0 THEN path WHEN 1 THEN '/lnk' || (k % 5) || '/f' || (k % 20) ELSE '/d' || (k % 10) || '/f' || (k % 20) END AS path FROM v_file"


def given_files(spark, d):
    path = F.expr("CASE k % 3 WHEN 0 THEN path WHEN 1 THEN concat('/lnk', k % 5, '/f', k % 20) ELSE concat('/d', k % 10, '/f', k % 20) END")
    return V.v_file(spark, d).select("digest", "k", "layer", path.alias("path"))


@query(
    "gr_canonical_keys",
    V.with_views("v_file") + f", g AS ({GIVEN_SQL}), l AS (SELECT digest, path, 1 AS layer FROM (SELECT DISTINCT digest FROM v_file), (SELECT unnest([{', '.join(repr(a) for a, _ in V.LINKS)}]) AS path)),"
    + f" o AS (SELECT digest, {V.KEY.format(p='path')} AS key, layer, path, 0 AS link FROM g UNION ALL SELECT digest, CASE path WHEN '/lnk2/f12' THEN '/d2/f12' ELSE path END, layer, path, 1 FROM l)"
    + " SELECT digest, key AS path, max(layer) AS layer, CASE arg_max(link, layer * 4 + CASE WHEN key = path THEN 2 ELSE 0 END + link) WHEN 1 THEN 'link' ELSE 'file' END AS kind FROM o WHERE key IS NOT NULL GROUP BY 1, 2",
)
def gr_canonical_keys(spark, d):
    """Keys below linked folders move to the real folder; of those that meet the higher layer wins, then what was there, then a link."""
    return L.canonical(given_files(spark, d), V.v_link(spark, d))


@query("gr_all_dirs", V.with_views("v_file") + " SELECT DISTINCT digest, '/d' || (k % 10) AS dir FROM v_file UNION SELECT DISTINCT digest, '/' FROM v_file")
def gr_all_dirs(spark, d):
    """Every ancestor of a declared file."""
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.coalesce(F.nullif(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("")), F.lit("/")))
    return V.v_file(spark, d).select("digest", F.explode(ancestors).alias("dir")).distinct()


#: Entries of layers: files, whiteouts, opaque folders, hard links to the file of another entry's path, folders in place of files and files in place of folders.
LAYER_ENTRIES = """SELECT l_partkey {div} 60 AS digest, CAST(l_linenumber AS INT) AS layer, l_orderkey * 10 + l_linenumber AS seq,
 CASE WHEN l_partkey % 50 = 3 THEN '/a' || l_partkey % 7 ELSE '/a' || l_partkey % 7 || '/b' || l_partkey % 40 || CASE WHEN l_partkey % 11 = 0 THEN '/c' || l_suppkey % 3 ELSE '' END END AS path,
 CASE l_partkey % 50 WHEN 1 THEN 'whiteout' WHEN 2 THEN 'opaque' WHEN 5 THEN 'hardlink' WHEN 6 THEN 'hardlink' WHEN 7 THEN 'dir' ELSE 'file' END AS kind,
 CASE WHEN l_partkey % 50 IN (5, 6) THEN '/a' || (l_partkey + l_suppkey) % 7 || '/b' || (l_partkey * 3) % 40 END AS target, 'h' || l_suppkey AS sha256 FROM lineitem"""

LAYER_SQL = "WITH x AS (" + LAYER_ENTRIES.format(div="//") + """),
k AS (SELECT digest, path AS at, layer, seq, kind FROM x WHERE kind IN ('whiteout', 'opaque', 'file', 'hardlink')),
p AS (SELECT * FROM x WHERE kind NOT IN ('whiteout', 'opaque')),
alive AS (SELECT p.* FROM p WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.digest = p.digest AND k.kind = 'whiteout' AND k.layer > p.layer AND (k.at = p.path OR starts_with(p.path, k.at || '/')))
 AND NOT EXISTS (SELECT 1 FROM x k WHERE k.digest = p.digest AND k.kind = 'opaque' AND k.layer > p.layer AND starts_with(p.path, regexp_replace(k.path, '/[^/]*$', '') || '/'))
 AND NOT EXISTS (SELECT 1 FROM k WHERE k.digest = p.digest AND k.kind IN ('file', 'hardlink') AND (k.layer, k.seq) > (p.layer, p.seq) AND starts_with(p.path, k.at || '/'))),
last AS (SELECT *, row_number() OVER (PARTITION BY digest, path ORDER BY layer DESC, seq DESC) AS nth FROM alive),
top AS (SELECT * FROM last WHERE nth = 1),
f AS (SELECT digest, path, layer, sha256 FROM top WHERE kind = 'file'),
h AS (SELECT t.digest, t.path, t.layer, (SELECT arg_max(s.sha256, (s.layer, s.seq)) FROM alive s WHERE s.digest = t.digest AND s.path = t.target AND s.kind = 'file' AND s.layer <= t.layer) AS sha256 FROM top t WHERE kind = 'hardlink')
SELECT * FROM f UNION ALL SELECT * FROM h WHERE sha256 IS NOT NULL"""


def layer_union(entries: DataFrame) -> DataFrame:
    """(digest, path, layer, sha256): the files of an image of entries (digest, layer, seq, path, kind, target, sha256).

    A whiteout hides what lower layers have at its path and below it; an opaque entry what they have in its folder; a file (or hard link) at a path hides what came before it
    below that path, and a folder the file that was there. Of entries with one path the last by (layer, seq) counts. Hard links are copied at the
    end: they get the content that the last file at their target had in their own or a lower layer, and vanish if there was none.
    """
    x = G.written(entries, "layer-entries")
    own = F.struct("layer", "seq")
    live = x.where("kind not in ('whiteout', 'opaque')")
    folder = F.regexp_replace("path", "/[^/]*$", "")
    whole = x.where("kind = 'whiteout'").groupBy("digest", F.col("path").alias("at")).agg(F.max("layer").alias("below"))
    inside = x.where("kind = 'opaque'").groupBy("digest", folder.alias("at")).agg(F.max("layer").alias("below_in"))
    files = x.where("kind in ('file', 'hardlink')").groupBy("digest", F.col("path").alias("at")).agg(F.max(own).alias("file_at"))
    marks = whole.join(inside, ["digest", "at"], "full").join(files, ["digest", "at"], "full")
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    above = live.withColumn("at", F.explode(ancestors)).join(marks, ["digest", "at"])
    self_ = F.col("at") == F.col("path")
    dead = above.where((F.col("below") > F.col("layer")) | (~self_ & (F.col("below_in") > F.col("layer"))) | (~self_ & (F.col("file_at") > own))).select("digest", "layer", "seq", "path").distinct()
    alive = G.written(live.join(dead, ["digest", "layer", "seq", "path"], "left_anti"), "layers-alive")
    top = alive.groupBy("digest", "path").agg(F.max_by(F.struct("layer", "kind", "target", "sha256"), own).alias("t")).select("digest", "path", "t.*")
    links = top.where("kind = 'hardlink'").select("digest", "path", "layer", "target")
    sources = alive.where("kind = 'file'").select("digest", F.col("path").alias("target"), F.col("layer").alias("from_layer"), "seq", "sha256")
    copied = links.join(sources, ["digest", "target"]).where("from_layer <= layer").groupBy("digest", "path", "layer").agg(F.max_by("sha256", F.struct("from_layer", "seq")).alias("sha256"))
    return top.where("kind = 'file'").select("digest", "path", "layer", "sha256").unionByName(copied)


@query("gr_layer_union", LAYER_SQL)
def gr_layer_union(spark, d):
    columns, _ = LAYER_ENTRIES.format(div="div").removeprefix("SELECT ").rsplit(" FROM ", 1)
    return layer_union(V.load(spark, d, "lineitem").select(F.expr(f"struct({columns})").alias("e")).select("e.*"))


@query("gr_file_owner", V.with_views("v_file") + f", c0 AS (SELECT digest, CASE k % 4 WHEN 0 THEN '/lnk' || (k % 5) || '/f' || ((k * 7) % 60) WHEN 1 THEN '/rel/f' || ((k * 7) % 60) WHEN 2 THEN '/loop1/f' || k ELSE '/d' || (k % 10) || '/f' || ((k * 7) % 60) END AS path, k AS ord, k % 3 = 0 AS pip, 'own' || k AS name FROM v_file), c AS (SELECT *, {V.KEY.format(p='path')} AS key FROM c0) SELECT f.digest, f.path, arg_max(c.name, (CASE WHEN pip THEN 1000 ELSE 0 END) + ord) AS owner FROM v_file f JOIN c ON c.digest = f.digest AND c.key = f.path GROUP BY 1, 2")
def gr_file_owner(spark, d):
    """The last claim wins, pip after dpkg, for files that exist; claims name paths through linked folders."""
    f = V.v_file(spark, d)
    path = "CASE k % 4 WHEN 0 THEN concat('/lnk', k % 5, '/f', k * 7 % 60) WHEN 1 THEN concat('/rel/f', k * 7 % 60) WHEN 2 THEN concat('/loop1/f', k) ELSE concat('/d', k % 10, '/f', k * 7 % 60) END AS path"
    c = f.selectExpr("digest", path, "k AS ord", "k % 3 = 0 AS pip", "concat('own', k) AS name")
    c = L.with_key(c, L.resolved_folders(c, V.v_link(spark, d))).drop("path").withColumnRenamed("key", "path")
    return f.select("digest", "path").join(c, ["digest", "path"]).groupBy("digest", "path").agg(F.max_by("name", F.struct("pip", "ord")).alias("owner"))


@query("gr_build_envelope", V.with_views("v_file", "v_package") + " SELECT f.digest, f.files, f.closure, p.packages, p.unresolved FROM (SELECT digest, count(*) AS files, count(*) FILTER (in_closure) AS closure FROM v_file GROUP BY 1) f JOIN (SELECT digest, count(*) AS packages, avg(CASE WHEN depth IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS unresolved FROM v_package GROUP BY 1) p ON p.digest = f.digest")
def gr_build_envelope(spark, d):
    """One document per image of its dimensions; here its sizes."""
    f = V.v_file(spark, d).groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct("path", F.struct("sha256", "layer", "package")))).alias("files"), F.collect_list(F.when(F.col("in_closure"), F.col("path"))).alias("closure"))
    p = V.v_package(spark, d).groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct("purl", F.struct("depth")))).alias("packages"), F.avg(F.col("depth").isNull().cast("double")).alias("unresolved"))
    return f.join(p, "digest").select("digest", F.size("files").cast("long").alias("files"), F.size("closure").cast("long").alias("closure"), F.size("packages").cast("long").alias("packages"), "unresolved")
