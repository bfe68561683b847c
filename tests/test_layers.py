"""Layer overlays by hand."""

from runwarden.plans.graphs import layer_union

ENTRY = "digest string, layer int, seq long, path string, kind string, target string, sha256 string"


def union(spark, *rows):
    full = [("i", layer, n, path, kind, *(rest if kind == "hardlink" else (None, *rest)), *((None,) if kind == "hardlink" or not rest else ())) for n, (layer, path, kind, *rest) in enumerate(rows)]
    return {r.path: (r.layer, r.sha256) for r in layer_union(spark.createDataFrame(full, ENTRY)).collect()}


def test_overlays(spark):
    got = union(
        spark,
        (0, "/over", "file", "old"), (1, "/over", "file", "new"),  # overwritten
        (0, "/gone", "file", "x"), (1, "/gone", "whiteout"),
        (0, "/dir/a", "file", "x"), (0, "/dir/b/c", "file", "x"), (0, "/dirt", "file", "stays"), (1, "/dir", "whiteout"),  # a whole folder
        (0, "/op/a", "file", "x"), (1, "/op/.wh..wh..opq", "opaque"), (1, "/op/b", "file", "own"),  # what the same layer has stays
        (0, "/was/a", "file", "x"), (1, "/was", "file", "file"),  # a file in place of a folder
        (0, "/wasfile", "file", "x"), (1, "/wasfile", "dir"), (1, "/wasfile/a", "file", "in"),  # a folder in place of a file
        (0, "/lower", "file", "low"), (1, "/link", "hardlink", "/lower"), (1, "/here", "file", "here"), (1, "/link2", "hardlink", "/here"),
        (1, "/nothing", "hardlink", "/missing"),
        (0, "/early", "hardlink", "/late"), (1, "/late", "file", "late"),  # a later layer's file is no target
        (1, "/back", "whiteout"), (2, "/back", "file", "again"),
    )
    assert got == {
        "/over": (1, "new"), "/dirt": (0, "stays"), "/op/b": (1, "own"), "/was": (1, "file"), "/wasfile/a": (1, "in"), "/lower": (0, "low"), "/link": (1, "low"), "/here": (1, "here"),
        "/link2": (1, "here"), "/late": (1, "late"), "/back": (2, "again"),
    }


def test_layers_are_compared_before_places(spark):
    """However far apart places are, the higher layer wins."""
    rows = [("i", 0, 10**12, "/f", "file", None, "low"), ("i", 1, 1, "/f", "file", None, "high")]
    assert [(r.layer, r.sha256) for r in layer_union(spark.createDataFrame(rows, ENTRY)).collect()] == [(1, "high")]
