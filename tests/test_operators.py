"""Small cases by hand."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from runwarden.operators import detector, egress, forest, graph, normalise, score, verify
from runwarden.operators.sequence import chains, greedy_starts
from runwarden.operators.windows import behaviour_windows
from runwarden.plans.graphs import resolve_links
from runwarden.plans.rules import folded_root, zero_day
from runwarden.plans.scenarios import metrics
from runwarden.plans.sequences import log_index, verify_chain
from runwarden.streaming import hold, sinks


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(n) for n, c in cols.items())).first()


FILES = [("i", "/bin/ls", "a" * 64, 0, "p", True), ("i", "/bin/dash", "b" * 64, 0, "p", True), ("i", "/lib/x.so", "c" * 64, 1, None, False), ("i", "/etc/passwd", "d" * 64, 0, None, False)]
CASES = [
    ("exec", "/bin/ls", "/bin/dash", "a" * 64, "conforming"),
    ("exec", "/tmp/.x9", "/bin/dash", None, "D_exec/undeclared"),
    ("exec", "/tmp/.l", "/bin/dash", "a" * 64, "D_hash/relocated"),
    ("exec", "/bin/ls", "/bin/dash", "f" * 64, "D_hash/modified"),
    ("exec", "/etc/passwd", "/bin/dash", None, "D_exec/outside_closure"),
    ("load", "/tmp/libx.so", "/bin/ls", None, "D_load/undeclared"),
    ("load", "/lib/x.so", "/bin/ls", None, "D_load/outside_closure"),
    ("load", "/lib/x.so", "/lib/x.so", None, "conforming"),
]


def test_exec_and_load(spark):
    files = spark.createDataFrame(FILES, "digest string, path string, sha256 string, layer int, package string, in_closure boolean")
    e = spark.createDataFrame([(i, "i", k, p, x, h) for i, (k, p, x, h, _) in enumerate(CASES)], "seq long, digest string, kind string, path string, exe string, hash string")
    e = verify.with_relocated(verify.with_declared(e, files), files)
    got = {r.seq: r.o for r in e.select("seq", verify.exec_load_outcome(F.col("kind"), F.col("path"), F.col("exe")).alias("o")).collect()}
    assert [got[i] for i in range(len(CASES))] == [c[-1] for c in CASES]


def test_mounts(spark):
    rows = [("/app/data/x", ["/app/data"], True), ("/app/database", ["/app/data"], False), ("/x", ["/"], True), ("/app/data", ["/app/data/"], True), ("/x", [], False), ("/x", None, False)]
    df = spark.createDataFrame([(i, p, m) for i, (p, m, _) in enumerate(rows)], "i int, path string, mounts array<string>")
    got = {r.i: r.u for r in df.select("i", verify.under_mount(F.col("path"), F.col("mounts")).alias("u")).collect()}
    assert [got[i] for i in range(len(rows))] == [r[-1] for r in rows]


@pytest.mark.parametrize("many", [False, True])
def test_egress(spark, many):
    entries = ["10.0.0.0/8", "192.168.0.0/16:443", "*:53", "203.0.113.7"] + [f"172.16.{i % 256}.{i // 256}:1" for i in range(10_001 * many)]
    rules = egress.rules_of(spark.createDataFrame([(e,) for e in entries], "entry string"))
    cases = [("10.9.9.9", 1, True), ("192.168.1.1", 443, True), ("192.168.1.1", 80, False), ("8.8.8.8", 53, True), ("203.0.113.9", 4444, False), ("203.0.113.7", 9, True), ("bad", 53, True), (None, 80, False)]
    df = spark.createDataFrame([(i, a, p) for i, (a, p, _) in enumerate(cases)], "i int, daddr string, dport int")
    got = {r.i: r.allowed for r in egress.allowed(df, rules).collect()}
    assert [got[i] for i in range(len(cases))] == [c[-1] for c in cases]


@pytest.mark.parametrize(
    ("cls", "sub", "declared", "package", "depth", "want"),
    [("D_exec", "undeclared", False, None, None, (90, "critical")), ("D_write", "declared_file", True, None, None, (72, "high")), ("D_exec", "outside_closure", True, "p", None, (34, "low")), ("binding", "unverified", None, None, None, (60, "high"))],
)
def test_scores(spark, cls, sub, declared, package, depth, want):
    s = score.severity(F.lit(cls), F.lit(sub), F.lit("AUTHENTICATED"), score.rho(F.lit(declared).cast("boolean"), F.lit(package).cast("string"), F.lit(depth).cast("int")), score.kappa(F.lit(False), F.lit(True), F.lit(True)))
    r = one(spark, n=score.score(F.lit(cls), F.lit(sub), s), b=score.bucket(score.score(F.lit(cls), F.lit(sub), s)))
    assert (r.n, r.b) == want


def test_behaviour_score(spark):
    r = one(spark, a=score.g_of(F.lit("anomaly 0.1234, g_I 0.987 x")), b=score.g_of(F.lit("none")), c=score.behaviour(F.lit(1.0), F.lit(1.0)))
    assert (r.a, r.b, r.c) == (0.987, 1.0, 59)


def test_times(spark):
    texts = ["2024-02-29T12:00:00.123456789Z", "2024-02-29T12:00:00+02:30", "2024-13-01T00:00:00Z", "x", "1970-01-01T00:00:01.5Z"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.n for r in df.select("i", normalise.time_ns(F.col("t")).alias("n")).collect()}
    assert [got[i] for i in range(5)] == [1709208000123456789, 1709199000000000000, None, None, 1500000000]
    assert one(spark, t=normalise.time_text(F.lit(1709208000123456789))).t == texts[0]
    assert one(spark, t=normalise.time_text(F.lit(1500000000))).t == "1970-01-01T00:00:01.500Z"


def test_paths_and_purls(spark):
    r = one(spark, a=normalise.normal_path(F.lit("/a/./b/../c//d")), b=normalise.normal_path(F.lit("/../x")), c=normalise.exe_path(F.lit("b"), F.lit("/w/")), **normalise.purl_identity(F.lit("pkg:pypi/Foo_Bar.baz@1.0?x=y")))
    assert (r.a, r.b, r.c, r.type, r.name, r.version) == ("/a/c/d", "/x", "/w/b", "pypi", "foo-bar-baz", "1.0")


def test_windows(spark):
    s = 1_000_000_000
    rows = [("c", 1, 0, i, t * s, k, p) for i, (t, k, p) in enumerate([(0, "exec", "/a"), (12, "write", "/t/1"), (14, "write", "/t/2"), (15, "write", "/u/1"), (60, "write", "/t/3")])]
    rows += [("c", 2, 1, 10, 61 * s, "exec", "/b"), ("c", 3, 0, 11, 200 * s, "exec", "/z")]
    e = spark.createDataFrame(rows, "cid string, pid long, ppid long, seq long, t_ns long, kind string, path string").selectExpr("*", "path AS exe", "CAST(NULL AS STRING) AS daddr", "CAST(NULL AS INT) AS dport", "path LIKE '/u%' AS new_file", "true AS counted")
    got = sorted((r.pid, r.start_ns // s, r.end_ns // s, r.events, r.closed_by, r.write, r.new_files, r.dirs_written, r.exec) for r in behaviour_windows(e).collect())
    assert got == [(1, 12, 42, 3, "time", 3.0, 1.0, 2.0, 0.0), (1, 60, 90, 2, "time", 1.0, 0.0, 1.0, 1.0)]
    by_count = behaviour_windows(e, most=3, min_age_ns=0).where("closed_by = 'count'").collect()
    assert [(r.end_ns // s, r.events) for r in by_count] == [(15, 3)]
    assert behaviour_windows(e.where("seq = 1")).collect() == []


def test_chains(spark):
    rows = [("a", 1, 0.0, 10, 1), ("a", 2, 60.0, 11, 10), ("a", 3, 121.0, 12, 11), ("b", 4, 1.0, 10, 1), ("a", 5, 122.0, None, None), ("a", 6, 122.0, None, 12)]
    df = spark.createDataFrame(rows, "container_id string, id long, t_s double, pid long, ppid long")
    assert {r.id: r.chain for r in chains(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 3}


def test_greedy(spark):
    df = spark.createDataFrame([("k", t, i) for i, t in enumerate([0, 30, 59, 60, 100, 121])], "k string, t long, i long")
    assert sorted(r.t for r in greedy_starts(df, ["k"], "t", "i", 60).collect()) == [0, 60, 121]


def test_graph(spark):
    e = spark.createDataFrame([("i", 1, 2), ("i", 1, 3), ("i", 2, 4), ("i", 3, 4), ("i", 4, 5), ("i", 8, 9), ("i", 9, 8), ("i", 1, 1)], "digest string, src long, dst long")
    assert {r.node: r.depth for r in graph.depths(e, ["digest"]).collect()} == {1: 1, 2: 2, 3: 2, 4: 3, 5: 4, 8: None, 9: None}
    roots = spark.createDataFrame([("i", 1)], "digest string, node long")
    assert {r.node: r.path for r in graph.shortest_paths(roots, e, ["digest"]).collect()}[5] == [1, 2, 4, 5]
    assert sorted(r.id for r in graph.reachable(roots.select(F.col("node").alias("id")), e.select("src", "dst")).collect()) == [1, 2, 3, 4, 5]


def test_links(spark):
    links = spark.createDataFrame([("i", "/lib", "usr/lib"), ("i", "/a", "/b"), ("i", "/b", "/a"), ("i", "/c/d", "../lib/e"), ("i", "/n", None)], "digest string, path string, target string")
    paths = spark.createDataFrame([("i", p) for p in ("/lib/x", "/a/1", "/c/d/f", "/n/1", "/plain")], "digest string, path string")
    assert {r.path: r.real for r in resolve_links(paths, links).collect()} == {"/lib/x": "/usr/lib/x", "/a/1": None, "/c/d/f": "/usr/lib/e/f", "/n/1": None, "/plain": "/plain"}


def test_hash_chain(spark, tmp_path):
    out = str(tmp_path / "log")
    texts = [(i, f"record {i}") for i in range(20)]
    sinks.append_chain(spark.createDataFrame(texts[:12], "order long, canon string"), out, 0)
    sinks.append_chain(spark.createDataFrame(texts[12:], "order long, canon string"), out, 1)
    sinks.append_chain(spark.createDataFrame(texts[12:], "order long, canon string"), out, 1)
    rows = sorted(spark.read.parquet(out).collect(), key=lambda r: r.k)
    h = "0" * 64
    for (i, t), r in zip(texts, rows, strict=True):
        h = hashlib.sha256(bytes.fromhex(h) + hashlib.sha256(t.encode()).digest()).hexdigest()
        assert (r.k, r.hash) == (i + 1, h)
    for bad, change in ((None, {}), (7, {"canon": "other"}), (5, {"k": 9}), (6, {"hash": "0" * 64})):
        entries = [{"log": 1, "line": r.k, "k": r.k, "prev": r.prev, "hash": r.hash, "canon": r.canon} | (change if r.k == bad else {}) for r in rows]
        assert verify_chain(spark.createDataFrame(entries)).first().first_bad == bad
    assert verify_chain(spark.createDataFrame([{"log": 1, "line": i + 1, "k": r.k, "prev": r.prev, "hash": r.hash, "canon": r.canon} for i, r in enumerate(rows[:4] + rows[5:])])).first().first_bad == 5


def leaf(b):
    return hashlib.sha256(b"\x00" + b).digest()


def tree(ls):
    if len(ls) == 1:
        return ls[0]
    k = 1 << (len(ls) - 1).bit_length() - 1
    return hashlib.sha256(b"\x01" + tree(ls[:k]) + tree(ls[k:])).digest()


def audit(i, ls):
    if len(ls) == 1:
        return []
    k = 1 << (len(ls) - 1).bit_length() - 1
    return [*audit(i, ls[:k]), tree(ls[k:])] if i < k else [*audit(i - k, ls[k:]), tree(ls[:k])]


def test_inclusion(spark):
    rows, want = [], []
    for n in (1, 2, 3, 5, 7, 8, 13):
        ls = [leaf(bytes([i])) for i in range(n)]
        for i in range(n):
            rows.append((len(rows), ls[i].hex(), i, n, [h.hex() for h in audit(i, ls)]))
            want.append(tree(ls).hex())
    df = spark.createDataFrame(rows, "r int, leaf string, i long, n long, path array<string>")
    got = {x.r: x.root for x in df.select("r", folded_root(F.col("leaf"), F.col("i"), F.col("n"), F.col("path")).alias("root")).collect()}
    assert [got[i] for i in range(len(rows))] == want
    short = df.where("n = 8").select(folded_root(F.col("leaf"), F.col("i"), F.col("n"), F.slice("path", 1, 2)).alias("root")).collect()
    assert {x.root for x in short} == {None}


def test_metrics_without_denominators(spark):
    r = metrics(spark.createDataFrame([(0, 0, 0, 0)], "tp long, fp long, fn long, tn long")).first()
    assert (r.precision, r.recall, r.f1, r.fpr, r.accuracy) == (None,) * 5


def test_forest(spark):
    rng = np.random.default_rng(0)
    rows = [("a", i, rng.normal(size=4).tolist()) for i in range(600)] + [("a", 600, [9.0] * 4)] + [("b", i, [float(i)] * 4) for i in range(5)]
    df = spark.createDataFrame(rows, "digest string, id long, x array<double>").repartition(3)
    f = forest.train(df, trees=30, sample=64)
    again = forest.train(df.repartition(2), trees=30, sample=64)
    assert sorted(map(str, f.collect())) == sorted(map(str, again.collect()))
    assert {r.digest: r.ok for r in forest.usable(f, 4).collect()} == {"a": True, "b": True}
    got = {(r.digest, r.id): r.score for r in forest.score(df, f, 64).collect()}
    assert len(got) == len(rows) and all(0 < s <= 1 for s in got.values())
    assert got["a", 600] == max(s for (d, _), s in got.items() if d == "a")
    assert float(forest.average_path(1)) == 0 and float(forest.average_path(2)) == 1


def test_zero_day(spark):
    frame = lambda schema, *values: spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], schema)
    good = {
        "runs": frame("start long", 10, 20), "specs": frame("compiled_at long", 5, 15), "files": frame("path string, package string", ("/bin/ls", "p"), ("/usr/local/bin/helperd", None)),
        "egress": frame("cidr string", "203.0.114.0/24", "203.0.113.8/32"), "windows": frame("stop long", 3, 10), "models": frame("written long", 9), "baselines": frame("written long", 10),
        "advisories": frame("package string", "known", None, ""),
    }
    result = lambda rules=None, **other: {r.check_name: r.result for r in zero_day(**{**good, **other}, known="known", rules_changed=rules).collect()}
    assert set(result(False).values()) == {"pass"} and len(result(False)) == 7
    bad = result(
        True, specs=frame("compiled_at long", 10), files=frame("path string, package string", ("/tmp/.cache/a", None)), windows=frame("stop long", 3, 11), models=frame("written long", 10),
        baselines=frame("written long", 11), advisories=frame("package string", "known", "other"),
    )
    assert set(bad.values()) == {"fail"} and len(bad) == 7
    assert result(egress=frame("cidr string", "203.0.112.0/23"))["artefacts_undeclared"] == "fail"
    assert result(files=frame("path string, package string", ("/usr/local/bin/helperd", "p")))["artefacts_undeclared"] == "fail"
    empty = result(**{k: v.limit(0) for k, v in good.items()})
    assert empty == {"spec_first": "skip", "artefacts_undeclared": "skip", "training_windows": "skip", "model_first": "skip", "baselines_first": "skip", "advisories_known": "pass", "rules_default": "skip"}


def test_log_index(spark):
    cases = {
        '{"logIndex": 5}': 5, '{"a": {"log_index": "12"}, "logIndex": 3}': 12, '{"logIndex": true, "b": [{"logIndex": -1}, {"x": 1, "logIndex" : 4}]}': 4,
        '{"logIndex": [1, 2]}': None, '{"note": "{\\"logIndex\\": 5}"}': None, '{"logIndex": 5.5}': None, '{"logIndex": "5a", "log_index": "0"}': 0,
        '{"logIndex": 5': None, "": None, '{"xlogIndex": 5}': None, '{"logIndex": {"logIndex": 9}}': 9, '{"logIndex": "99999999999999999999"}': None, None: None,
    }
    df = spark.createDataFrame([(c,) for c in cases], "doc string")
    assert {r.doc: r.i for r in df.select("doc", log_index(F.col("doc")).alias("i")).collect()} == cases


def test_detector_windows(spark):
    rng = np.random.default_rng(1)
    calls = [("i", f"t{n}", 1000 * n + k, int(t), str(rng.choice(["a", "b"]))) for n in (1, 14, 15, 17, 18, 40) for k, t in enumerate(rng.integers(0, 90, n))]
    df = spark.createDataFrame(calls, "digest string, trace string, seq long, t_ns long, kind string")
    got = {(r.trace, r.id): r.x for r in detector.call_windows(df, ["a", "b"]).collect()}
    want = {}
    for trace in {c[1] for c in calls}:
        rows = sorted((c for c in calls if c[1] == trace), key=lambda c: (c[3], c[2]))
        for i in range(0, len(rows) - 14, 3) if len(rows) >= 15 else [0]:
            w = rows[i : i + 15]
            waits = np.diff([c[3] for c in w]) if len(w) > 1 else np.zeros(1)
            want[trace, w[0][2]] = [sum(c[4] == k for c in w) / len(w) for k in "ab"] + [waits.mean(), waits.std(), waits.max()]
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k]) for k in want)
    assert detector.call_windows(df.limit(0), ["a", "b"]).count() == 0


def test_detector_judges(spark):
    scores = spark.createDataFrame([("a", float(i)) for i in range(401)] + [("b", 5.0)], "digest string, score double")
    assert {r.digest: r.theta for r in detector.nearest_rank(scores).collect()} == {"a": 398.0, "b": 5.0}
    rng = np.random.default_rng(2)
    rows = lambda n, at, first: [("i", f"t{n}", first + k, (rng.normal(size=3) + at).tolist()) for k in range(30)]
    frame = lambda parts: spark.createDataFrame([r for p in parts for r in p], "digest string, trace string, id long, x array<double>")
    base = frame([rows(n, 0, 100 * n) for n in range(4)])
    out = detector.judge(base, frame([rows(7, 30, 700), rows(8, 0, 800)[:1]]), trees=20).collect()
    got = {r.trace: r for r in out}
    assert got["t7"].anomalous and got["t7"].windows == 30 and got["t7"].above == 30 and got["t8"].windows == 1
    most = {r.digest: r.most for r in detector.trace_thresholds(base, trees=20).collect()}
    assert 0 <= most["i"] < 1
    assert detector.judge(base.limit(1), base, trees=20).count() == 0


SOURCE = "cid string, seq long, t_ns long, what string"
SECOND = 1_000_000_000


def test_hold_keeps_order(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    put = lambda rows: spark.createDataFrame([(c, s, t * SECOND, w) for c, s, t, w in rows], SOURCE).write.mode("append").parquet(src)
    stream = lambda: hold.until_bound(spark.readStream.schema(SOURCE).parquet(src), 1000 * SECOND)
    put([("a", 2, 2, "event"), ("a", 1, 1, "event"), ("b", 1, 9, "event")])
    assert hold.run(stream(), out, ck).count() == 0
    # Times that are behind the stream's clock are late, and are neither dropped nor given earlier than what came before.
    put([("a", 9, 3, "open"), ("a", 5, 5, "event")])
    hold.run(stream(), out, ck)
    put([("b", 7, 1, "event"), ("b", 8, 2, "open")])
    hold.run(stream(), out, ck)
    assert sorted((r.cid, r.seq) for r in spark.read.parquet(out).collect()) == [("a", 1), ("a", 2), ("a", 5), ("b", 1), ("b", 7)]


def test_hold_releases_before_it_trims(spark, tmp_path):
    """An open container gives all its events, however many come at once; what a closed one loses is counted."""
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    stream = lambda: hold.until_bound(spark.readStream.schema(SOURCE).parquet(src), 1000 * SECOND, 3)
    rows = [(c, i, i * SECOND, "event") for c in "abd" for i in range(5 if c != "d" else 3)] + [("a", 9, 9 * SECOND, "open")]
    spark.createDataFrame(rows, SOURCE).write.parquet(src)
    hold.run(stream(), out, ck)
    spark.createDataFrame([("b", 9, 10 * SECOND, "open"), ("d", 9, 10 * SECOND, "open")], SOURCE).write.mode("append").parquet(src)
    got = hold.run(stream(), out, ck).collect()
    assert sorted((r.cid, r.seq) for r in got if r.outcome == "released") == [("a", i) for i in range(5)] + [("b", i) for i in (2, 3, 4)] + [("d", i) for i in range(3)]
    assert [(r.cid, r.n) for r in got if r.outcome == "lost"] == [("b", 2)]


def test_windows_batch_equals_any_partitioning(spark):
    rng = np.random.default_rng(4)
    n = 400
    pdf = pd.DataFrame({"cid": rng.choice(["x", "y"], n), "pid": rng.integers(1, 4, n), "ppid": rng.integers(1, 4, n), "seq": np.arange(n), "t_ns": np.sort(rng.integers(0, 600, n)) * 1_000_000_000, "kind": rng.choice(["exec", "write", "load", "exit"], n, p=[0.1, 0.6, 0.25, 0.05]), "path": rng.choice(["/a/1", "/b/2"], n)})
    e = spark.createDataFrame(pdf).selectExpr("*", "path AS exe", "'d' AS daddr", "1 AS dport", "false AS new_file", "true AS counted")
    assert sorted(map(str, behaviour_windows(e).collect())) == sorted(map(str, behaviour_windows(e.repartition(7, "path")).collect()))


def test_every_document_is_predicted_and_every_fold_evaluated(spark):
    from runwarden.plans import modelling

    d = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet").select("doc_id") for t in ("documents", "labels"))
    got = modelling.ml_cap_predict(spark, d).groupBy("label").agg({"doc_id": "count"}).collect()
    assert sorted(map(tuple, got)) == [(label, docs.count()) for label in ("quality", "toxic")]
    rows = {(r.which, r.method): r for r in modelling.ml_cv_evaluate(spark, d).collect()}
    assert len(rows) == 8 and all(r.repeats == 3 and r.n == 3 * labels.count() for r in rows.values())
    assert rows["quality", "everything"].mean_recall == 1 and rows["quality", "nothing"].mean_recall == 0


def test_one_key_of_many_rows(spark):
    """A hundred thousand rows of one key stream by: greedy starts, a hash chain and incident chains against plain loops."""
    import hashlib
    import random

    rng = random.Random(3)
    n = 100_000
    times = sorted(rng.randrange(5_000_000) for _ in range(n))
    df = spark.range(n).selectExpr("'one' AS k", "id AS i").join(spark.createDataFrame(list(enumerate(times)), "i long, t long"), "i").repartition(5)
    want, last = [], -(10**9)
    for i, t in enumerate(times):
        if t >= last + 60:
            want.append(i)
            last = t
    assert sorted(r.i for r in greedy_starts(df, ["k"], "t", "i", 60).collect()) == want
    from runwarden.operators.sequence import chained

    digests = df.selectExpr("1L AS log", "i AS place", "sha2(cast(t AS string), 256) AS c")
    h, got = bytes(32), chained(digests).orderBy("place").select("k", "hash").collect()
    for i, (t, r) in enumerate(zip(times, got, strict=True)):
        h = hashlib.sha256(h + hashlib.sha256(str(t).encode()).digest()).digest()
        assert r.k == i + 1 and r.hash == h.hex()
    rows = [("c", i, float(rng.randrange(4000)), rng.randrange(40) if i % 9 else None, rng.randrange(60)) for i in range(6000)]
    open_, expected = [], {}
    for _, i, t, pid, ppid in rows:
        for chain in open_:
            if abs(t - chain[2]) <= 60 and (pid in chain[1] or ppid in chain[1]):
                chain[1] |= {pid} - {None}
                chain[2] = max(chain[2], t)
                break
        else:
            chain = [i, {pid} - {None}, t]
            open_.append(chain)
        expected[i] = chain[0]
    got = chains(spark.createDataFrame(rows, "container_id string, id long, t_s double, pid long, ppid long").repartition(3))
    assert {r.id: r.chain for r in got.collect()} == expected


def test_components_as_deep_as_they_go(spark):
    from runwarden.sources.readers import sbom_components

    doc = "[]"
    for i in range(14, 0, -1):
        doc = f'[{{"type": "{"library" if i % 5 else "file"}", "purl": "pkg:t/{i}", "components": {doc}}}]'
    rows = spark.createDataFrame([(1, f'{{"components": {doc}}}'), (2, "{}"), (3, "no json")], "sbom long, doc string")
    assert sorted((r.sbom, r.purl) for r in sbom_components(rows).collect()) == sorted((1, f"pkg:t/{i}") for i in range(1, 15) if i % 5)


def test_a_line_of_odd_types(spark):
    """Values of another kind than expected are null, whatever else the line has."""
    from runwarden.operators.normalise import normalised

    lines = ['{"process_exec": {"process": "text"}}', '[1]', '"x"', "null", '{"process_kprobe": {"function_name": "cap_capable", "args": {"a": 1}}}', '{"process_exec": {"process": {"pid": true, "pod": {"namespace": "n", "container": {"id": "c"}}, "start_time": "2024-01-01T00:00:00Z"}}, "time": 5}']
    got = {r.seq: r for r in normalised(spark.createDataFrame(list(enumerate(lines)), "seq long, line string")).collect()}
    assert [got[i].reason for i in range(6)] == ["no_process", "bad_json", "bad_json", "bad_json", "no_capability", None]
    assert got[5].pid is None and got[5].t_ns == 1704067200 * 10**9


def test_numbered_when_partitions_coalesce(spark):
    """Wide rows, whose partitions are coalesced unlike those of their counts, keep every row and number; nulls come last."""
    confs = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k"}
    before = {k: spark.conf.get(k, None) for k in confs}
    for k, v in confs.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(20_000).selectExpr("id AS seq", "CASE WHEN id <> 7 THEN pmod(xxhash64(id), 1000) END AS t_ns", "repeat(sha2(string(id), 256), 4) AS payload")
        got = sinks.numbered(rows, 9_990, "t_ns", "seq").select("number", "t_ns", "seq").collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert [r.number for r in sorted(got, key=lambda r: (r.t_ns is None, r.t_ns or 0, r.seq))] == list(range(9_991, 29_991))


@pytest.fixture(scope="module")
def traces(spark):
    """Windows of three images: of one trace, of five, of one that has most windows and two small ones."""
    rng = np.random.default_rng(4)
    sizes = {"one": [20], "five": [9, 12, 15, 8, 30], "uneven": [90, 1, 4]}
    rows = [(d, f"t{k}", 1000 * k + i, (rng.normal(size=3) * (1 + (k == 2)) + (k == 3)).tolist()) for d, ns in sizes.items() for k, n in enumerate(ns) for i in range(n)]
    return spark.createDataFrame([*rows, ("lonely", "t0", 1, [0.0] * 3)], "digest string, trace string, id long, x array<double>").repartition(3).cache()


def test_left_out_forests(spark, traces):
    """Scores of forests grown side by side are those of one forest trained for each image and trace left out; windows of images with few traces are sent once."""
    got = {}
    for r in detector.scored(detector.dealt(traces, traces.where("trace = 't0'"), 10), 10).collect():
        got.setdefault((r.digest, r.held, r.role, r.trace), []).append(r.score)
    want = {}
    for digest, names in (("one", ["t0"]), ("five", [f"t{k}" for k in range(5)]), ("uneven", ["t0", "t1", "t2"])):
        rows = traces.where(f"digest = '{digest}'")
        for held in [None, *names]:
            grown = forest.train(rows if held is None or len(names) == 1 else rows.where(f"trace <> '{held}'"), 10)
            for r in forest.score(rows, grown).join(rows, ["digest", "id"]).collect():
                if held is None:
                    roles = ["base", *["tested"] * (r.trace == "t0")]
                else:
                    roles = ["held", "other"] if len(names) == 1 else ["held" if r.trace == held else "other"]
                for role in roles:
                    want.setdefault((digest, held, role, r.trace), []).append(r.score)
    assert got.keys() == want.keys()
    assert all(np.allclose(sorted(got[k]), sorted(want[k]), rtol=1e-12) for k in want)
    assert detector.dealt(traces).count() == traces.where("digest <> 'lonely'").count()


def test_left_out_forests_in_parts(spark, traces):
    """Images cut into many parts and blocks of traces have every window scored once by every forest that is to score it, and the same samples in all parts."""
    key = lambda r: (r.digest, r.held or "", r.role, r.trace, r.score)
    whole = sorted(map(key, detector.scored(detector.dealt(traces, traces, 10, 8), 10, 8).collect()))
    cut = sorted(map(key, detector.scored(detector.dealt(traces, traces, 10, 8, 2, 7), 10, 8).collect()))
    assert [k[:4] for k in cut] == [k[:4] for k in whole] and len(cut) > 500
    assert np.allclose([k[4] for k in cut], [k[4] for k in whole], rtol=1e-12)


def test_trees_side_by_side():
    """Trees grown together against one that is grown node by node from the same draws."""
    x = np.round(np.random.default_rng(6).normal(size=(60, 4)), 1)
    x[:, 2] = 1
    sizes, numbers = [60, 25, 2, 1, 60], np.array([0, 3, 4, 5, 9])
    side = forest.grow(np.ascontiguousarray(x.T), np.concatenate([np.arange(n) for n in sizes]), np.array(sizes), numbers, 5, 8)
    for k, (n, number) in enumerate(zip(sizes, numbers, strict=True)):
        nodes, out = [(np.arange(n), 0, 1)], []
        for rows, depth, place in nodes:
            low, high = x[rows].min(axis=0), x[rows].max(axis=0)
            can, node = np.flatnonzero(high > low), [-1, -1, -1, 0.0, len(rows)]
            if depth < 5 and len(can):
                draw = forest.mixed(8, number, place)
                f = int(forest.unit(draw)[0] * 4)
                f = f if f in can else can[int(forest.unit(forest.mixed(draw, 2))[0] * len(can))]
                t = low[f] + forest.unit(forest.mixed(draw, 1))[0] * (high[f] - low[f])
                node = [len(nodes), len(nodes) + 1, f, t if t < high[f] else low[f], len(rows)]
                go = x[rows, f] <= node[3]
                nodes += [(rows[go], depth + 1, 2 * place), (rows[~go], depth + 1, 2 * place + 1)]
            out.append(node)
        a, b = side.first[k], side.first[k + 1]
        assert [list(r) for r in zip(side.lefts[a:b], side.rights[a:b], side.features[a:b], side.thresholds[a:b], side.sizes[a:b], strict=True)] == out
        for i in range(0, 60, 7):
            at, d = 0, 0
            while out[at][0] >= 0:
                at, d = out[at][0] if x[i, out[at][2]] <= out[at][3] else out[at][1], d + 1
            assert side.path_lengths(np.array([k]), np.ascontiguousarray(x.T), np.array([i]))[0] == d + forest.average_path(out[at][4])
