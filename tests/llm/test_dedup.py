import collections
import hashlib
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from runwarden.llm import embedding, exact, simhash
from runwarden.llm.components import UnionFind, connected_components


def lower(t):
    return (t or "").translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}))


def exact_brute(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[lower(r[1])].append(r[0])
    return sorted((r[0], max(g := groups[lower(r[1])]), len(g), r[0] == max(g), hashlib.sha256(lower(r[1]).encode()).hexdigest()) for r in rows)


def test_exact(docs, rows):
    assert sorted(map(tuple, exact.exact_groups(docs).collect())) == exact_brute(rows)


def test_exact_with_a_digest_that_texts_share(docs, rows):
    weak = lambda t: F.pmod(F.length(t), F.lit(3)).cast("string")
    unique = {r[0]: r for r in rows}.values()
    some = docs.dropDuplicates(["doc_id"])
    assert sorted(map(tuple, exact.exact_groups(some, digest=weak).collect())) == exact_brute(unique)
    assert sorted(map(tuple, exact.exact_groups(docs, digest=weak).collect())) == exact_brute(rows)


def test_exact_beyond_the_broadcast(docs, rows, monkeypatch):
    monkeypatch.setattr(exact, "BROADCAST_HITS", 2)
    weak = lambda t: F.pmod(F.length(t), F.lit(3)).cast("string")
    assert sorted(map(tuple, exact.exact_groups(docs, digest=weak).collect())) == exact_brute(rows)
    assert sorted(map(tuple, exact.exact_groups(docs).collect())) == exact_brute(rows)


def test_exact_with_repeated_and_null_ids_whose_digest_is_shared(spark):
    rows = [(1, "a"), (1, "b"), (1, "A"), (None, "b"), (None, "c"), (2, "c"), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = lambda t: F.lit("same")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(1, 1, 2, True, sha("a"))] * 2 + [(1, 1, 2, True, sha("b")), (None, 1, 2, False, sha("b")), (None, 2, 2, False, sha("c")), (2, 2, 2, True, sha("c"))] + [(None, None, 2, True, sha(""))] * 2
    for digest in (one, exact.sha256_digest):
        assert sorted(map(tuple, exact.exact_groups(docs, digest=digest).collect()), key=str) == sorted(want, key=str)


def test_state_goes_on(spark, tmp_path):
    """Rows that come later meet what the stream has kept."""
    home = str(tmp_path)
    for part in ([(1, "a"), (2, "b")], [(7, "a"), (3, "c")]):
        df = spark.createDataFrame(part, "doc_id long, norm string").withColumn("locator", F.lit(""))
        exact.land(df, f"{home}/landed")
        state = exact.state_of(spark, f"{home}/landed", f"{home}/ck", f"{home}/out")
    assert sorted((r.keep_id, r.group_size) for r in state.collect()) == [(2, 1), (3, 1), (7, 2)]


def fingerprint(text):
    w = lower(text).encode().split()
    if not w:
        return 0
    parts = [b" ".join(w)] if len(w) < 3 else [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    hs = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(docs, rows):
    fps = [fingerprint(r[1]) for r in rows]
    u = UnionFind()
    for i, a in enumerate(fps):
        for j in range(i + 1):
            if (a ^ fps[j]).bit_count() <= 3:
                u.union(rows[i][0], rows[j][0])
    want = sorted((r[0], f - (1 << 64) * (f >> 63), u.find(r[0])) for r, f in zip(rows, fps, strict=True))
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect())) == want


def test_simhash_links(spark, monkeypatch):
    """Random fingerprints and neighbours at one to five bits, with crowded anchors cut into chunks."""
    monkeypatch.setattr(simhash, "CHUNK_ROWS", 7.0)
    rng = random.Random(3)
    fps = set()
    for _ in range(60):
        a = rng.getrandbits(64)
        fps.add(a)
        for k in (1, 2, 3, 4, 5):
            b = a
            for bit in rng.sample(range(64), k):
                b ^= 1 << bit
            fps.add(b)
    base = rng.getrandbits(64)
    fps |= {base ^ (1 << i) ^ (1 << j) for i in range(32, 50) for j in range(50, 60)}
    fps = sorted(fps)
    signed = [f - (1 << 64) * (f >> 63) for f in fps]
    u = UnionFind()
    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 3:
                u.union(signed[i], signed[j])
    links = simhash.fingerprint_links(spark.createDataFrame([(s,) for s in signed], "fp long"))
    got = {r.id: r.component_id for r in connected_components(links).collect()}
    assert all(got.get(s, s) == u.find(s) for s in signed)


def test_hamming_anchors():
    v = np.random.default_rng(1).integers(0, 1 << 31, 200, dtype=np.uint64)
    row, anchor, home = simhash.anchors_near(v)
    d = np.bitwise_count(v[row] ^ anchor)
    assert (d <= 2).all() and (d[home] <= 1).all() and home.sum() == len(v)
    assert (simhash._syndrome(anchor) == 0).all()
    assert (np.bincount(row) >= 16).sum() >= 180


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1400)] + [(5000, 5000)]
    random.Random(1).shuffle(edges)
    got = {r.id: r.component_id for r in connected_components(spark.createDataFrame(edges, "src long, dst long").repartition(7)).collect()}
    assert got == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1400)}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embedding, "INTERVAL", 32)
    monkeypatch.setattr(embedding, "BLOCK", 8)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(150, 8))
    vs = np.concatenate([base, base[:60] + rng.normal(size=(60, 8)) * 0.25, np.repeat(base[:1], 30, axis=0), base[5:8] * 3])
    rows = [(i, v.tolist()) for i, v in enumerate(vs)]
    rows += [(900, None), (901, [0.0] * 8), (902, [float("nan")] + [1.0] * 7), (903, [None] + [1.0] * 7), (904, [1.0, 0.0]), (905, [2.0, 0.1]), (906, [float("inf")] * 8), (907, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).repartition(3)
    ok = {i: np.array(v) for i, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v) != 0)}
    u, n = UnionFind(), collections.Counter()
    for i, a in ok.items():
        for j, b in ok.items():
            if i != j and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9:
                n[i] += 1
                u.union(i, j)
    want = sorted((i, n[i], u.find(i), u.find(i) == i) for i, _ in rows)
    assert sorted(map(tuple, embedding.near_duplicates(df).collect())) == want
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert embedding.near_duplicates(empty).collect() == []


def test_empty_tables(no_docs):
    assert exact.exact_groups(no_docs).collect() == []
    assert simhash.near_duplicates(no_docs).collect() == []
