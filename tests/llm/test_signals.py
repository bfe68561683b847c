"""Alignment, toxicity and periodic runs against plain versions."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from runwarden.llm import alignment, runs, toxicity


def plain_runs(w):
    """Every maximal stretch of each period, kept if it has no smaller one."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            a = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            size = i - a + q
            part = w[a : a + size]
            if size >= max(6, 4 * q) and not any(part[r:] == part[:-r] for r in range(1, q)):
                out.append((a, size, q))
    return sorted(out)


def test_runs_against_plain_loops():
    rng = random.Random(3)
    for _ in range(2500):
        n, kinds = rng.randrange(0, 70), rng.choice([1, 2, 3, 8])
        w = [rng.randrange(kinds) for _ in range(n)]
        if rng.random() < 0.6 and n > 10:
            a = rng.randrange(n)
            p = 1 + (n - a) // (3 + rng.randrange(8))
            w = w[:a] + (w[a : a + p] * 20)[: n - a]
            if rng.random() < 0.3:
                w[rng.randrange(n)] = 99
        assert runs.word_runs(w) == plain_runs(w)
        assert sorted(runs.stretch_runs(w)) == plain_runs(w)  # without the cuts at rare words too


def test_access_gives_last_ends():
    """Paths of the link tree against a table of last ends of every substring."""
    rng = random.Random(4)
    for _ in range(60):
        s = [rng.randrange(2) for _ in range(rng.randrange(1, 40))]
        length, link, prefix = runs.suffix_automaton(s)
        tree, last = runs.Access(link), {}
        for i, state in enumerate(prefix):
            want = {}
            for k in range(1, i + 2):
                sub = tuple(s[i - k + 1 : i + 1])
                if sub in last:
                    want[last[sub]] = k  # the longest for each end
                last[sub] = i
            got = {end: length[node] for node, end in tree.access(state, i) if length[node]}
            assert got == want


def plain_row(doc_id, text, change):
    words = (text or "").encode().split()
    n = len(words)
    if change and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    drop = {i for a, size, q in found for i in range(a + q, a + size)}
    best = sorted(found, key=lambda r: (-r[1], r[0], r[2]))[:1]
    most = (*best[0], 1000 * best[0][1] // best[0][2]) if best else (None,) * 4
    listed = "".join(f"{a},{size},{q}\n" for a, size, q in found)
    return (doc_id, len(found), *most, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in drop)).hexdigest())


@pytest.mark.parametrize("change", [None, runs.repeat_tails])
def test_runs_of_tables(spark, docs, rows, no_docs, change):
    small = [r for r in rows if len(r[1] or "") < 6000]
    got = sorted(map(tuple, runs.periodic_runs(docs.where(F.coalesce(F.length("text"), F.lit(0)) < 6000), change=change).collect()))
    assert got == sorted(plain_row(r[0], r[1], change) for r in small)
    assert any(r[1] for r in got)
    assert runs.periodic_runs(no_docs).collect() == []
    odd = spark.createDataFrame([(None, "a b " * 20), (1, "a " * 200_000), (1, " x " * 7)], "doc_id long, text string")
    assert sorted((r.n_runs, r.length, r.period) for r in runs.periodic_runs(odd, change=change).collect()) == [(1, 7, 1), (1, 40, 2), (1, 200_000, 1)]


def test_folding():
    assert {toxicity.fold(w) for w in ("IDIOT", "1d10t", "ïdiot", "іdіоt", "Ιdiοt", "id!ot", "ｉｄｉｏｔ")} == {"idiot"}
    assert toxicity.fold("stupid!! a.b") == "stupid   a b" and toxicity.fold("") == ""
    assert toxicity.fold("$tupid") == " tupid" and toxicity.fold("a$$hole") == "asshoie"


def test_exceptions_and_length():
    found = toxicity.Lexicon().automaton()
    assert toxicity.hits(found, toxicity.fold("put it in the trash can, please"))[:2] == (0.0, 0)
    assert toxicity.hits(found, toxicity.fold("TRASH! trash can"))[:2] == (4.0, 1)
    weight, n, words = toxicity.hits(found, toxicity.fold("you are an idiotic m0r0n"))
    assert (n, words) == (2, 5) and weight == 8.0
    assert toxicity.rate_of(8.0, 5) > toxicity.rate_of(8.0, 500) > toxicity.rate_of(0.0, 5) == 0.0


@pytest.fixture(scope="module")
def quarrels(spark):
    """Toxic texts have words with made-up beginnings, disguised in part."""
    rng = random.Random(9)
    plain = [f"{a}{b}" for a in ("ra", "mo", "ti", "se", "lu") for b in ("na", "ver", "dos", "kel", "mi")]
    rows, labels = [], []
    for i in range(900):
        w = [rng.choice(plain) for _ in range(rng.randrange(20, 200))]
        if bad := i % 6 == 0:
            for _ in range(3 + len(w) // 20):
                w[rng.randrange(len(w))] = "grolf" + rng.choice(["en", "ada", "o", "ist"]) if i % 4 else "GR0LF" + rng.choice(["en", "ada"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("y", "weight", "entry", "score", "rate")})
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels), rows


def test_toxicity_learns_beginnings(spark, quarrels):
    docs, labels, toxic, rows = quarrels
    lexicon = toxicity.learn(docs, labels)
    assert any(e.startswith(" groif") for e in lexicon.weights)
    held = {i for i in toxic if zlib.crc32(str(i).encode()) % 3 == 1}
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == 900 and held
    assert sum((got[i].score >= 0.7) == (toxic[i] == 1) for i in held) / len(held) >= 0.98
    # Labels of the held-out fold are never read.
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r.score for r in toxicity.toxicity(docs, flipped).collect()} == {i: r.score for i, r in got.items()}


def test_toxicity_counts_against_plain_loops(quarrels):
    docs, labels, toxic, rows = quarrels
    want = collections.Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 3 != 1:
            for e in toxicity.beginnings(toxicity.fold(t)):
                want[e, toxic[i]] += 1
    lexicon = toxicity.learn(docs, labels)
    total = collections.Counter(y for i, y in toxic.items() if zlib.crc32(str(i).encode()) % 3 != 1)
    base = toxicity.Lexicon().weights
    for e, w in lexicon.weights.items():
        if e not in base:
            assert w == pytest.approx(np.log((want[e[1:], 1] + 0.5) / (total[1] + 1)) - np.log((want[e[1:], 0] + 0.5) / (total[0] + 1)))


def test_toxicity_edges(spark, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    docs = spark.createDataFrame([(1, None), (1, ""), (None, "you idiot, you moron"), (2, "fine words " * 100_000), (2, "fine words")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.hits, r.words, r.score >= 0.7) for r in toxicity.toxicity(docs, none).collect()), key=str)
    assert got == sorted([(1, 0, 0, False), (1, 0, 0, False), (None, 2, 4, True), (2, 0, 200_000, False), (2, 0, 2, False)], key=str)
    assert toxicity.toxicity(no_docs, none).collect() == []
    odd = spark.createDataFrame([(None, 1), (1, None), (1, 7), (2, 0), (2, 0)], "doc_id long, toxic int")
    assert len(toxicity.toxicity(docs, odd).collect()) == 5


@pytest.fixture(scope="module")
def paths():
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plainly_aligned(rows, a_path, b_path):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a.encode_special_tokens = True
    chars = alignment.byte_of_char()
    entry = {i: t for t, i in a.get_vocab().items()}
    per_doc, holds = [], collections.Counter()
    for i, t in rows:
        t = t or ""
        want = b" " + t.encode()
        x, y = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        xb = [bytes(chars[c] for c in entry[k]) for k in x]
        yb = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in y]
        if not t or b"".join(xb) != want or b"".join(yb) != want:
            per_doc.append((i, [], [], [], ""))
            continue
        ends_x, ends_y = np.cumsum([len(v) for v in xb]).tolist(), np.cumsum([len(v) for v in yb]).tolist()
        links = [(x[p], y[q]) for p, e in enumerate(ends_x) for q, f in enumerate(ends_y) if max(e - len(xb[p]), f - len(yb[q])) < min(e, f)]
        holds.update(set(links))
        groups, start = [], 0
        for c in sorted(set(ends_x) & set(ends_y)):
            groups.append(",".join(str(k) for k, e in zip(x, ends_x) if start < e <= c) + "|" + ",".join(str(k) for k, e in zip(y, ends_y) if start < e <= c))
            start = c
        per_doc.append((i, x, y, links, groups))
    top = collections.Counter()
    for (p, _), n in holds.items():
        top[p] = max(top[p], n)
    return sorted(
        ((i, len(x), len(y), len(g), len(ls), sum(holds[v] == top[v[0]] for v in ls), sum(holds[v] for v in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, x, y, ls, g in per_doc), key=str
    )


TEXTS = ["", None, "Hello world", " leading", "trailing ", "two  spaces\n\nand lines\t", "naïve café 日本語 🙂", "<|endoftext|> and <s>", "▁under", "\x00zero", "the the the", "don't stop", "a" * 300, "ß" * 50, "of the and the of the"]


def test_ranks_give_the_ids_of_the_tokenizer(paths):
    """The quicker reading of A against the library that its file belongs to."""
    pair = alignment.Pair(*paths)
    assert pair.a_fast
    rng = random.Random(8)
    alphabet = ["the", "ing", " ", "  ", "\n", "\r\n", "a", "é", "日本", "ا", "्", "<|endoftext|>", "123", "½", "'s", "'LL", "'ve", "!!", "x", "\t", "\u200b", "\u00a0", "\u2028", "🙂", "zz", "_", "\x00", "\x85"]
    items = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)] + ["ab" * 5000, " " * 3000 + "x"]
    assert [pair.a_fast.encode_ordinary(" " + t) for t in items] == [e.ids for e in pair.a.encode_batch([" " + t for t in items], add_special_tokens=False)]


@pytest.mark.parametrize("block", [2048, 3])
def test_alignment_against_plain_loops(spark, paths, block, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK", block)
    rng = random.Random(6)
    rows = list(enumerate(TEXTS)) + [(100 + i, " ".join(rng.choice(["the", "of", "alignment", "tokenizer", "Größe", "été", "x1", "\n"]) for _ in range(rng.randrange(1, 40)))) for i in range(40)] + [(7, "the the"), (7, "the the"), (None, "of")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({c: F.lit(c) for c in ("block", "slot", "part", "pair", "n_a", "sums")})
    got = sorted((tuple(r) for r in alignment.align(docs, *paths).collect()), key=str)
    assert got == plainly_aligned(rows, *paths)


def test_alignment_of_empty_tables_and_long_texts(spark, no_docs, paths):
    assert alignment.align(no_docs, *paths).collect() == []
    r = alignment.align(spark.createDataFrame([(1, "the cat sat " * 100_000), (2, "the cat")], "doc_id long, text string"), *paths).collect()
    long_ = next(x for x in r if x.doc_id == 1)
    assert long_.n_a >= 300_000 and long_.n_links == long_.n_a + long_.n_b - long_.n_groups and long_.n_best == long_.n_links


def test_packed_bitmaps():
    rng = np.random.default_rng(2)
    for docs in (1, 8, 100, 2048):
        keys = np.unique(rng.integers(0, 12 * docs, 5 * docs))
        pairs, slots = keys // docs * 7919, keys % docs
        times = rng.choice([1, 1, 1, 2, 5, 300], len(keys))
        n, found, of, got, many = alignment.unpack(alignment.pack(pairs, slots, times, docs))
        assert n == docs and (found[of] == pairs).all() and (got == slots).all() and (many == times).all()
