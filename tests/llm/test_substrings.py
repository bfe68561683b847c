import collections
import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from runwarden.llm import repeats, suffix_array, suffix_tree


def brute(rows, window, units, join):
    docs = [(r[0], units(r[1] or "")) for r in rows]
    seen = collections.Counter(tuple(w[p : p + window]) for _, w in docs for p in range(len(w) - window + 1))
    out = []
    for i, w in docs:
        gone = np.zeros(len(w), bool)
        for p in range(len(w) - window + 1):
            if seen[tuple(w[p : p + window])] > 1:
                gone[p : p + window] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(w), int(gone.sum()), runs, hashlib.sha256(join([x for x, g in zip(w, gone, strict=True) if not g])).hexdigest()))
    return sorted(out)


def by_words(rows, window):
    return [(i, n, g, s) for i, n, g, _, s in brute(rows, window, lambda t: t.encode().split(), b" ".join)]


def by_bytes(rows, window):
    return brute(rows, window, lambda t: list(t.encode()), bytes)


@pytest.mark.parametrize(("window", "gram", "crowd"), [(35, 8, 96), (35, 8, 1), (12, 3, 3)])
def test_suffix_tree(docs, rows, monkeypatch, window, gram, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    monkeypatch.setattr(suffix_tree, "HOT_SHARE", 4 if crowd > 1 else 60)
    got = sorted(map(tuple, suffix_tree.deduplicated(docs, window, gram).collect()))
    assert got == by_words(rows, window)


@pytest.mark.parametrize(("window", "gram", "crowd"), [(400, 128, 96), (90, 20, 1)])
def test_prefix_doubling(docs, rows, monkeypatch, window, gram, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    got = sorted(map(tuple, suffix_array.deduplicated(docs, window, gram).collect()))
    assert got == by_bytes(rows, window)


def test_substitutions_of_equal_length(spark):
    """Near copies whose edits keep lengths and most sampled places: what lies between two equal stretches may differ."""
    rng = random.Random(11)
    base = [rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(4000)]
    rows = []
    for i in range(24):
        edited = list(base)
        for at in rng.sample(range(len(base)), 1 + i % 12):
            edited[at] = rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        rows.append((i, "".join(edited), "", "", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(map(tuple, suffix_array.deduplicated(docs, 400, 20).collect())) == by_bytes(rows, 400)
    assert sorted(map(tuple, suffix_array.deduplicated(docs, 90, 20).collect())) == by_bytes(rows, 90)


def test_rows_that_repeat_id_and_text(spark):
    """Ten rows of one text of many stretches, whose ranks must not multiply."""
    rng = random.Random(12)
    text, other = ("".join(rng.choice("abcdefgh") for _ in range(n)) for n in (12_000, 3000))
    rows = [(1, text, "", "", 0)] * 10 + [(2, text[2000:4000] + other, "", "", 0)] * 3 + [(3, text[:399], "", "", 0)] * 2 + [(4, None, "", "", 0)] * 2 + [(5, text[500:1500] + "tail", "", "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = suffix_array.repeated_ranges(repeats.keyed(docs))
    assert found.count() < 500
    assert sorted(map(tuple, suffix_array.deduplicated(docs).collect())) == by_bytes(rows, 400)


def test_a_long_text_after_empty_ones_is_cut(monkeypatch):
    """What stands beside a long text in a batch does not change how it is cut."""
    monkeypatch.setattr(repeats, "PIECE", 700)
    rng = random.Random(13)
    long_, short = ("".join(rng.choice("abcdefgh") for _ in range(n)) for n in (5000, 600))
    names = repeats.Names(), repeats.Names()
    for keys_only in (True, False):
        run = suffix_array.scan(400, 128, names, keys_only)
        found = []
        for texts in (["", "", long_, short, ""], [long_], [short]):
            ids = {"": 1, long_: 2, short: 3}
            b = pa.RecordBatch.from_arrays([pa.array([ids[t] for t in texts], pa.int64()), pa.array([ids[t] for t in texts], pa.int32()), pa.array(texts)], names=["dk", "tag", "text"])
            found.append(sorted(tuple(r.values()) for out in run(iter([b])) for r in out.to_pylist()))
        assert found[0] == sorted(found[1] + found[2])


def test_long_texts_are_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 700)
    monkeypatch.setattr(repeats, "BLOCK", 500)
    text = " ".join(f"w{i}" for i in range(2500))
    rows = [(1, text, "", "", 0), (2, "head " + text[2000:9000] + " tail", "", "", 0), (3, text[100:400] * 9, "", "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(map(tuple, suffix_tree.deduplicated(docs).collect())) == by_words(rows, 35)
    assert sorted(map(tuple, suffix_array.deduplicated(docs).collect())) == by_bytes(rows, 400)


def table_of(spark, texts):
    rows = [(i, t, "", "", 0) for i, t in enumerate(texts)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_words_that_a_polynomial_modulo_two_to_the_64_confuses(spark):
    """Two Thue-Morse words of 1,024 letters, and each beside 34 shared words: nothing repeats."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    twin = word.translate(str.maketrans("ab", "ba"))
    tail = " ".join(f"t{i}" for i in range(34))
    rows, docs = table_of(spark, [f"{word} {tail}", f"{twin} {tail}"])
    assert sorted(map(tuple, suffix_tree.deduplicated(docs).collect())) == by_words(rows, 35)
    rows, docs = table_of(spark, ["x" * 300 + word + "y" * 300, "x" * 300 + twin + "y" * 300, word, twin])
    assert sorted(map(tuple, suffix_array.deduplicated(docs).collect())) == by_bytes(rows, 400)


def test_runs_and_periods(spark):
    """Long runs of one byte or phrase, whole, cut short, and with one byte changed."""
    rng = random.Random(14)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    phrase, long_phrase = noise(37), noise(260)
    texts = ["-" * 3000, noise(500) + "-" * 2000 + noise(90), "-" * 410, "-" * 399, noise(50) + "-" * 700 + "+" + "-" * 900, phrase * 60, noise(300) + phrase * 20 + noise(300), long_phrase * 9, noise(7) + long_phrase * 4, (phrase + "-" * 450) * 5, long_phrase * 3 + "-" * 800 + long_phrase * 3]
    rows, docs = table_of(spark, texts)
    assert sorted(map(tuple, suffix_array.deduplicated(docs).collect())) == by_bytes(rows, 400)
    assert sorted(map(tuple, suffix_array.deduplicated(docs, 90, 20).collect())) == by_bytes(rows, 90)
    rows, docs = table_of(spark, ["- " * 300, "- " * 90 + "end", "a b c " * 40, "x " + "a b c " * 30, "- " * 34, "- " * 35])
    assert sorted(map(tuple, suffix_tree.deduplicated(docs).collect())) == by_words(rows, 35)


def test_names_are_those_of_plain_arithmetic():
    names = repeats.Names()
    raw = np.frombuffer(bytes(range(256)) * 3, np.uint8)
    total = names.sums(raw)
    start, end = np.array([0, 5, 100, 700]), np.array([400, 5, 768, 768])
    want = [sum((int(v) + 1) * pow(names.base, i, repeats.PRIME) for i, v in enumerate(raw[s:e])) % repeats.PRIME for s, e in zip(start, end, strict=True)]
    assert names.of(total, start, end).tolist() == want
    words, first, stop = names.words(b"  one two\tone \x0bthree")
    assert words[0] == words[2] and len(set(words.tolist())) == 3
    assert [(int(a), int(b)) for a, b in zip(first, stop, strict=True)] == [(2, 5), (6, 9), (10, 13), (15, 20)]


def test_words_of_long_texts_do_not_depend_on_pieces(monkeypatch):
    names = repeats.Names()
    raw = b" ".join(b"w%d" % (i * i) for i in range(900))
    want = names.words(raw)
    monkeypatch.setattr(repeats, "PIECE", 50)
    assert all((a == b).all() for a, b in zip(names.words(raw), want, strict=True))
    long_ = names.words(raw[:300].replace(b" ", b"") + b" x " + raw[:300].replace(b" ", b""))[0]
    assert len(long_) == 3 and long_[0] == long_[2] != long_[1]


def test_stretches_that_share_one_name_only_are_not_one(spark):
    """A class has both names: a stretch that shares the first name alone with others repeats none of them."""
    packed = int(repeats.packed(np.array([0]), np.array([0]), np.array([100]), np.array([0]))[0])
    rows = [(1, 77, second, 500, 0, 1, 500, dk, packed, True) for dk, second in ((11, 5), (12, 5), (13, 6))]
    live = spark.createDataFrame(rows, suffix_array.STRETCHES)
    spans = suffix_array.ranked_spans(repeats_scratch(spark), live, 400)
    assert sorted(r.dk for r in spans.collect()) == [11, 12]


def repeats_scratch(spark):
    from runwarden.llm.common import Scratch

    return Scratch(spark, "test-ranks")


def test_empty_table(no_docs):
    assert suffix_tree.deduplicated(no_docs).collect() == []
    assert suffix_array.deduplicated(no_docs).collect() == []


def test_spans(docs, rows):
    text = {r[0]: r[1] for r in rows}
    spans = suffix_tree.maximal_repeats(docs).collect()
    assert spans
    for r in spans:
        assert " ".join(text[r.doc_id].split()[r.start_word : r.end_word]) == r.text
    total = sum(r.end_word - r.start_word for r in spans)
    assert total == sum(r[2] for r in by_words(rows, 35))
    assert sum(r.end_byte - r.start_byte for r in suffix_array.repeat_spans(docs).collect()) == sum(r[2] for r in by_bytes(rows, 400))


def test_contexts_are_decided_in_small_blocks():
    """Windows of many keys that come in one batch need arrays for some of them at a time; a key's texts stay together."""
    rng = np.random.default_rng(3)
    window, n = 400, 6000
    ctx = [rng.bytes(650) for _ in range(n)]
    for i in range(0, n, 10):
        ctx[i + 1] = ctx[i][100:600] + bytes([ctx[i][600] ^ 1]) + ctx[i + 1][501:]
    row = lambda v: np.full(n, v)
    batch = repeats.send(n, np.repeat(np.arange(n // 10), 10), 0, ctx, row(7), row(251), row(0), row(1), np.arange(n), row(0))
    run = repeats.Receiver(window, suffix_array.doubled_repeats(window, 128, repeats.Names()))
    tracemalloc.start()
    got = sorted((d, s, e) for r in run(iter([batch])) for d, _, s, e in zip(*(c.to_pylist() for c in r.columns), strict=True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == sorted(x for i in range(0, n, 10) for x in ((i, 107, 607), (i + 1, 7, 507)))
    assert peak < 120e6
