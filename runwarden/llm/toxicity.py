"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length, with exception phrases.

Text is folded first: compatibility forms, accents, case, look-alike letters of other scripts and digits or signs that stand for letters become
plain letters (and i, l, 1, ! and | are one letter), everything else is a blank. An entry of the lexicon is the beginning of a word, or a whole word when it ends with a blank, so one
pass of the automaton over a text finds every entry in it. Where a hit lies in an exception phrase, it does not count.

Entries come from a short list of insults and from labelled texts: beginnings of words that many toxic texts have and next to no others. Candidates are counted in
tasks, whose sums are added up in a shuffle; only entries that pass reach the driver, MAX_ENTRIES at most. An entry weighs the log of its odds. A text's
hits, weighted, over its number of words give its rate; a logistic curve on the rate, fitted to the labelled rows' histogram, gives the score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import small_batches, staged, table, texts

#: Labelled rows that the lexicon is learned from, lowest hashes of the ids first. The curve is fitted to all of them.
MAX_LABELLED = 20_000
#: Entries of the lexicon, heaviest evidence first.
MAX_ENTRIES = 20_000
#: Letters of a beginning.
SHORTEST, LONGEST = 3, 10
#: An entry stands in so many toxic texts at least, and in so small a share of its texts that are not toxic (after allowing for how rare toxic texts are).
LEAST_TEXTS, MOST_CLEAN, LEAST_EVIDENCE = 3, 0.05, 15.0
THRESHOLD = 0.7

#: Insults that need no labels, and phrases in which such a word is none.
INSULTS = ("idiot", "moron", "imbecile", "stupid", "scum", "loser", "pathetic", "worthless", "disgusting", "trash", "dumbass", "bastard", "asshole", "bitch", "crétin", "connard", "abruti", "idiota", "imbécil", "estúpido", "pendejo", "arschloch", "vollidiot", "dummkopf")
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "the trash", "sore loser", "bastard sword", "bastard file", "stupid simple", "loser bracket")
#: What an insult weighs before labels say more.
BASE_WEIGHT = 4.0

#: Letters of other scripts, digits and signs that look like Latin letters.
ALIKE = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "ԛ": "q",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "l": "i",
}
#: Signs that are letters between letters only.
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "+": "t", "€": "e"}
_SIGN = re.compile(r"(?<=\w)[@$!|+€]{1,3}(?=\w)")


class _Letters(dict):
    """What each character is folded to; found out once a character."""

    def __missing__(self, code: int) -> str:
        out = []
        for c in unicodedata.normalize("NFKD", chr(code)).casefold():
            for d in unicodedata.normalize("NFKD", c):
                if unicodedata.combining(d):
                    continue
                d = ALIKE.get(d, d)
                out.append(ALIKE.get(d, d) if len(d) > 1 or d.isalnum() else " ")
        self[code] = "".join(out).replace("l", "i")
        return self[code]


_LETTERS = _Letters()


def fold(text: str) -> str:
    """The text in folded letters; anything else is a blank. Combining accents vanish."""
    return _SIGN.sub(lambda m: "".join(SIGNS[c] for c in m[0]), text).translate(_LETTERS)


@dataclass
class Lexicon:
    """Folded entries with weights, folded exception phrases, and the curve."""

    weights: dict[str, float] = field(default_factory=lambda: {" " + fold(w): BASE_WEIGHT for w in INSULTS})
    exceptions: tuple[str, ...] = tuple(fold(p) for p in EXCEPTIONS)
    intercept: float = -4.0
    slope: float = 6.0

    def automaton(self):
        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (len(phrase) + 2, None))
        found.make_automaton()
        return found


def hits(automaton, text: str) -> tuple[float, int, int]:
    """(weight, hits, words) of a folded text. Entries that begin at the same place count once, with the greatest weight."""
    words = text.split()
    line = f" {' '.join(words)} "
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (n, weight) in automaton.iter(line):
        start = end - n + 1
        if weight is None:
            spared.append((start, end))
        elif weight > best.get(start, 0.0):
            best[start] = weight
    for a, b in spared:
        for start in [s for s in best if a <= s < b]:
            del best[start]
    return sum(best.values()), len(best), len(words)


def rate_of(weight: float, words: int) -> float:
    """Weight over the square root of the number of words, on a scale that grows slowly: what single chance hits add up to in a long text is left out."""
    return math.log1p(weight / math.sqrt(words + 4))


def beginnings(text: str) -> set[str]:
    """Of each word of a folded text: its beginnings of SHORTEST to LONGEST letters, and the word with a blank after it."""
    out: set[str] = set()
    for w in set(text.split()):
        if len(w) >= SHORTEST:
            out.update(w[:k] for k in range(SHORTEST, min(len(w), LONGEST) + 1))
            out.add(w + " ")
    return out


#: Counts that a task holds before it gives them on.
HELD = 400_000


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[int]] = {}

    def give():
        rows = list(held.values())
        out = pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[0] for r in rows], pa.int64())], names=["entry", "toxic", "clean"])
        held.clear()
        return out

    for b in batches:
        for y, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            for e in beginnings(fold(t.as_py())):
                held.setdefault(e, [0, 0])[y] += 1
            if len(held) > HELD:
                yield give()
    if held:
        yield give()


def labelled(labels: DataFrame, label_col: str = "toxic") -> DataFrame:
    """(doc_id, y) of the labelled ids outside the held-out fold; an id with both labels is toxic."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    return known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", base: Lexicon | None = None) -> Lexicon:
    """base (the list of insults by default) with entries learned from labelled texts, a bounded sample of MAX_LABELLED ids. Without labels of both kinds it is base alone."""
    lexicon = base or Lexicon()
    pick = labelled(labels, label_col).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    rows = texts(docs).join(F.broadcast(pick), "doc_id").select("y", "text")
    counts = staged(rows.mapInArrow(_counted, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "beginnings")
    sizes = {r.y: r.n for r in docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(F.broadcast(pick), "doc_id").groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return lexicon
    # Twice the log likelihood ratio of "in toxic texts only by its share of texts" against what was counted.
    t, c = F.col("toxic") / F.lit(toxic), F.col("clean") / F.lit(clean)
    mean = (F.col("toxic") + F.col("clean")) / F.lit(toxic + clean)
    evidence = 2 * (F.col("toxic") * F.log(t / mean) + F.when(F.col("clean") > 0, F.col("clean") * F.log(c / mean)).otherwise(0.0))
    good = counts.where((F.col("toxic") >= LEAST_TEXTS) & (c <= t * MOST_CLEAN)).withColumn("evidence", evidence).where(F.col("evidence") >= LEAST_EVIDENCE)
    found = good.orderBy(F.desc("evidence"), "entry").limit(MAX_ENTRIES).select("entry", "toxic", "clean").collect()
    number = {r.entry: (r.toxic, r.clean) for r in found}
    for entry, (a, b) in number.items():
        shorter = [entry.rstrip()[:k] for k in range(SHORTEST, len(entry))]
        # A beginning that stands in as many toxic texts as a longer one says no more than the longer one; a longer one that stands in fewer is found by the shorter one.
        longer_as_good = any(number.get(entry + c, (0, 0))[0] == a for c in "abcdefghijkmnopqrstuvwxyz ")
        if not longer_as_good and not any(number.get(s, (0, 1 << 60))[0] > a and number[s][1] * a <= max(b, 0) * number[s][0] for s in shorter):
            lexicon.weights[" " + entry] = math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))
    return lexicon


def rated(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, weight, hits, words, rate) of every whole text: null texts count as empty, rows stay rows, empty tables stay empty, other columns are not looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value.automaton()
        for b in batches:
            found = [hits(automaton, fold(t.as_py())) for t in b.column(1)]
            if found:
                w, h, n = (list(c) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(w, pa.float64()), pa.array(h, pa.int64()), pa.array(n, pa.int64()), pa.array(list(map(rate_of, w, n)))], names=["doc_id", "weight", "hits", "words", "rate"])

    small_batches(docs.sparkSession)
    return texts(docs).mapInArrow(run, "doc_id long, weight double, hits long, words long, rate double")


#: Steps of the rates' histogram for each unit.
STEPS = 32


def curve(rates: DataFrame, labels: DataFrame, lexicon: Lexicon, label_col: str = "toxic") -> tuple[float, float]:
    """(intercept, slope) of the logistic curve on rates, by Newton's steps on their histogram over all labelled rows outside the held-out fold; a slight pull towards zero keeps it finite."""
    own = rates.join(labelled(labels, label_col), "doc_id").select((F.round(F.col("rate") * STEPS) / STEPS).alias("x"), "y")
    rows = own.groupBy("x", "y").agg(F.count("*").alias("n")).collect()  # a rate is at most log(1 + the greatest weight * sqrt(words)): a bounded number of steps
    if len({r.y for r in rows}) < 2:
        return lexicon.intercept, lexicon.slope
    x, y, n = (np.array([r[k] for r in rows], float) for k in ("x", "y", "n"))
    design, at = np.stack([np.ones_like(x), x]), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(at @ design, -30, 30)))
        slope = design @ (n * (y - p)) - 0.1 * at
        bend = (design * (n * p * (1 - p) + 1e-9)) @ design.T + 0.1 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        at += step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
    return float(at[0]), float(at[1])


def scored(rates: DataFrame, lexicon: Lexicon) -> DataFrame:
    """rates and score."""
    return rates.withColumn("score", 1 / (1 + F.exp(-(F.lit(lexicon.intercept) + F.lit(lexicon.slope) * F.col("rate")))))


def toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", base: Lexicon | None = None) -> DataFrame:
    """(doc_id, weight, hits, words, rate, score), one row per row of docs: lexicon and curve are learned from the labelled rows, then every whole text is scored once.

    Null and empty texts have rate 0 and the score of texts without hits. Rows that repeat an id are rows of their own. An empty table gives no rows.
    """
    lexicon = learn(docs, labels, label_col, base)
    rates = staged(rated(docs, lexicon), "rates")
    lexicon.intercept, lexicon.slope = curve(rates, labels, lexicon, label_col)
    return scored(rates, lexicon)


def op12_toxicity(spark, sf_dir: str) -> DataFrame:
    out = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "hits", "words")
