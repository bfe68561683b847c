"""Periodic runs of words, found with a suffix automaton whose link tree is accessed as a link-cut tree.

The words of a document are numbers. A suffix automaton is built over them; the states that hold the prefix ending at word i and its suffixes are the path from
that prefix's state to the root of the link tree. Every path carries the place where its words ended last. When word i is appended, `access` walks from the
prefix's state to the root over the preferred paths, each of one last end: a path that ended at j and reaches up to L words says that
the L words before i stood before j too. Where i - j <= L that is a square of period i - j, and i - j is its smallest period, because a
smaller one would have been a later end. The whole path then has the new end. A square is extended to both sides as far as words one period apart are the same: a run.

Only runs of at least four periods are asked for, and each of their words stands in the stretch at least four times. So a document is cut at words that
are rarer than that, again within each stretch, until every word of a stretch is frequent in it; what is left (most texts: nothing) goes to the automaton. A
word that extends a run is as frequent as the run's own, so no cut shortens a run.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table, texts

#: A run has this many words at least, and this many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4

SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def suffix_automaton(s: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(length, link, state of each prefix) of the automaton of s; state 0 is the root."""
    length, link, step = [0], [-1], [{}]
    prefix, last = [], 0
    for c in s:
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        step.append({})
        prefix.append(new)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                step.append(dict(step[q]))
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return length, link, prefix


class Access:
    """Preferred paths of a rooted tree as splay trees by depth. Each path has one value (the last end), which its splay tree's root holds."""

    def __init__(self, parent: list[int]):
        self.up, self.left, self.right = list(parent), [-1] * len(parent), [-1] * len(parent)
        self.value = [-1] * len(parent)

    def splay(self, x: int) -> None:
        """x becomes the root of its splay tree, and takes the path's value over."""
        up, left, right, value = self.up, self.left, self.right, self.value

        def rotate(x: int) -> None:
            p = up[x]
            g = up[p]
            if left[p] == x:
                b = left[p] = right[x]
                right[x] = p
            else:
                b = right[p] = left[x]
                left[x] = p
            if b >= 0:
                up[b] = p
            up[p], up[x] = x, g
            if g >= 0:
                if left[g] == p:
                    left[g] = x
                    return
                if right[g] == p:
                    right[g] = x
                    return
            value[x] = value[p]

        while (p := up[x]) >= 0 and (left[p] == x or right[p] == x):
            g = up[p]
            if g >= 0 and (left[g] == p or right[g] == p):
                rotate(p if (left[g] == p) == (left[p] == x) else x)
            rotate(x)

    def access(self, x: int, now: int) -> list[tuple[int, int]]:
        """(deepest node, value) of each preferred path between x and the root that has a value; then the whole way from the root to x is one path with value `now`."""
        up, right, value = self.up, self.right, self.value
        out, below, z = [], -1, x
        while z >= 0:
            self.splay(z)
            if value[z] >= 0:
                out.append((z, value[z]))
            cut = right[z]
            if cut >= 0:  # what is below z on its old path keeps the old value
                value[cut] = value[z]
            right[z] = below
            if below >= 0:
                up[below] = z
            below, z = z, up[z]
        value[below] = now
        return out


def stretch_runs(s: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of s."""
    length, link, prefix = suffix_automaton(s)
    tree, n, reached, out = Access(link), len(s), {}, []
    for i, state in enumerate(prefix):
        for node, end in tree.access(state, i):
            d = i - end
            if d > length[node] or reached.get(d, -1) >= i:
                continue
            a, b = i - 2 * d, i
            while a >= 0 and s[a] == s[a + d]:
                a -= 1
            while b + 1 < n and s[b + 1] == s[b + 1 - d]:
                b += 1
            reached[d] = b
            if b - a >= max(LEAST_WORDS, LEAST_PERIODS * d):
                out.append((a + 1, b - a, d))
    return out


def frequent_stretches(ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(start, words) of the stretches of ids whose every word stands in its stretch at least LEAST_PERIODS times."""
    open_ = [(0, ids)]
    while open_:
        at, s = open_.pop()
        if len(s) < LEAST_WORDS:
            continue
        _, own, count = np.unique(s, return_inverse=True, return_counts=True)
        rare = np.flatnonzero(count[own] < LEAST_PERIODS)
        if not len(rare):
            yield at, s
            continue
        edges = np.concatenate([[-1], rare, [len(s)]])
        long_ = np.flatnonzero(np.diff(edges) > LEAST_WORDS)
        open_ += [(at + int(edges[k]) + 1, s[edges[k] + 1 : edges[k + 1]]) for k in long_]


def word_runs(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the words, by start, then period."""
    if len(words) < LEAST_WORDS:
        return []
    number: dict = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    if len(number) + LEAST_PERIODS > len(words) + 1:  # no word can stand there often enough
        return []
    return sorted((at + a, n, q) for at, s in frequent_stretches(ids) for a, n, q in stretch_runs(s.tolist()))


def _row(words: list[bytes]) -> tuple:
    runs = word_runs(words)
    kept = words
    if runs:
        stay = np.ones(len(words), bool)
        for a, n, q in runs:
            stay[a + q : a + n] = False
        kept = [words[i] for i in np.flatnonzero(stay).tolist()]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    most = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
    return len(runs), *most, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", change: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256), one row per row of docs.

    Words are `[^\\x20\\x09-\\x0D]+` of the whole text; `change` may replace the words of a document before they are judged. start to exponent_milli are those of
    the longest run (ties: smallest start, then period), null without runs. A word is left out of the collapsed text if a run has it after its first period.
    Null and empty texts have no words and no runs; rows that repeat an id are rows of their own; an empty table gives no rows; other columns are not looked at.
    A very long text is judged whole: some hundreds of bytes for each word of its repetitive stretches are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = t.as_py().encode("utf-8", "surrogatepass").split()
                rows.append(_row(change(i, words) if change else words))
            if rows:
                kinds = (*(pa.int64(),) * 5, pa.string(), pa.string())
                names = [c.split()[0] for c in SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=names)

    return texts(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def repeat_tails(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's rule: in every tenth document by crc32 of the id, the words from some place on repeat with some period."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), change=repeat_tails)
