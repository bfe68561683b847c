"""Array operations that both substring operators share: sequences of units (words or bytes), names of stretches and sampled places.

A window is W consecutive units of one document. Each window is filed under its lowest-named gram of K units (its anchor; the first of
equals): two windows that are equal have equal anchors at equal places in them. So only anchors, a few hundredths of all places,
need to meet in a shuffle, and an anchor whose gram occurs once can be dropped with all the windows it serves.

Grams are named by polynomials modulo 2^64: texts can be made whose grams share a name, which costs time and decides nothing. What is
decided, is decided by names modulo the prime 2^61 - 1 over bases that are drawn anew for each run: whatever the texts are, two
stretches of n units share a name with a chance of n / 2^61.
"""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import texts

U = np.uint64
PRIME = (1 << 61) - 1
_P, _61, _32, _31, _30 = U(PRIME), U(61), U(32), U(31), U(30)
_M32, _M31, _M30 = U((1 << 32) - 1), U((1 << 31) - 1), U((1 << 30) - 1)
_RNG = np.random.default_rng(1009)
#: Random values of bytes and a base with its inverse modulo 2^64, for grams.
BYTES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
PLACE_BITS = 24
#: Units of a document that are looked at together; longer documents are cut into overlapping pieces.
PIECE = 4_000_000
#: Bytes of documents that are looked at together.
BLOCK = 1 << 19
_powers = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        size = 1 << max(16, int(n).bit_length())
        for i, b in enumerate((BASE, INVERSE)):
            steps = np.full(size, b, U)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(31))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(29)
    h *= U(0x94D049BB133111EB)
    return h ^ (h >> U(32))


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime."""
    x = (x & _P) + (x >> _61)
    return np.where(x >= _P, x - _P, x)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, of numbers below it, by halves of 31 bits."""
    au, ad, bu, bd = a >> _31, a & _M31, b >> _31, b & _M31
    mid = ad * bu + au * bd
    return reduced(au * bu * U(2) + (mid >> _30) + ((mid & _M30) << _31) + ad * bd)


def _joined_halves(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """high * 2^32 + low modulo the prime; multiplying by 2^32 is a rotation of 61 bits."""
    high = reduced(high)
    return reduced(((high << _32) & _P) + (high >> U(29)) + reduced(low))


class Names:
    """Names of stretches of units, over one random base. Bytes count as their value and one, words as their own names."""

    def __init__(self, base: int | None = None):
        self.base = base or random.SystemRandom().randrange(1 << 40, PRIME)

    def __reduce__(self):
        return Names, (self.base,)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Powers of the base as high and low halves, and of its inverse."""
        own = self.__dict__.get("own")
        if own is None or len(own[0]) <= n:
            size, both = 1 << max(12, int(n).bit_length()), []
            for b in (self.base, pow(self.base, -1, PRIME)):
                p = np.ones(1, U)
                while len(p) < size:
                    p = np.concatenate([p, product(p, U(pow(b, len(p), PRIME)))])
                both.append(p)
            self.own = own = (both[0] >> _32, both[0] & _M32, both[1])
        return own

    def sums(self, units: np.ndarray) -> np.ndarray:
        """Prefix sums from which of() takes the name of any stretch; units: bytes, or names of words."""
        n, out = len(units), np.zeros(len(units) + 1, U)
        high, low, _ = self.powers(n)
        if units.dtype == np.uint8:
            v = units.astype(U) + U(1)
            out[1:] = _joined_halves(np.cumsum(v * high[:n]), np.cumsum(v * low[:n]))
        else:
            t = product(units, (high[:n] << _32) | low[:n])
            out[1:] = _joined_halves(np.cumsum(t >> _32), np.cumsum(t & _M32))
        return out

    def of(self, total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        a, b = total[end], total[start]
        return product(np.where(a >= b, a - b, a + _P - b), self.powers(len(total))[2][start])

    def words(self, joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(names, first bytes, ends) of the words of joined bytes, which are looked at piece by piece."""
        b = np.frombuffer(joined, np.uint8)
        parts, at = [], 0
        while at < len(b):
            end = min(len(b), at + PIECE)
            if end < len(b):
                gap = np.flatnonzero(_SPACE[b[at:end]])
                if len(gap):
                    end = at + int(gap[-1]) + 1
                else:
                    end = next((i + 1 for i in range(end, len(b)) if _SPACE[b[i]]), len(b))
            piece = b[at:end]
            edge = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[piece], [True]]).astype(np.int8)))
            start, stop = edge[::2], edge[1::2]
            if len(piece) <= PIECE:
                name = self.of(self.sums(piece), start, stop)
            else:  # one word longer than a piece
                name = np.array([int.from_bytes(hashlib.blake2b(piece[s:e].tobytes(), digest_size=8, key=self.base.to_bytes(8, "big")).digest(), "big") % PRIME for s, e in zip(start, stop, strict=True)], U)
            parts.append((name, start + at, stop + at))
            at = end
        if not parts:
            return np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    size, out = 1, v
    while size * 2 <= w:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(v) - w + 1], out[w - size :][: len(v) - w + 1]) if w > size else out


def anchors(units: np.ndarray, bounds: np.ndarray, window: int, gram: int):
    """(place, low, high, key): for each anchor the first and the last window it serves, and its gram's name.

    bounds: where documents begin in units, and the end. Windows never cross documents.
    """
    n, none = len(units), np.empty(0, np.int64)
    if n < window:
        return none, none, none, np.empty(0, U)
    total = np.zeros(n + 1, U)
    np.cumsum(units * powers(n)[0][:n], out=total[1:])
    at = np.arange(n - gram + 1)
    g = mixed((total[gram:] - total[:-gram]) * powers(n)[1][: n - gram + 1])
    mask = U((1 << PLACE_BITS) - 1)
    least = sliding_min((g & ~mask) | at.astype(U), window - gram + 1)
    until = np.repeat(bounds[1:], np.diff(bounds))[: n - window + 1]
    p = np.flatnonzero(at[: n - window + 1] + window <= until)
    if not len(p):
        return none, none, none, np.empty(0, U)
    x = (least[p] & mask).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    last = np.append(first[1:], len(p)) - 1
    return x[first], p[first], p[last], g[x[first]]


def blocks(sizes: list[int], limit: int = BLOCK):
    """(from, to) of runs of items of about `limit` together."""
    start, held = 0, 0
    for i, s in enumerate(sizes):
        if held and held + s > limit:
            yield start, i
            start, held = i, 0
        held += s
    if start < len(sizes):
        yield start, len(sizes)


def pieces(units: np.ndarray, window: int):
    """(offset, units) of overlapping pieces, so that each window lies in one."""
    for s in range(0, max(1, len(units) - window + 1), PIECE):
        yield s, units[s : s + PIECE + window - 1]


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, dk, tag, text): dk and tag tell documents apart, 78 bits of hashes of id and text that begin with numbers drawn for this run.

    Rows that repeat id and text share them, and what holds for one of these holds for the other.
    """
    t = texts(docs, id_col, text_col)
    drawn = [F.lit(random.SystemRandom().getrandbits(62)) for _ in range(3)]
    dk = F.xxhash64(drawn[0], drawn[1], F.col("doc_id"), F.col("text"))
    tag = F.hash(drawn[2], F.col("text"), F.col("doc_id")).bitwiseAND(F.lit((1 << 14) - 1))
    return t.select("doc_id", dk.alias("dk"), tag.alias("tag"), "text")


#: An anchor in one long: place (32 bits), places back to the first and to the last window it serves (9 bits each), tag (14 bits).
def packed(place: np.ndarray, low: np.ndarray, high: np.ndarray, tag: np.ndarray) -> np.ndarray:
    return (place.astype(np.int64) << 32) | ((place - low) << 23) | ((place - high) << 14) | tag


def place_of(p: Column) -> Column:
    return F.shiftright(p, 32)


def low_of(p: Column) -> Column:
    return place_of(p) - F.shiftright(p, 23).bitwiseAND(F.lit(511))


def high_of(p: Column) -> Column:
    return place_of(p) - F.shiftright(p, 14).bitwiseAND(F.lit(511))


def tag_of(p: Column) -> Column:
    return p.bitwiseAND(F.lit((1 << 14) - 1)).cast("int")


def runs_of(sorted_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of runs of consecutive numbers."""
    cut = np.flatnonzero(np.diff(sorted_starts) != 1)
    return sorted_starts[np.concatenate([[0], cut + 1])], sorted_starts[np.concatenate([cut, [len(sorted_starts) - 1]])]


def covered(ranges, n: int) -> np.ndarray:
    """Which of n units lie in one of the ranges (start, end)."""
    if not ranges:
        return np.zeros(n, bool)
    step = np.zeros(n + 1, np.int64)
    r = np.array(ranges, np.int64).reshape(-1, 2)
    np.add.at(step, np.minimum(r[:, 0], n), 1)
    np.add.at(step, np.minimum(r[:, 1], n), -1)
    return np.cumsum(step[:n]) > 0


RANGES = "dk long, tag int, start long, stop long"


def range_batch(dk, tag, start, stop) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(dk, pa.int64()), pa.array(tag, pa.int32()), pa.array(start, pa.int64()), pa.array(stop, pa.int64())], names=["dk", "tag", "start", "stop"])


def with_ranges(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """(doc_id, text, ranges): every document with its ranges (null if it has none)."""
    own = ranges.groupBy("dk", "tag").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    return docs.join(own, ["dk", "tag"], "left").select("doc_id", "text", "ranges")


# ---- windows of contexts -------------------------------------------------------------------------------------------------------
#: Contexts under one gram from which its windows are filed one by one, under their own whole names.
CROWD = 96
#: Bytes of contexts whose windows are decided together.
CONTEXTS = 1 << 19
#: Single windows that a task holds until it sends one of each.
WINDOWS = 400_000
SENT = "key long, kind int, ctx binary, start long, wins int, second long, n int, dk long, tag int"


def send(sizes: int, key, kind, ctx, start, wins, second, n, dk, tag) -> pa.RecordBatch:
    full = lambda x, t: pa.array(np.broadcast_to(x, sizes) if not isinstance(x, list) else x, t)
    cols = [full(key, pa.int64()), full(kind, pa.int32()), pa.nulls(sizes, pa.binary()) if ctx is None else pa.array(ctx, pa.binary()), full(start, pa.int64()), full(wins, pa.int32()), full(second, pa.int64()), full(n, pa.int32()), full(dk, pa.int64()), full(tag, pa.int32())]
    return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in SENT.split(", ")])


class Sender:
    """Turns the anchors chosen in documents into rows: contexts (kind 0) or, under crowded grams, single windows (kind 1).

    Windows that repeat among those that a task holds are decided there (kind 2: ranges), and one of each goes on, marked as decided (n = 2).
    """

    def __init__(self, window: int, slices, window_names):
        """slices(text) -> an object whose cut(low, high) gives the bytes of units [low, high); window_names(text, starts) -> two names."""
        self.window, self.slices, self.window_names = window, slices, window_names

    def __call__(self, batches):
        rows, single, windows = [], [], 0
        for b in batches:
            for dk, tag, text, picks in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                cut = self.slices(text).cut
                starts = []
                for key, low, high, crowded in {(p["key"], p["low"], p["high"], p["crowded"]) for p in picks}:
                    if crowded:
                        starts.append(np.arange(low, high + 1))
                    else:
                        rows.append((key, cut(low, high + self.window), low, high - low + 1, dk, tag))
                if starts:
                    s = np.unique(np.concatenate(starts))
                    first, second = self.window_names(text, s)
                    single.append((first, second, s, np.full(len(s), dk, np.int64), np.full(len(s), tag, np.int64)))
                    windows += len(s)
                if len(rows) >= 2000:
                    yield from self.contexts(rows)
                    rows = []
                if windows >= WINDOWS:
                    yield from self.windows(single)
                    single, windows = [], 0
        yield from self.contexts(rows)
        yield from self.windows(single)

    def contexts(self, rows):
        if rows:
            key, ctx, low, wins, dk, tag = map(list, zip(*rows, strict=True))
            yield send(len(key), key, 0, ctx, low, wins, 0, 1, dk, tag)

    def windows(self, single):
        if not single:
            return
        a, c, s, dk, tag = (np.concatenate(x) for x in zip(*single, strict=True))
        order = np.lexsort((s, tag, dk, c, a))
        a, c, s, dk, tag = (x[order] for x in (a, c, s, dk, tag))
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])]))
        count = np.diff(np.append(first, len(a)))
        for i in range(0, len(first), 50_000):
            f = first[i : i + 50_000]
            yield send(len(f), a[f].view(np.int64), 1, None, s[f], 1, c[f].view(np.int64), np.minimum(count[i : i + 50_000], 2), dk[f], tag[f])
        twice = np.repeat(count, count) > 1
        for d, t, x, y in joined_ranges(dk[twice], tag[twice], s[twice], self.window):
            yield send(len(d), d, 2, None, x, 0, y, 0, d, t)


def joined_ranges(dk, tag, start, window):
    """Batches of (dk, tag, start, stop) covering the windows, consecutive ones joined."""
    if not len(dk):
        return
    order = np.lexsort((start, tag, dk))
    dk, tag, start = dk[order], tag[order], start[order]
    new = np.flatnonzero(np.concatenate([[True], (dk[1:] != dk[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] - start[:-1] > 1)]))
    last = np.append(new[1:], len(dk)) - 1
    for i in range(0, len(new), 50_000):
        f, e = new[i : i + 50_000], last[i : i + 50_000]
        yield dk[f], tag[f], start[f], start[e] + window


class Receiver:
    """Decides sent rows that come sorted by key: gives ranges of windows that occur elsewhere.

    repeated(contexts, counts of windows, number of the key of each context) -> for each window, in order, whether it occurs twice.
    """

    def __init__(self, window: int, repeated, flush_bytes: int = 6_000_000):
        self.window, self.repeated, self.flush_bytes = window, repeated, flush_bytes

    def __call__(self, batches):
        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.nbytes
            if size > self.flush_bytes:
                t = pa.Table.from_batches(held).combine_chunks()
                key = t["key"].to_numpy()
                done = int(np.searchsorted(key, key[-1]))
                if done:
                    yield from self.decide(t.slice(0, done))
                held = t.slice(done).to_batches()
                size = sum(x.nbytes for x in held) if done else 0
        if held:
            yield from self.decide(pa.Table.from_batches(held).combine_chunks())

    def decide(self, t: pa.Table):
        kind = t["kind"].to_numpy()
        own = t.filter(pa.array(kind == 2))
        if own.num_rows:
            yield range_batch(own["dk"].to_numpy(), own["tag"].to_numpy(), own["start"].to_numpy(), own["second"].to_numpy())
        ones = t.filter(pa.array(kind == 1))
        if ones.num_rows:
            a, c, n = ones["key"].to_numpy(), ones["second"].to_numpy(), ones["n"].to_numpy()
            order = np.lexsort((c, a))
            same = (a[order][1:] == a[order][:-1]) & (c[order][1:] == c[order][:-1])
            twice = np.zeros(len(a), bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            hit = np.flatnonzero(twice & (n == 1))
            for r in joined_ranges(ones["dk"].to_numpy()[hit], ones["tag"].to_numpy()[hit], ones["start"].to_numpy()[hit], self.window):
                yield range_batch(*r)
        ctxs = t.filter(pa.array(kind == 0))
        if ctxs.num_rows:
            key = ctxs["key"].to_numpy()
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            size = np.add.reduceat(pc.binary_length(ctxs["ctx"]).to_numpy().astype(np.int64), first[:-1])
            for i, j in blocks(size.tolist(), CONTEXTS):
                yield from self.decide_contexts(ctxs.slice(first[i], first[j] - first[i]))

    def decide_contexts(self, ctxs: pa.Table):
        """Contexts of whole keys: arrays of several numbers for each of their bytes are held at once."""
        wins = ctxs["wins"].to_numpy().astype(np.int64)
        _, group = np.unique(ctxs["key"].to_numpy(), return_inverse=True)
        twice = self.repeated(ctxs["ctx"].to_pylist(), wins, group)
        row = np.repeat(np.arange(len(wins)), wins)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(wins) - wins, wins)
        start = ctxs["start"].to_numpy()[row] + nth
        for r in joined_ranges(ctxs["dk"].to_numpy()[row][twice], ctxs["tag"].to_numpy()[row][twice], start[twice], self.window):
            yield range_batch(*r)
