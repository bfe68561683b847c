"""Substring dedup by distributed prefix doubling, over bytes.

Sampled places of every text (the starts of the lowest-named 128-byte grams of its 400-byte windows, and its first byte) cut it into stretches. Spark
ranks the places by the stretch that begins there, then by pairs of ranks: that of a place and that of the place 1, 2, 4, ...
stretches on. After each sort a place whose pair is unique is done; the others get the rank of the first place of their class, until what
they have in common is longer than two windows. Ranked classes with more than one place are repeats, removed in whole; one
place of each stands for all from then on.

What is left are windows that begin or end inside a stretch where copies part. Each is served by one sampled place; the text that a
place serves is sent once to where its gram's texts meet, and its windows are ranked there by the same doubling: names of 128, 256 and
400 bytes, each over those that still share the last. Grams with many different texts are filed window by window instead.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import repeats as R
from .common import Scratch, batches_by_bytes, partitions_of, table

WINDOW, GRAM = 400, 128
STRETCHES = "key long, name long, name2 long, size long, nth long, hop int, reach int, dk long, packed long, serves boolean"


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def scan(window: int, gram: int, names: tuple[R.Names, R.Names], keys_only: bool):
    """Sampled places of every whole text, in order: gram, two names and size of the stretch that begins there, document and place.

    A stretch runs to the end of the next place's gram, the last one to the end of the text. A first row that serves no window begins
    at byte 0 unless a sampled place does. Where one stretch follows itself again and again (a run of one byte, a repeated phrase) it is
    lengthened by as many of its successors as `reach` asks for. `hop` says how many places on the next half begins; `reach` is how far
    from the place ranks matter: to the end of the last window that the next place serves.
    """

    def one(raw, bounds, dk, tag):
        place, low, high, key = R.anchors(R.BYTES[raw], bounds, window, gram)
        if not len(place):
            return None
        if keys_only:
            return [pa.array(key.view(np.int64))]
        doc = np.searchsorted(bounds, place, side="right") - 1
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        begin = first[place[first] > bounds[doc[first]]]
        at = bounds[doc[begin]]
        serves = np.insert(np.ones(len(place), bool), begin, False)
        place, low, high, doc = np.insert(place, begin, at), np.insert(low, begin, at), np.insert(high, begin, at), np.insert(doc, begin, doc[begin])
        totals = [n.sums(raw) for n in names]
        # The gram of a first row must repeat too if the row is to live; the key is only looked up.
        key = np.insert(key, begin, key[begin])
        last = np.append(doc[1:] != doc[:-1], True)
        ahead = np.append(place[1:], 0)
        stop = np.where(last, bounds[doc + 1], ahead + gram)
        both = [n.of(t, place, stop) for n, t in zip(names, totals, strict=True)]
        gap = np.where(last, 1, ahead - place)
        reach = np.where(last, stop - place, gap + window)
        i = np.arange(len(place))
        same = np.append((both[0][1:] == both[0][:-1]) & (both[1][1:] == both[1][:-1]) & ((stop - place)[1:] == (stop - place)[:-1]) & ~last[:-1] & ~last[1:], False)
        ends = np.flatnonzero(~same)
        more = np.minimum(ends[np.searchsorted(ends, i)] - i, -(-(window - gram) // gap))
        long_ = np.flatnonzero(more > 0)
        stop = stop[i + more]
        for own, n, t in zip(both, names, totals, strict=True):
            own[long_] = n.of(t, place[long_], stop[long_])
        start = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        nth = i - np.repeat(start, np.diff(np.append(start, len(doc))))
        base = bounds[doc]
        p = R.packed(place - base, low - base, high - base, tag[doc])
        return [pa.array(key.view(np.int64)), *(pa.array(n.view(np.int64)) for n in both), pa.array(stop - place), pa.array(nth), pa.array((more + 1).astype(np.int32)), pa.array(reach.astype(np.int32)), pa.array(dk[doc]), pa.array(p), pa.array(serves)]

    columns = ["key"] if keys_only else [c.split()[0] for c in STRETCHES.split(", ")]

    def run(batches):
        for b in batches:
            raw = [_bytes(t) for t in b.column(2).to_pylist()]
            dk, tag = b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int64)
            for k in [k for k, r in enumerate(raw) if len(r) > R.PIECE]:
                yield from long_text(raw[k], dk[k : k + 1], tag[k : k + 1])
                raw[k] = b""
            for i, j in R.blocks([len(r) for r in raw]):
                cols = one(np.frombuffer(b"".join(raw[i:j]), np.uint8), np.cumsum([0, *(len(r) for r in raw[i:j])]), dk[i:j], tag[i:j])
                if cols:
                    yield pa.RecordBatch.from_arrays(cols, names=columns)

    def long_text(raw, dk, tag):
        """Pieces number their places from far apart, so that pairs of ranks never join places of two pieces."""
        for s, u in R.pieces(np.frombuffer(raw, np.uint8), window):
            cols = one(u, np.array([0, len(u)]), dk, tag)
            if cols and not keys_only:
                cols[4] = pa.array(cols[4].to_numpy() + s * 2)
                cols[8] = pa.array(cols[8].to_numpy() + (np.int64(s) << 32))
            if cols:
                yield pa.RecordBatch.from_arrays(cols, names=columns)

    return run


class _Bytes:
    def __init__(self, text: str):
        self.raw = _bytes(text)

    def cut(self, low: int, high: int) -> bytes:
        return self.raw[low:high]


def _window_names(window: int, names: tuple[R.Names, R.Names]):
    def run(text: str, starts: np.ndarray):
        raw = np.frombuffer(_bytes(text), np.uint8)
        return tuple(_names_at(n, raw, starts, window) for n in names)

    return run


def _names_at(names: R.Names, raw: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """Names of windows at sorted starts; a long text is summed piece by piece."""
    out = np.empty(len(starts), R.U)
    for s, piece in R.pieces(raw, window):
        a, b = np.searchsorted(starts, [s, s + R.PIECE])
        if b > a:
            out[a:b] = names.of(names.sums(piece), starts[a:b] - s, starts[a:b] - s + window)
    return out


def doubled_repeats(window: int, gram: int, names: R.Names):
    """Ranks the windows of a block's contexts by doubling; tells which share their rank at the window's depth."""

    def run(ctxs: list[bytes], wins: np.ndarray, group: np.ndarray) -> np.ndarray:
        total = names.sums(np.frombuffer(b"".join(ctxs), np.uint8))
        size = wins + window - 1
        first = np.cumsum(size) - size
        row = np.repeat(np.arange(len(wins)), wins)
        place = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(wins) - wins, wins)
        active, rank, depth = np.arange(len(row)), group[row].astype(np.int64), 0
        while depth < window and len(active):
            reach = min(max(depth, gram), window - depth)
            second = names.of(total, place[active] + depth, place[active] + depth + reach)
            order = np.lexsort((second, rank))
            r, s = rank[order], second[order]
            new = np.concatenate([[True], (r[1:] != r[:-1]) | (s[1:] != s[:-1])])
            now = np.cumsum(new) - 1
            kept = np.bincount(now)[now] > 1
            active, rank = active[order[kept]], now[kept]
            depth += reach
        out = np.zeros(len(row), bool)
        out[active] = True
        return out

    return run


LEVEL = ("dk", "tag", "nth", "start", "stop", "next", "reach")


def _ranked(scratch: Scratch, pairs: DataFrame, by: list[str]) -> DataFrame:
    """Spark sorts by the pair: each place gets the first place of its class as rank (ra, rb); places alone in their class are done.

    pairs must be a table of its own: so a join with a hot class can be split.
    """
    classes = scratch.put(pairs.groupBy(*by).agg(F.count("*").alias("n"), F.min(F.struct("dk", "tag", "nth")).alias("head")).where("n > 1").drop("n"), "classes")
    head = (F.col("dk") == F.col("head.dk")) & (F.col("tag") == F.col("head.tag")) & (F.col("nth") == F.col("head.nth"))
    out = pairs.join(classes, by).select(*LEVEL, F.col("head.dk").alias("ra"), F.shiftleft("head.nth", 14).bitwiseOR(F.col("head.tag")).alias("rb"), head.alias("is_head"))
    out = scratch.put(out, "ranks")
    scratch.drop(classes)
    return out


def ranked_spans(scratch: Scratch, live: DataFrame, window: int) -> DataFrame:
    """(dk, tag, start, stop, is_head): what prefix doubling over stretches finds repeated, of a window's size or more.

    A place's first half is what it shares with its class; the second half is what the place where that ends (`next`) shares with its own.
    """
    start = R.place_of(F.col("packed"))
    first = live.select("dk", R.tag_of(F.col("packed")).alias("tag"), "nth", start.alias("start"), (start + F.col("size")).alias("stop"), (F.col("nth") + F.col("hop")).alias("next"), "reach", "name", "name2", "size")
    levels = [_ranked(scratch, first, ["name", "name2", "size"])]
    known = levels[0]
    while True:
        active = levels[-1].where(F.col("stop") - F.col("start") < F.col("reach"))
        # The longest rank of each place. A place that a round has not reached keeps its last one: as a second half it names the same text wherever it stands.
        ahead = known.groupBy("dk", "tag", F.col("nth").alias("next")).agg(F.max_by(F.struct(F.col("ra").alias("na"), F.col("rb").alias("nb"), F.col("start").alias("next_start"), F.col("stop").alias("next_stop"), F.col("next").alias("after")), "stop").alias("a"))
        # A first half that took a shorter rank may end before the second begins; what lies between was never compared.
        pairs = active.drop("is_head").join(ahead, ["dk", "tag", "next"]).select("*", "a.*").where("next_start <= stop").withColumn("gap", F.col("next_start") - F.col("start"))
        # A place may head classes of several rounds; what these have in common differs in size.
        pairs = pairs.select("dk", "tag", "nth", "start", F.col("next_stop").alias("stop"), F.col("after").alias("next"), "reach", F.col("ra").alias("pa"), F.col("rb").alias("pb"), "na", "nb", "gap", (F.col("next_stop") - F.col("start")).alias("size"))
        pairs = scratch.put(pairs, "pairs")
        level = _ranked(scratch, pairs, ["pa", "pb", "na", "nb", "gap", "size"])
        scratch.drop(pairs)
        if level.isEmpty():
            break
        levels.append(level)
        known = known.unionByName(level)
    spans = scratch.put(known.where(F.col("stop") - F.col("start") >= window).select("dk", "tag", "start", "stop", "is_head"), "spans")
    scratch.drop(level, *levels)
    return spans


SHIPPED = "dk long, tag int, key long, low long, high long"


def _uncovered(window: int):
    """Of rows sorted by document: the serving places whose windows no span of another head covers."""

    def run(batches):
        held = []

        def decide(t):
            dk, tag = t["dk"].to_numpy(), t["tag"].to_numpy()
            cut = np.flatnonzero(np.concatenate([[True], (dk[1:] != dk[:-1]) | (tag[1:] != tag[:-1]), [True]]))
            key, start, stop, span = (t[c].to_numpy() for c in ("key", "start", "stop", "span"))
            keep = []
            for a, b in zip(cut, cut[1:], strict=False):
                is_span = span[a:b] == 1
                at = a + np.flatnonzero(~is_span)
                if is_span.any() and len(at):
                    s, e = start[a:b][is_span], stop[a:b][is_span]
                    order = np.argsort(s, kind="stable")
                    s, far = s[order], np.maximum.accumulate(e[order])
                    i = np.searchsorted(s, start[at], side="right") - 1
                    at = at[(i < 0) | (far[np.maximum(i, 0)] < stop[at])]
                keep.append(at)
            k = np.concatenate(keep) if keep else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(dk[k]), pa.array(tag[k]), pa.array(key[k]), pa.array(start[k]), pa.array(stop[k] - window)], names=["dk", "tag", "key", "low", "high"])

        n = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n += b.num_rows
            if n > 50_000:
                t = pa.Table.from_batches(held).combine_chunks()
                dk = t["dk"].to_numpy()
                done = int(np.flatnonzero(dk != dk[-1])[-1]) + 1 if (dk != dk[-1]).any() else 0
                if done:
                    yield from decide(t.slice(0, done))
                held = t.slice(done).to_batches()
                n = len(dk) - done
        if held:
            yield from decide(pa.Table.from_batches(held).combine_chunks())

    return run


def one_of_each(scratch: Scratch, docs: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """One row of each (dk, tag), and ranges (dk, tag, start, stop) over the whole texts that several rows share, if of a window's size.

    Ranks are joined on (dk, tag): m rows of one text would become m^2 in the first round, m^4 in the next. Shorter texts hold no place.
    """
    size = F.octet_length("text").cast("long")
    again = docs.where(size >= window).groupBy("dk", "tag").agg(F.count("*").alias("n"), F.max(size).alias("stop")).where("n > 1")
    again = scratch.put(again.select("dk", "tag", F.lit(0).cast("long").alias("start"), "stop"), "again")
    if not again.isEmpty():
        own = again.select("dk", "tag")
        docs = docs.join(own, ["dk", "tag"], "left_anti").unionByName(docs.join(own, ["dk", "tag"], "left_semi").dropDuplicates(["dk", "tag"]))
    return docs, again


def repeated_ranges(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(dk, tag, start, stop): ranges of bytes under windows that occur elsewhere; docs as keyed() gives them."""
    batches_by_bytes(docs.sparkSession)
    scratch, names, other = Scratch(docs.sparkSession, "suffix-array"), R.Names(), R.Names()
    docs, again = one_of_each(scratch, docs, window)
    rows = docs.select("dk", "tag", "text")
    census = rows.mapInArrow(scan(window, gram, (names, other), True), "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    census = scratch.put(census, "census")  # a table of its own, so that the join with it can be split where a key is hot
    live = scratch.put(rows.mapInArrow(scan(window, gram, (names, other), False), STRETCHES).join(census, "key", "left_semi"), "stretches")
    scratch.drop(census)
    spans = ranked_spans(scratch, live, window)
    packed = F.col("packed")
    serving = live.where("serves").select("dk", R.tag_of(packed).alias("tag"), "key", R.low_of(packed).alias("start"), (R.high_of(packed) + window).alias("stop"), F.lit(0).alias("span"))
    others = spans.where("not is_head").select("dk", "tag", F.lit(0).cast("long").alias("key"), "start", "stop", F.lit(1).alias("span"))
    both = serving.unionByName(others).repartition(partitions_of(docs), "dk", "tag").sortWithinPartitions("dk", "tag")
    left = scratch.put(both.mapInArrow(_uncovered(window), SHIPPED), "uncovered")
    scratch.drop(live)
    many = scratch.put(left.groupBy("key").agg(F.count("*").alias("different")).where("different > 1"), "crowds")
    picks = left.join(many, "key").select("dk", "tag", F.struct("key", "low", "high", (F.col("different") > R.CROWD).alias("crowded")).alias("pick"))
    picks = picks.groupBy("dk", "tag").agg(F.collect_list("pick").alias("picks"))
    chosen = docs.join(picks, ["dk", "tag"]).select("dk", "tag", "text", "picks")
    sent = chosen.mapInArrow(R.Sender(window, _Bytes, _window_names(window, (names, other))), R.SENT)
    sent = sent.repartition(partitions_of(docs), "key").sortWithinPartitions("key")
    found = sent.mapInArrow(R.Receiver(window, doubled_repeats(window, gram, names)), R.RANGES)
    ranges = scratch.put(spans.select("dk", "tag", "start", "stop").unionByName(found).unionByName(again), "ranges")
    scratch.drop(spans, left, many)
    return ranges


def _assembled(batches):
    for b in batches:
        n, gone, spans, sha = [], [], [], []
        for text, ranges in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            raw = _bytes(text)
            n.append(len(raw))
            if ranges:
                drop = R.covered([(r["start"], r["stop"]) for r in ranges], len(raw))
                gone.append(int(drop.sum()))
                spans.append(int(drop[0]) + int((drop[1:] & ~drop[:-1]).sum()))
                raw = np.frombuffer(raw, np.uint8)[~drop].tobytes()
            else:
                gone.append(0)
                spans.append(0)
            sha.append(hashlib.sha256(raw).hexdigest())
        cols = [pa.array(x, pa.int64()) for x in (n, gone, spans)]
        yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def deduplicated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), a row per row of docs.

    A byte goes if a string of `window` bytes that covers it starts anywhere else too, in the same document included; strings are judged on
    the input and never cross documents. Null counts as empty; shorter texts lose nothing; rows that repeat id and text are documents
    that repeat each other. Only id and text of docs are looked at. An empty table gives no rows.
    """
    rows = R.keyed(docs)
    return R.with_ranges(rows, repeated_ranges(rows, window, gram)).mapInArrow(_assembled, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def repeat_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, start_byte, end_byte): each maximal removed run."""
    rows = R.keyed(docs)

    def run(batches):
        for b in batches:
            out = []
            for doc, text, ranges in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                at = np.flatnonzero(R.covered([(r["start"], r["stop"]) for r in ranges or ()], len(_bytes(text))))
                if len(at):
                    out += [(doc, int(s), int(e) + 1) for s, e in zip(*R.runs_of(at), strict=True)]
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start_byte", "end_byte"])

    return R.with_ranges(rows, repeated_ranges(rows, window, gram)).mapInArrow(run, "doc_id long, start_byte long, end_byte long")


def op2_substring_suffix_array(spark, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))
