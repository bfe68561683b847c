"""Substring dedup by prefix-partitioned suffix trees, over words.

A suffix starts at each word and is read to the depth of a window (35 words). Suffixes are split by prefixes of variable length. The
short prefix is a gram of eight words: each suffix is filed with the lowest-named gram that begins in its window, so
equal suffixes meet, and the suffixes of a gram travel together as one stretch of text. A census of the grams drops those that occur once, whose subtrees
have no internal nodes. Where a gram has many suffixes the prefix is lengthened: first to the whole stretch (copies of a
stretch become one node, decided by counting; one of them goes on), then, for grams that still have many different
stretches, to the full window, each a node at full depth. So every group fits into memory.

A group's subtree is grown from the root in ranges of seven words: at each depth the suffixes that still share their path with another
are sorted by their next edge, and leaves that stand alone are dropped. Nodes that reach the window's depth are the deep internal nodes; the stretches below
them, joined where they overlap, are the maximal repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import repeats as R
from .common import Scratch, partitions_of, table

WINDOW, GRAM, RANGE = 35, 8, 7
#: Parts of a partition's share of the rows, from which on copies of one stretch are not shuffled.
HOT_SHARE = 4
ANCHORS = "key long, ctx long, dk long, packed long"


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def scan(window: int, gram: int, names: R.Names, keys_only: bool):
    """Anchors of every whole text: (key) alone, or with the name of the stretch that it serves, its document and its place.

    A stretch's name counts how many windows it has and where the anchor is, too.
    """

    def found(units, bounds):
        place, low, high, key = R.anchors(units, bounds, window, gram)
        if keys_only or not len(place):
            return place, low, high, key, None
        shape = (high - low).astype(R.U) << R.U(10) | (place - low).astype(R.U)
        ctx = R.reduced(R.product(names.of(names.sums(units), low, high + window), R.U(names.base)) + shape)
        return place, low, high, key, ctx

    def run(batches):
        for b in batches:
            raw = [_bytes(t) for t in b.column(2).to_pylist()]
            dk, tag = b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int64)
            for i, j in R.blocks([len(r) for r in raw]):
                joined = b"\n".join(raw[i:j]) + b"\n"
                units, start, _ = names.words(joined)
                edges = np.cumsum([0, *(len(r) + 1 for r in raw[i:j])])
                bounds = np.searchsorted(start, edges)
                parts = [(0, units, bounds)] if len(units) <= R.PIECE else [(bounds[d] + s, u, np.array([0, len(u)])) for d in range(j - i) for s, u in R.pieces(units[bounds[d] : bounds[d + 1]], window)]
                for shift, u, bound in parts:
                    place, low, high, key, ctx = found(u, bound)
                    if not len(place):
                        continue
                    if keys_only:
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], names=["key"])
                        continue
                    doc = np.searchsorted(bounds, place + shift, side="right") - 1
                    off = shift - bounds[doc]
                    p = R.packed(place + off, low + off, high + off, tag[i + doc])
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ctx.view(np.int64)), pa.array(dk[i + doc]), pa.array(p)], names=["key", "ctx", "dk", "packed"])

    return run


class _Words:
    def __init__(self, text: str):
        self.raw = _bytes(text)
        space = R._SPACE[np.frombuffer(self.raw, np.uint8)]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]

    def cut(self, low: int, high: int) -> bytes:
        return self.raw[self.start[low] : self.end[high - 1]]


def _window_names(window: int, names: tuple[R.Names, R.Names]):
    def run(text: str, starts: np.ndarray):
        raw = _bytes(text)
        return tuple(n.of(n.sums(n.words(raw)[0]), starts, starts + window) for n in names)

    return run


def subtree_repeats(window: int, names: R.Names, step: int = RANGE):
    """Grows subtrees, all groups of a block at once; tells which suffixes end below a node of the window's depth."""

    def run(ctxs: list[bytes], wins: np.ndarray, group: np.ndarray) -> np.ndarray:
        total = names.sums(names.words(b"\n".join(ctxs))[0])
        words = wins + window - 1
        first = np.cumsum(words) - words
        row = np.repeat(np.arange(len(wins)), wins)
        suffix = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(wins) - wins, wins)
        active, node, depth = np.arange(len(row)), group[row].astype(np.int64), 0
        while depth < window and len(active):
            reach = min(step, window - depth)
            edge = names.of(total, suffix[active] + depth, suffix[active] + depth + reach)
            order = np.lexsort((edge, node))
            n, e = node[order], edge[order]
            new = np.concatenate([[True], (n[1:] != n[:-1]) | (e[1:] != e[:-1])])
            child = np.cumsum(new) - 1
            kept = np.bincount(child)[child] > 1
            active, node = active[order[kept]], child[kept]
            depth += reach
        out = np.zeros(len(row), bool)
        out[active] = True
        return out

    return run


def repeated_ranges(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(dk, tag, start, stop): ranges of words under windows that occur elsewhere; docs as keyed() gives them."""
    rows, n = docs.select("dk", "tag", "text"), partitions_of(docs)
    scratch, names, other = Scratch(docs.sparkSession, "suffix-tree"), R.Names(), R.Names()
    census = rows.mapInArrow(scan(window, gram, names, True), "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    census = scratch.put(census, "census")  # a table of its own, so that the join with it can be split where a key is hot
    live = scratch.put(rows.mapInArrow(scan(window, gram, names, False), ANCHORS).join(census, "key", "left_semi"), "anchors")
    scratch.drop(census)
    stretches = scratch.put(live.groupBy("key", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("dk", "packed")).alias("head")), "stretches")
    many = scratch.put(stretches.groupBy("key").agg(F.count("*").alias("different")).where("different > 1"), "crowds")
    # Stretches with more than a quarter of a partition's share of the rows are four for each partition at most: small enough to be broadcast, and their rows stay where they are.
    hot = live.count() // (HOT_SHARE * n) + 1
    apart = F.broadcast(stretches.where(F.col("n") > hot).where("n > 1").select("key", "ctx"))
    copies = live.join(apart, ["key", "ctx"], "left_semi").unionByName(live.join(apart, ["key", "ctx"], "left_anti").join(stretches.where((F.col("n") > 1) & (F.col("n") <= hot)).select("key", "ctx"), ["key", "ctx"], "left_semi"))
    low, high, tag = R.low_of(F.col("packed")), R.high_of(F.col("packed")), R.tag_of(F.col("packed"))
    whole = copies.select("dk", tag.alias("tag"), low.alias("start"), (high + window).alias("stop"))
    heads = stretches.select("key", "head.dk", "head.packed").join(many, "key")
    picks = heads.select("dk", tag.alias("tag"), F.struct("key", low.alias("low"), high.alias("high"), (F.col("different") > R.CROWD).alias("crowded")).alias("pick"))
    picks = picks.groupBy("dk", "tag").agg(F.collect_list("pick").alias("picks"))
    chosen = docs.join(picks, ["dk", "tag"]).select("dk", "tag", "text", "picks")
    sent = chosen.mapInArrow(R.Sender(window, _Words, _window_names(window, (names, other))), R.SENT)
    sent = sent.repartition(n, "key").sortWithinPartitions("key")
    found = sent.mapInArrow(R.Receiver(window, subtree_repeats(window, names)), R.RANGES)
    ranges = scratch.put(whole.unionByName(found), "ranges")
    scratch.drop(live, stretches, many)
    return ranges


def _assembled(batches):
    for b in batches:
        n, gone, sha = [], [], []
        for text, ranges in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            words = _bytes(text).split()
            n.append(len(words))
            if ranges:
                drop = R.covered([(r["start"], r["stop"]) for r in ranges], len(words))
                gone.append(int(drop.sum()))
                words = [words[i] for i in np.flatnonzero(~drop)]
            else:
                gone.append(0)
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def deduplicated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), a row per row of docs.

    A word goes if a window that covers it starts anywhere else too, in the same document included; windows are judged on the input.
    Null and empty texts have no words; texts shorter than a window lose none; rows that repeat id and text are documents that repeat each
    other. Only id and text of docs are looked at. An empty table gives no rows.
    """
    rows = R.keyed(docs)
    return R.with_ranges(rows, repeated_ranges(rows, window, gram)).mapInArrow(_assembled, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def maximal_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, start_word, end_word, text): each maximal run of removed words as it stands, words joined by one space."""
    rows = R.keyed(docs)

    def run(batches):
        for b in batches:
            out = []
            for doc, text, ranges in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                words = _bytes(text).split()
                at = np.flatnonzero(R.covered([(r["start"], r["stop"]) for r in ranges or ()], len(words)))
                if len(at):
                    out += [(doc, int(s), int(e) + 1, b" ".join(words[s : e + 1]).decode("utf-8", "replace")) for s, e in zip(*R.runs_of(at), strict=True)]
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "start_word", "end_word", "text"])

    return R.with_ranges(rows, repeated_ranges(rows, window, gram)).mapInArrow(run, "doc_id long, start_word long, end_word long, text string")


def op1_substring_suffix_tree(spark, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))
