"""Cross-tokenizer alignment with inverted pair bitmaps.

Every text is encoded by a byte-level BPE (A) and by a sentencepiece model (B) over the same bytes. The ends of both tokens cut the bytes into pieces; each piece lies in
one token of A and one of B, and two tokens overlap in one piece only, so pieces are the links. Where both end at once a group of tokens ends.

Documents are numbered within blocks. For each block and each pair of token ids that is linked in it there is a compressed bitmap of the block's documents: a list of
document numbers where they are few, a plain bitmap where they are many; how often a document has the pair is kept in planes of bits beside the set bits, plane k for bit k of the number of links less one. Bitmaps
of a block's pairs are filed in PARTS parts by the pair. Their set bits are counted and added up by pair, which gives every pair's number of documents, and
each A id's greatest. Then the postings return scores: each part of a block meets its part of the pair table, once, and gives each document of the block the sums of its pairs, which are added up by block.

Blocks hold BLOCK documents or LINKS links at most, so that nothing that grows with the corpus is in one task: a frequent pair is one bit for a document. The pair table
is bounded by the vocabularies; each of its parts is copied to the tasks that share the part's blocks.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import partitions_of, staged, table, texts

#: Documents, and links, of a block; parts of the pair table.
BLOCK, LINKS, PARTS = 2048, 3_000_000, 64
#: Characters that are encoded at once.
BATCH_CHARS = 400_000
#: Bits of a B id in a pair of ids.
SHIFT = 20


def byte_of_char() -> dict[str, int]:
    """The public byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes for the characters from 256 on in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers, with the bytes and the written form of every token. One a worker."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        chars = byte_of_char()
        size = max(self.a.get_vocab(with_added_tokens=True).values()) + 1
        self.a_bytes = [b""] * size
        for entry, i in self.a.get_vocab(with_added_tokens=True).items():
            self.a_bytes[i] = bytes(chars[c] for c in entry) if all(c in chars for c in entry) else entry.encode()
        self.a_fast = _plain_ranks(a_path, self.a_bytes)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.a_size, self.b_size = np.array(list(map(len, self.a_bytes))), np.array(list(map(len, self.b_bytes)))
        # A's tokens followed by "," and by "|", then B's followed by "," and by ";".
        self.written = [f"{i}{s}".encode() for n, signs in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for s in signs for i in range(n)]

    def encode(self, items: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """The ids of both for each text; None where there are no tokens: empty texts, and those whose bytes a tokenizer changes."""
        full = [i for i, t in enumerate(items) if t]
        out: list = [None] * len(items)
        if self.a_fast:
            a = [self.a_fast.encode_ordinary(" " + items[i]) for i in full]
        else:
            a = [e.ids for e in self.a.encode_batch_fast([" " + items[i] for i in full], add_special_tokens=False)]
        b = self.b.encode([items[i] for i in full], num_threads=1)
        for i, x, y in zip(full, a, b, strict=True):
            want = b" " + items[i].encode()
            if b"".join(map(self.a_bytes.__getitem__, x)) == want and b"".join(map(self.b_bytes.__getitem__, y)) == want:
                out[i] = (x, y)
        return out


#: The public pattern of byte-level pre-tokenizers.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _plain_ranks(path: str, entries: list[bytes]):
    """The tokenizer as a table of ranks, which the tiktoken library reads several times as fast. None unless it is a plain byte-level BPE whose merges
    are in the order of the ids of what they make, so that both libraries give the same ids."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    model, pre = d["model"], d.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and not d.get("normalizer") and not model.get("dropout") and not model.get("ignore_merges") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
    if not plain or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if made != sorted(made) or len(set(made)) != len(made) or len(made) + 256 + len(d.get("added_tokens", [])) < len(entries):
        return None
    added = {t["id"] for t in d.get("added_tokens", [])}
    return tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks={e: i for i, e in enumerate(entries) if i not in added and e}, special_tokens={})


def aligned(pair: Pair, found: list[tuple[list[int], list[int]]]):
    """Of documents with tokens: (n_a, n_b, n_groups, groups_sha256) of each, and (document, A id, B id) of every link, as arrays."""
    n_a, n_b = (np.array([len(x[k]) for x in found], np.int64) for k in (0, 1))
    a = np.fromiter((i for x in found for i in x[0]), np.int64, int(n_a.sum()))
    b = np.fromiter((i for x in found for i in x[1]), np.int64, int(n_b.sum()))
    end_a, end_b = np.cumsum(pair.a_size[a]), np.cumsum(pair.b_size[b])
    ends = np.zeros(int(end_a[-1]) + 1, np.uint8)
    ends[end_a] = 1
    ends[end_b] |= 2
    cuts = np.flatnonzero(ends)
    kind = ends[cuts].astype(np.int64)
    # A piece that ends at a cut lies in the tokens that end there or next.
    of_a = np.cumsum(kind & 1) - (kind & 1)
    of_b = np.cumsum(kind >> 1) - (kind >> 1)
    doc = np.repeat(np.arange(len(found)), n_a)[of_a]
    both = np.flatnonzero(kind == 3)
    till_a, till_b = of_a[both] + 1, of_b[both] + 1  # tokens up to and with each group
    in_a, in_b = np.diff(till_a, prepend=0), np.diff(till_b, prepend=0)
    code = np.empty(len(a) + len(b), np.int64)
    last = np.zeros(len(a), np.int64)
    last[till_a - 1] = len(pair.a_bytes)
    code[np.arange(len(a)) + np.repeat(till_b - in_b, in_a)] = a + last
    last = np.zeros(len(b), np.int64)
    last[till_b - 1] = len(pair.b_bytes)
    code[np.arange(len(b)) + np.repeat(till_a, in_b)] = b + last + 2 * len(pair.a_bytes)
    n_groups = np.bincount(doc[both], minlength=len(found))
    shas, at = [], 0
    for n in (n_a + n_b).tolist():
        shas.append(hashlib.sha256(b"".join(map(pair.written.__getitem__, code[at : at + n].tolist()))[:-1]).hexdigest())
        at += n
    return n_a, n_b, n_groups, shas, doc, a[of_a], b[of_b]


# A part's bitmaps, one after another: sizes, pairs, documents of each pair, lists, bitmaps, planes.


def pack(pairs: np.ndarray, slots: np.ndarray, times: np.ndarray, docs: int) -> bytes:
    """The compressed bitmaps of postings (pair, document of the block, links), sorted by pair and document."""
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
    count = np.diff(np.append(first, len(pairs)))
    dense = count * 16 > docs
    of = np.repeat(np.arange(len(first)), count)
    in_dense = dense[of]
    maps = np.zeros((int(dense.sum()), docs), bool)
    row = np.cumsum(dense) - 1
    maps[row[of[in_dense]], slots[in_dense]] = True
    planes, left = [], times - 1
    while left.any():
        planes.append(np.packbits((left & 1).astype(bool)))
        left = left >> 1
    head = np.array([docs, len(first), len(pairs), len(planes)], np.int64)
    parts = [head, pairs[first].astype(np.int64), count.astype(np.int32), slots[~in_dense].astype(np.uint16), np.packbits(maps, axis=1), *planes]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(p.tobytes() for p in parts))


def unpack(data: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(documents, distinct pairs, place of each posting's pair, document, links) of packed bitmaps."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    docs, n, total, planes = np.frombuffer(raw, np.int64, 4).tolist()
    at = 32
    pairs = np.frombuffer(raw, np.int64, n, at)
    at += 8 * n
    count = np.frombuffer(raw, np.int32, n, at).astype(np.int64)
    at += 4 * n
    dense = count * 16 > docs
    sparse_total, wide = int(count[~dense].sum()), (docs + 7) // 8
    lists = np.frombuffer(raw, np.uint16, sparse_total, at)
    at += 2 * sparse_total
    maps = np.frombuffer(raw, np.uint8, int(dense.sum()) * wide, at).reshape(-1, wide)
    at += maps.size
    of = np.repeat(np.arange(n), count)
    in_dense = dense[of]
    slots = np.empty(total, np.int64)
    slots[~in_dense] = lists
    slots[in_dense] = np.nonzero(np.unpackbits(maps, axis=1, count=docs))[1]
    times = np.ones(total, np.int64)
    for k in range(planes):
        size = (total + 7) // 8
        times += np.unpackbits(np.frombuffer(raw, np.uint8, size, at), count=total).astype(np.int64) << k
        at += size
    return docs, pairs, of, slots, times


FILED = "block long, part int, slot int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, bitmaps binary"


def _part(pairs: np.ndarray) -> np.ndarray:
    return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % PARTS


def filed(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """For each document a row (block, slot, doc_id, counts, groups), and for each block a row (block, part, bitmaps) for each part that it has pairs of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _worker_pair(a_path, b_path)
        task, serial = TaskContext.get().partitionId(), 0
        schema = pa.schema([pa.field(n, {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[k]) for n, k in (c.split() for c in FILED.split(", "))])
        rows, postings, links = [], [], 0

        def close():
            nonlocal rows, postings, links, serial
            block = (task << 32) | serial
            out = [(block, None, s, *r, None) for s, r in enumerate(rows)]
            if postings:
                key, times = (np.concatenate(x) for x in zip(*postings, strict=True))
                pairs, slots = key >> 16, key & 0xFFFF
                part = _part(pairs)
                order = np.lexsort((slots, pairs, part))
                pairs, slots, times, part = pairs[order], slots[order], times[order], part[order]
                edges = np.searchsorted(part, np.arange(PARTS + 1))
                for p in range(PARTS):
                    a, b = edges[p], edges[p + 1]
                    if a < b:
                        out.append((block, p, *(None,) * 7, pack(pairs[a:b], slots[a:b], times[a:b], len(rows))))
            rows, postings, links, serial = [], [], 0, serial + 1
            for i in range(0, len(out), 1024):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[i : i + 1024], strict=True), schema, strict=True)], schema=schema)

        for b in batches:
            ids, column, at = b.column(0).to_pylist(), b.column(1), 0
            while at < len(ids):
                # So many documents as have about BATCH_CHARS together, and fit the block.
                items = [column[at].as_py()]
                size = len(items[0])
                while at + len(items) < len(ids) and len(rows) + len(items) < BLOCK and size < BATCH_CHARS:
                    items.append(column[at + len(items)].as_py())
                    size += len(items[-1])
                found = pair.encode(items)
                have = [i for i, x in enumerate(found) if x is not None]
                own = [(i, 0, 0, 0, 0, "") for i in ids[at : at + len(items)]]
                if have:
                    n_a, n_b, n_groups, shas, doc, a, bb = aligned(pair, [found[i] for i in have])
                    n_links = np.bincount(doc, minlength=len(have))
                    for k, i in enumerate(have):
                        own[i] = (own[i][0], int(n_a[k]), int(n_b[k]), int(n_groups[k]), int(n_links[k]), shas[k])
                    slot = (np.array(have) + len(rows))[doc]
                    postings.append(np.unique((((a << SHIFT) | bb) << 16) | slot, return_counts=True))
                    links += len(doc)
                rows += own
                at += len(items)
                if len(rows) >= BLOCK or links >= LINKS:
                    yield from close()
        if rows:
            yield from close()

    return docs.mapInArrow(run, FILED)


_built: dict[tuple[str, str], Pair] = {}


def _worker_pair(a_path: str, b_path: str) -> Pair:
    if (a_path, b_path) not in _built:
        _built[a_path, b_path] = Pair(a_path, b_path)
    return _built[a_path, b_path]


def pair_counts(filed_: DataFrame) -> DataFrame:
    """(pair, part, documents, links) of each pair of ids, pair = (A id << SHIFT) | B id: set bits of its bitmaps, and links by its planes."""

    def run(batches):
        for b in batches:
            for p, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                _, pairs, of, _, times = unpack(data.as_py())
                n = len(pairs)
                links = np.bincount(of, weights=times, minlength=n).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(np.full(n, p, np.int32)), pa.array(np.bincount(of, minlength=n)), pa.array(links)], names=["pair", "part", "documents", "links"])

    rows = filed_.where("part is not null").select("part", "bitmaps").mapInArrow(run, "pair long, part int, documents long, links long")
    return rows.groupBy("pair", "part").agg(F.sum("documents").alias("documents"), F.sum("links").alias("links"))


def returned(filed_: DataFrame, counts: DataFrame) -> DataFrame:
    """(block, sums): of each document of a block, by its number, n_best and count_sum as longs one after the other, from some of its pairs."""
    top = counts.groupBy(F.shiftright("pair", SHIFT).alias("a")).agg(F.max("documents").alias("most"))
    best = counts.join(top, F.shiftright(counts["pair"], SHIFT) == top["a"]).select("part", F.struct("pair", "documents", (F.col("documents") == F.col("most")).alias("best")).alias("p"))
    shares = max(1, -(-2 * partitions_of(filed_) // PARTS))
    pairs = best.groupBy("part").agg(F.collect_list("p").alias("p"))  # a part is bounded by the vocabularies
    pairs = pairs.select("part", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.lit(None).cast("long").alias("block"), F.lit(None).cast("binary").alias("bitmaps"), "p")
    maps = filed_.where("part is not null").select("part", F.pmod(F.xxhash64("block"), F.lit(shares)).cast("int").alias("share"), "block", "bitmaps", F.lit(None).cast(pairs.schema["p"].dataType).alias("p"))
    rows = pairs.unionByName(maps)
    rows = rows.repartition(partitions_of(rows), "part", "share").sortWithinPartitions("part", "share", F.col("block").asc_nulls_first())

    def run(batches):
        known = count = best_ = None
        held: dict[int, np.ndarray] = {}
        for b in (x.slice(i, 1) for x in batches for i in range(x.num_rows)):
            block = b.column("block")[0].as_py()
            if block is None:
                known, count, best_ = (x.to_numpy(zero_copy_only=False) for x in b.column("p").flatten().flatten())
                order = np.argsort(known)
                known, count, best_ = known[order], count[order], best_[order]
                continue
            docs, pairs_, of, slots, times = unpack(b.column("bitmaps")[0].as_py())
            place = np.searchsorted(known, pairs_)
            out = np.stack([np.bincount(slots, weights=w[place][of] * times, minlength=docs) for w in (best_, count)]).astype(np.int64)
            held[block] = held[block] + out if block in held else out
            if len(held) >= 256:
                yield _sums(held)
        if held:
            yield _sums(held)

    return rows.select("block", "bitmaps", "p").mapInArrow(run, "block long, sums binary")


def _sums(held: dict[int, np.ndarray]) -> pa.RecordBatch:
    out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([zstandard.compress(x.tobytes(), 1) for x in held.values()], pa.binary())], names=["block", "sums"])
    held.clear()
    return out


OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per row of docs.

    A reads a blank and the text, B the text alone. Null and empty texts, and texts whose bytes a tokenizer changes, have zeros and an empty groups_sha256. Rows that repeat
    an id are documents of their own. An empty table gives no rows. Other columns are not looked at. A very long text is encoded whole, and is a block with what came before it.
    """
    # What is filed must not change when a lost task runs again, so it is a written table.
    files = staged(filed(texts(docs, id_col, text_col), a_path, b_path), "bitmaps")
    counts = staged(pair_counts(files), "pair-counts")
    sums = returned(files, counts).withColumn("slot", F.lit(-1))
    own = files.where("part is null").select("block", "slot", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    rows = sums.unionByName(own, allowMissingColumns=True)
    rows = rows.repartition(partitions_of(rows), "block").sortWithinPartitions("block", "slot")

    def run(batches):
        block, total = None, None
        for b in batches:
            blocks, slots, sums_ = b.column(0).to_numpy(), b.column(2).to_numpy(), b.column(1)
            n_best, count_sum = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            edges = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), b.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo == hi:
                    continue
                if blocks[lo] != block:
                    block, total = blocks[lo], None
                first = lo + int(np.searchsorted(slots[lo:hi], 0))
                for k in range(lo, first):
                    got = np.frombuffer(zstandard.decompress(sums_[k].as_py()), np.int64).reshape(2, -1)
                    total = got if total is None else total + got
                if total is not None:
                    n_best[first:hi], count_sum[first:hi] = total[:, slots[first:hi]]
            own = b.filter(pa.array(slots >= 0))
            cols = {n: own.column(n) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")} | {"n_best": pa.array(n_best[slots >= 0]), "count_sum": pa.array(count_sum[slots >= 0])}
            names = [c.split()[0] for c in OUT.split(", ")]
            yield pa.RecordBatch.from_arrays([cols[n] for n in names], names=names)

    return rows.select("block", "sums", "slot", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").mapInArrow(run, OUT)


def op11_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
