"""Byte-level BPE by backtracking over longest matches, in time linear in a piece's length.

Bytes are mapped to Latin-1 characters, so that pyahocorasick finds, for each place of a piece, the longest token starting there.
A sequence of tokens is what the merges give exactly if each adjacent pair of it is what the merges give for the pair's
bytes alone. The encoder therefore takes the longest token whose pair with its predecessor holds, falls back to shorter
prefixes of it, and steps back when none is left; places found to be dead ends are marked, so each is left once. Whether a pair
holds is found by undoing merges across the seam, and memoised.

The vocabulary file is read by the driver once and broadcast: its size is fixed by the tokenizer, not by the data.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import freed, table, texts

#: Entries kept in a worker's memo of pieces and of pairs; a full memo is started anew.
MEMO = 400_000
#: Longer pieces are encoded but not memoised.
MEMO_PIECE = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file: a line has a token in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Tokenizer:
    """Encodes and decodes by a table of ranks; ids are the ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        size = max(ranks.values()) + 1
        self.token = [b""] * size
        for t, r in ranks.items():
            self.token[r] = t
        self.length = [len(t) for t in self.token]
        self.size = size
        self.pair_ok: dict[int, bool] = {}
        self.piece_ids: dict[str, tuple[int, ...]] = {}
        # The last merge that makes each token. Single bytes have none, nor have tokens that no merges make: those stand for
        # a whole piece only, and never inside one.
        self.parts: list[tuple[int, int] | None] = [None] * size
        self.merged: dict[int, int] = {}
        self.made = bytearray(size)
        for r in sorted(ranks.values()):
            if self.length[r] == 1:
                self.made[r] = 1
        for r in sorted(ranks.values()):
            if self.length[r] > 1 and (pair := self._last_merge(r)):
                self.parts[r] = pair
                self.made[r] = 1
                self.merged[pair[0] * size + pair[1]] = r
        self.automaton = ahocorasick.Automaton()
        for t, r in ranks.items():
            if self.made[r]:
                self.automaton.add_word(t[::-1].decode("latin-1"), r)
        self.automaton.make_automaton()
        self.shorter = [self._longest_prefix(t) for t in self.token]

    def _longest_prefix(self, token: bytes) -> int:
        """The longest token that merges make and that is a proper prefix, or -1."""
        for n in range(len(token) - 1, 0, -1):
            if (r := self.ranks.get(token[:n])) is not None and self.made[r]:
                return r
        return -1

    def _last_merge(self, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes `rank`: the seam that holds with merges of lower rank only."""
        token, ranks, made = self.token[rank], self.ranks, self.made
        for n in range(len(token) - 1, 0, -1):
            left, right = ranks.get(token[:n], rank), ranks.get(token[n:], rank)
            if left < rank and right < rank and made[left] and made[right] and self._holds(left, right, rank):
                return left, right
        return None

    def _holds(self, left: int, right: int, limit: int) -> bool:
        """Do merges below `limit` leave the seam between the two tokens alone?

        The merges are undone from the latest on, on the side whose last merge is the later; whenever the two tokens at the seam
        would merge earlier than what has been undone, the seam would not have stayed.
        """
        parts, merged, size = self.parts, self.merged, self.size
        while True:
            joined = merged.get(left * size + right)
            if joined is not None and joined < limit:
                return False
            if left > right:
                # A merge of equal rank on the left comes first, so the seam's own must come before it.
                limit = left
                if (p := parts[left]) is not None:
                    left = p[1]
                    continue
                limit = right + 1
                if (p := parts[right]) is None:
                    return True
                right = p[0]
            else:
                limit = right + 1
                if (p := parts[right]) is not None:
                    right = p[0]
                    continue
                limit = left
                if (p := parts[left]) is None:
                    return True
                left = p[1]

    def compatible(self, left: int, right: int) -> bool:
        key = left * self.size + right
        known = self.pair_ok.get(key)
        if known is None:
            if len(self.pair_ok) >= MEMO:
                self.pair_ok.clear()
            known = self.pair_ok[key] = self._holds(left, right, 1 << 60)
        return known

    def _longest_at(self, piece: bytes) -> list[int]:
        """For each place the longest token that starts there: the reversed piece is scanned for reversed tokens' ends."""
        n = len(piece)
        out = [-1] * n
        for end, r in self.automaton.iter(piece[::-1].decode("latin-1")):
            at = n - 1 - end
            if out[at] == -1 or self.length[r] > self.length[out[at]]:
                out[at] = r
        return out

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        longest, length, shorter, compatible = self._longest_at(piece), self.length, self.shorter, self.compatible
        alive = bytearray(b"\x01") * (len(piece) + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            while token != -1:
                end = at + length[token]
                if alive[end] and (not out or compatible(out[-1], token)):
                    break
                token = shorter[token]
            if token != -1:
                out.append(token)
                at = end
                if at == len(piece):
                    return out
                token = longest[at]
                continue
            if not out:
                raise ValueError("the vocabulary does not have every byte")
            alive[at] = 0
            last = out.pop()
            at -= length[last]
            token = shorter[last]

    def encode(self, text: str) -> list[int]:
        memo, out = self.piece_ids, []
        extend = out.extend
        for piece in self.split(text):
            ids = memo.get(piece)
            if ids is None:
                ids = tuple(self.encode_piece(piece.encode("utf-8", "surrogatepass")))
                if len(piece) <= MEMO_PIECE:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[piece] = ids
            extend(ids)
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


_built: dict[str, Tokenizer] = {}


def tokenizer(key: str, ranks: dict[bytes, int], pattern: str) -> Tokenizer:
    """One tokenizer a worker, whatever number of tasks it runs."""
    if key not in _built:
        _built[key] = Tokenizer(ranks, pattern)
    return _built[key]


def _shared(df: DataFrame, path: str, pattern: str):
    ranks = read_ranks(path)
    return df.sparkSession.sparkContext.broadcast((hashlib.sha256(f"{path}\n{pattern}\n{len(ranks)}".encode()).hexdigest(), ranks, pattern))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the whole text's ids, without special tokens. Null counts as empty, whose ids are an empty array."""
    shared = _shared(docs, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(*shared.value)
        for b in batches:
            ids = [t.encode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, bytes) of (doc_id, ids); null ids count as none."""
    shared = _shared(tokens, path, pattern)

    def run(batches):
        t = tokenizer(*shared.value)
        for b in batches:
            out = [t.decode(x or ()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes, then decodes the ids, in one pass; only digests leave a task.

    Ids are digested as little-endian unsigned 32-bit integers. Rows stay rows: repeated ids are repeated rows.
    """
    shared = _shared(docs, path, pattern)

    def run(batches):
        t = tokenizer(*shared.value)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for x in b.column(1).to_pylist():
                ids = t.encode(x)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(t.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


#: Rows whose ids are held at once.
ROWS = 100


def tokenized(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): the training rows, with the digest of what their ids decode to."""
    shared = _shared(docs, path, pattern)

    def run(batches):
        t = tokenizer(*shared.value)
        for b in (whole.slice(i, ROWS) for whole in freed(batches) for i in range(0, whole.num_rows, ROWS)):
            ids, shas = [], []
            for x in b.column(1).to_pylist():
                own = t.encode(x)
                shas.append(hashlib.sha256(t.decode(own)).hexdigest())
                ids.append(np.array(own, np.int32))
            cols = [pa.array(list(map(len, ids)), pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(shas, pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", "n_tokens", "ids", "decoded_sha256"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string")


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
