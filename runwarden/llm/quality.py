"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer numpy network with calibrated probabilities.

Words and runs of marks of a text fall into a fixed number of hashed buckets. Each bucket has a sparse random index vector, which
follows from its number; a word that repeats what stands before it counts as one word of its own; the vector of a word is the sum of the index vectors of the words around it, so words used
alike have like vectors. A document is the weighted mean of its words' vectors. The network is fitted on a bounded sample of
labelled rows (MAX_DOCS, MAX_BYTES, MAX_TEXT: lowest hashes of the ids first, texts over MAX_TEXT left out); a part of the sample is kept back to fit the temperature. The
model's size is fixed (buckets times dimensions), so it is broadcast; every document's whole text is scored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import freed, small_batches, table, texts

BUCKETS, DIMS, MARKS = 1 << 15, 48, 6
#: The bucket of words that repeat what stands before them.
AGAIN = BUCKETS - 1
REACH = 2
#: Bounds of the sample that the model is fitted on: rows, bytes together, bytes of one text. Every text is scored, whatever its size.
MAX_DOCS, MAX_BYTES, MAX_TEXT = 5000, 24_000_000, 1_000_000
#: Tokens whose vectors are looked up at once, however long a text is.
SLICE = 100_000
HIDDEN, EPOCHS, RATE, DECAY = 24, 40, 0.01, 3e-3
THRESHOLD = 0.7
SEED = 7

# Classes of bytes: 0 white space, 1 lower-case, 2 upper-case, 3 digit, 4 mark, 5 part of a character beyond ASCII (counts as a letter).
_CLASS = np.full(256, 4, np.uint8)
_CLASS[[32, 9, 10, 11, 12, 13]] = 0
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 5
_MIX = np.random.default_rng(SEED).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def repeated(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Tokens that say again what stands right before them in their document: the same token, or the end of a phrase of two to four again."""
    out = np.zeros(len(ids), bool)
    out[1:] = (ids[1:] == ids[:-1]) & (doc[1:] == doc[:-1])
    for k in range(2, 5):
        if len(ids) > k + 1:
            same = (ids[k:] == ids[:-k]) & (doc[k:] == doc[:-k])
            out[k + 1 :] |= same[1:] & same[:-1]
    return out


def document_ids(items: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of every token of the texts; repetitions share a bucket of their own, as one more word."""
    joined, offsets = join_texts(items)
    ids, at = bucket_ids(joined)
    doc = np.searchsorted(offsets, at, side="right") - 1
    return np.where(repeated(ids, doc), AGAIN, ids), doc


def bucket_ids(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, start) of every token: a run of letters, of digits or of marks. One pass of array operations over the bytes."""
    b = np.frombuffer(joined, np.uint8)
    if not len(b):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    kind = _CLASS[b]
    group = np.where((kind == 1) | (kind == 2) | (kind == 5), 1, kind)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    last = np.append(first[1:], len(b))
    word = group[first] != 0
    first, last = first[word], last[word]
    if not len(first):
        return np.empty(0, np.int64), first
    # Bytes weigh by their place in the token; long tokens are told apart by their first 24 bytes and their length.
    place = np.zeros(len(b), np.int64)
    place[first[0] :] = np.arange(first[0], len(b)) - np.repeat(first, np.diff(np.append(first, len(b))))
    value = _MIX[b] * (np.uint64(2) * np.minimum(place, 24).astype(np.uint64) + np.uint64(3)) ** np.uint64(3)
    value[group == 0] = 0
    h = np.add.reduceat(value, first) * _BASE
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - 15)).astype(np.int64), first


def index_vectors(buckets: int = BUCKETS, dims: int = DIMS, marks: int = MARKS) -> np.ndarray:
    """A few +1 and -1 at random places of each bucket's row; always the same."""
    rng = np.random.default_rng(SEED)
    out = np.zeros((buckets, dims), np.float32)
    for _ in range(marks):
        np.add.at(out, (np.arange(buckets), rng.integers(0, dims, buckets)), rng.choice(np.array([-1, 1], np.float32), buckets))
    return out


def join_texts(items: list[str]) -> tuple[bytes, np.ndarray]:
    """All texts one after another, a line feed after each, and where each begins (and the end)."""
    raw = [t.encode("utf-8", "surrogatepass") for t in items]
    return b"\n".join(raw) + b"\n" * bool(raw), np.cumsum([0, *(len(r) + 1 for r in raw)])


def blocks(items: list[str], limit: int = 1_000_000):
    """(from, to) of runs of texts of about a megabyte together."""
    start, held = 0, 0
    for i, t in enumerate(items):
        if held and held + len(t) > limit:
            yield start, i
            start, held = i, 0
        held += len(t) + 1
    if start < len(items):
        yield start, len(items)


@dataclass
class Model:
    words: np.ndarray  # a row per bucket, weight included
    weight: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def pooled(self, items: list[str]) -> np.ndarray:
        """A row per text: its words' mean vector, zero for empty texts."""
        out, total = np.zeros((len(items), self.words.shape[1])), np.zeros(len(items))
        for start, end in blocks(items):
            ids, doc = document_ids(items[start:end])
            for i in range(0, len(ids), SLICE):
                part, own = ids[i : i + SLICE], start + doc[i : i + SLICE]
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                out[own[first]] += np.add.reduceat(self.words[part], first, axis=0)
                total[own[first]] += np.add.reduceat(self.weight[part], first)
        return out / np.maximum(total, 1e-12)[:, None]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, items: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(self.pooled(items)) / self.temperature, -60, 60)))


def word_vectors(items: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Random indexing over the texts: unit vectors per bucket, and weights that fall with a word's frequency."""
    index, context, count = index_vectors(), np.zeros((BUCKETS, DIMS), np.float32), np.zeros(BUCKETS)
    for start, end in blocks(items):
        every, _ = document_ids(items[start:end])
        count += np.bincount(every, minlength=BUCKETS)
        for i in range(0, len(every), SLICE):
            near = every[max(0, i - REACH) : i + SLICE + REACH]
            around = np.zeros((len(near), DIMS), np.float32)
            for d in range(1, REACH + 1):
                around[d:] += index[near[:-d]]
                around[:-d] += index[near[d:]]
            skip = min(i, REACH)
            ids = near[skip : skip + SLICE]
            order = np.argsort(ids, kind="stable")
            s = ids[order]
            first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            context[s[first]] += np.add.reduceat(around[skip : skip + SLICE][order], first, axis=0)
    # Words that the sample has rarely lean on their own index vector.
    vectors = context + index * REACH
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-6)
    weight = 1e-3 / (1e-3 + count / max(1.0, count.sum()))
    return vectors, weight


def fit(items: list[str], labels: np.ndarray) -> Model:
    """Fits word vectors, network and temperature. Rows of one label alone teach nothing: every score is then 0.98 or 0.02 by that label, without rows 0.5."""
    labels = np.asarray(labels, float)
    vectors, weight = word_vectors(items)
    model = Model((vectors * weight[:, None]).astype(np.float32), weight, np.zeros(DIMS), np.ones(DIMS), np.zeros((DIMS, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0)
    if len(set(labels.tolist())) < 2:
        model.b2 = 0.0 if not len(labels) else (4.0 if labels[0] else -4.0)
        return model
    x = model.pooled(items)
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(x))
    held, used = order[: len(x) // 5], order[len(x) // 5 :]
    z = (x - model.mean) / model.scale
    params = [rng.normal(0, 1 / np.sqrt(DIMS), (DIMS, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(used), max(1, len(used) // 64)):
            h = np.tanh(z[rows] @ params[0] + params[1])
            d = (1 / (1 + np.exp(-(h @ params[2] + params[3]))) - labels[rows]) / len(rows)
            dh = np.outer(d, params[2]) * (1 - h * h)
            grads = [z[rows].T @ dh + DECAY * params[0], dh.sum(axis=0), h.T @ d + DECAY * params[2], d.sum(keepdims=True)]
            t += 1
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                params[i] -= RATE * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    model.w1, model.b1, model.w2, model.b2 = params[0], params[1], params[2], float(params[3][0])
    if len(set(labels[held].tolist())) == 2:
        logit, y = model.logits(x[held]), labels[held]
        loss = lambda s: np.mean(np.logaddexp(0, np.where(y > 0, -logit / s, logit / s)))
        model.temperature = float(min(np.geomspace(0.25, 8, 70), key=loss))
    return model


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str = "quality") -> tuple[list[str], np.ndarray]:
    """The bounded sample: labelled rows outside the held-out fold with texts of MAX_TEXT at most, lowest hashes first, up to MAX_DOCS rows and MAX_BYTES."""
    learnt = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    learnt = learnt.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    size = F.octet_length("text")
    pick = learnt.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_DOCS)
    rows = texts(docs).join(F.broadcast(pick), "doc_id").where(size <= MAX_TEXT)
    before = F.sum(size).over(Window.partitionBy(F.lit(0)).orderBy(F.xxhash64("doc_id"), "doc_id", "text"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(MAX_DOCS).withColumn("sofar", before).where(F.col("sofar") <= MAX_BYTES)
    got = rows.select("text", "y").toArrow()
    return got.column("text").to_pylist(), np.array(got.column("y").to_pylist(), float)


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def scored(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """docs' columns `keep` (all by default) and score: from the whole text alone. Null texts count as empty; rows stay rows."""
    keep = docs.columns if keep is None else keep
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # The text travels in a column of its own name, so that no column of docs can clash with it.
    rows = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(keep)), F.coalesce("text", F.lit("")).alias("text_"))

    def run(batches):
        m = shared.value
        for b in freed(batches):
            s = m.score(b.column(b.num_columns - 1).to_pylist()) if b.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s)], names=[*b.schema.names[:-1], "score"])

    schema = rows.drop("text_").withColumn("score", F.lit(0.0)).schema
    out = rows.mapInArrow(run, schema)
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)), "score")


def crc_fold(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 4


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(*training_rows(docs, table(spark, sf_dir, "labels")))
    out = scored(docs.select("doc_id", "text"), model, ["doc_id"])
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
