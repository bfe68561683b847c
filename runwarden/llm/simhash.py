"""SimHash near-duplicates by anchor points.

Every document has a 64-bit SimHash. Two fingerprints that differ in at most three bits differ in at most one bit of their
first or of their last 32. Over the low 31 bits of each half, the words of the Hamming(31, 26) code are the anchors: a perfect
covering code of radius one, so each half-fingerprint has exactly one anchor within one bit, its home. If two halves
differ in one bit at most, the second lies within two bits (covering radius plus threshold) of the first one's home.
Each fingerprint is therefore filed once at its home and replicated, per half, to the anchors within two bits
(16.5 on average, its home included), and homes are compared with what was replicated to them.

Only distinct fingerprints are compared, so exact copies are one row. A crowded anchor is cut into chunks of homes
and chunks of replicas, and each pair of chunks is a group of its own; a task compares block by block and gives back a spanning forest of the links it found,
never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import freed, partitions_of, staged, table, texts
from .components import UnionFind, connected_components

SEED, SHINGLE, THRESHOLD, BITS = 42, 3, 3, 31
#: Rows of an anchor that one chunk holds, about.
CHUNK_ROWS = 512.0
#: Comparisons made at once.
BLOCK_PAIRS = 1_000_000


def fingerprint_of(text: str, seed: int = SEED, shingle: int = SHINGLE) -> int:
    """The SimHash of one text, unsigned: A-Z lower-cased, a bit set if over half of the shingle hashes set it."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), seed)
    parts = zip(*(words[i:] for i in range(shingle)), strict=False)
    n = len(words) - shingle + 1
    hashes = np.fromiter((digest(p, seed) for p in map(b" ".join, parts)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 8192):
        ones += np.unpackbits(hashes[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(rows: DataFrame) -> DataFrame:
    """(doc_id, fp) of (doc_id, text): ids of any type; fp is the fingerprint's 64 bits as a signed long. The empty text's fingerprint is zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in freed(batches):
            values = np.array([fingerprint_of(t) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def _columns_of_check() -> np.ndarray:
    return np.uint64(1) << np.arange(BITS, dtype=np.uint64)


def _syndrome(v: np.ndarray) -> np.ndarray:
    """Of each 31-bit word: the xor of the (one-based) places of its set bits; zero for code words."""
    s = np.zeros(len(v), np.uint64)
    for i in range(BITS):
        s ^= np.where((v >> np.uint64(i)) & np.uint64(1), np.uint64(i + 1), np.uint64(0))
    return s


def anchors_near(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, is_home) of every code word within two bits of each 31-bit word.

    A code word at distance two flips places i < j with i xor j equal to the syndrome; at distance one it flips the
    syndrome's own place; at distance zero the syndrome is zero (then none is nearer than three bits).
    """
    s = _syndrome(v)
    rows = np.arange(len(v))
    bit = _columns_of_check()
    own = np.where(s > 0, v ^ bit[np.maximum(s, 1).astype(np.int64) - 1], v)
    out = [(rows, own, np.ones(len(v), bool))]
    for i in range(1, BITS + 1):
        j = s ^ np.uint64(i)
        ok = (s > 0) & (j > i) & (j <= BITS)
        if ok.any():
            out.append((rows[ok], v[ok] ^ bit[i - 1] ^ bit[j[ok].astype(np.int64) - 1], np.zeros(int(ok.sum()), bool)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _replicate(batches):
    for b in freed(batches):
        fp = b.column(0).to_numpy().view(np.uint64)
        for half in (0, 1):
            word = (fp >> np.uint64(32 * half)) & np.uint64((1 << BITS) - 1)
            row, anchor, home = anchors_near(word)
            key = (anchor | np.uint64(half << 40)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row].view(np.int64)), pa.array(home)], names=["anchor", "fp", "home"])


def _pairs(homes: np.ndarray, all_fps: np.ndarray, most: int):
    """Index pairs of homes and all_fps that differ in most bits or fewer, block by block."""
    step = max(1, BLOCK_PAIRS // max(1, len(all_fps)))
    for i in range(0, len(homes), step):
        a, b = np.nonzero(np.bitwise_count(homes[i : i + step, None] ^ all_fps[None, :]) <= most)
        yield a + i, b


def _compare(batches):
    """Rows come sorted by (anchor, i, j); links are joined in one union-find a task."""
    found = UnionFind()
    keys, fps, homes = [], [], []
    last = None

    def close(rows_fp, rows_home):
        own, others = rows_fp[rows_home], rows_fp[~rows_home]
        if len(own) and len(others):
            for a, b in _pairs(own, others, THRESHOLD):
                x, y = own[a].view(np.int64), others[b].view(np.int64)
                keep = x != y
                for p, q in zip(x[keep].tolist(), y[keep].tolist(), strict=True):
                    found.union(p, q)

    def flush(final):
        nonlocal keys, fps, homes, last
        if not keys:
            return
        k, f, h = np.concatenate(keys), np.concatenate(fps), np.concatenate(homes)
        cut = np.flatnonzero(np.any(k[1:] != k[:-1], axis=1)) + 1
        bounds = [0, *cut.tolist(), len(k)]
        until = len(bounds) - 1 if final else len(bounds) - 2
        for i in range(until):
            if bounds[i + 1] - bounds[i] > 1:
                close(f[bounds[i] : bounds[i + 1]], h[bounds[i] : bounds[i + 1]])
        rest = bounds[until]
        keys, fps, homes = ([x[rest:]] if rest < len(k) else [] for x in (k, f, h))

    for b in freed(batches):
        keys.append(np.stack([b.column(i).to_numpy().astype(np.int64) for i in range(3)], axis=1))
        fps.append(b.column(3).to_numpy().view(np.uint64))
        homes.append(b.column(4).to_numpy(zero_copy_only=False))
        if sum(map(len, fps)) > 100_000:
            flush(False)
    flush(True)
    if rows := found.stars():
        src, dst = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """A spanning forest (src, dst) of the links among distinct fingerprints (one column, fp)."""
    filed = staged(distinct.select("fp").mapInArrow(_replicate, "anchor long, fp long, home boolean"), "anchors")
    size = filed.groupBy("anchor").agg(F.count_if("home").alias("homes"), F.count("*").alias("rows")).where("homes > 0 and rows > 1")
    size = staged(size.select("anchor", F.ceil(F.col("rows") / F.lit(CHUNK_ROWS)).cast("int").alias("chunks")), "anchor-sizes")
    kept = filed.join(size, "anchor")
    mine, every = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    homes = kept.where("home").select("anchor", "fp", "home", mine.alias("i"), every.alias("j"))
    replicas = kept.select("anchor", "fp", F.lit(False).alias("home"), mine.alias("j"), every.alias("i"))
    rows = homes.unionByName(replicas).select("anchor", "i", "j", "fp", "home")
    rows = rows.repartition(partitions_of(rows), "anchor", "i", "j").sortWithinPartitions("anchor", "i", "j")
    return rows.mapInArrow(_compare, "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): documents whose fingerprints are joined by links of at most three differing bits.

    Null ids are dropped from links but stay as rows of their own fingerprint's component; an empty table gives no rows. Rows that repeat an id
    are rows of their own. Texts are read whole, one at a time.
    """
    return near_groups(texts(docs, id_col, text_col))


def near_groups(rows: DataFrame) -> DataFrame:
    """near_duplicates of (doc_id, text) with ids of any type that has an order; component_id is of that type too."""
    prints = staged(fingerprints(rows), "fingerprints")
    firsts = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    comps = connected_components(fingerprint_links(firsts)).withColumnRenamed("id", "fp").withColumnRenamed("component_id", "root")
    rooted = firsts.join(comps, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = staged(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "components")
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
