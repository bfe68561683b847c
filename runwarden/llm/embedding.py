"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors with cosine c lie sqrt(2 - 2c) apart, so links are pairs within epsilon. Vectors are rotated to their principal
dimensions (two small sums over all vectors give the covariance; a rotation keeps distances), cut into grid cells of side epsilon
on the leading ones, and sorted by cell. The sorted sequence is cut into intervals. Two intervals can hold a link only if
they have cells that touch on the first two dimensions (an equi-join of cells with their neighbours) and if their bounding boxes over
the leading dimensions lie within epsilon. Interval pairs that are left are joined recursively: both are halved until small, provably
distant halves are skipped, and the last blocks are compared first on the leading dimensions, then exactly, on the given
components in double precision.

Equal vectors are one row (their number is carried along). Tasks give back numbers of links per vector and a spanning forest of the
links, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import partitions_of, staged, table
from .components import UnionFind, connected_components

COSINE = 0.9
#: Leading principal dimensions: those that cells are cut on, and those that boxes and first comparisons use.
CELL_DIMS, BOX_DIMS = 4, 16
#: Vectors in an interval of the sequence at least, parts of the sequence until intervals are that small, bytes of an interval at most, and vectors in a block of the recursion.
INTERVAL, PARTS, INTERVAL_BYTES, BLOCK = 2048, 6, 64_000_000, 256
#: Partitions that pairs of intervals are dealt to at most; where there are more pairs, a task joins several, one after another.
TASKS = 20_000
#: Slack of the distances that skip: rounding never hides a link.
SLACK = 1e-6


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v): vectors without null, NaN or infinite components and with a norm above zero."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


def _matrix(column, k: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, k)


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow of the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_axes(reps: DataFrame, k: int) -> np.ndarray:
    """The k x k rotation to principal dimensions of the unit vectors of reps, largest variance first."""

    def sums(batches):
        n, s, ss = 0, np.zeros(k), np.zeros((k, k))
        for b in batches:
            if b.num_rows:
                u = _units(_matrix(b.column(0), k))
                n, s, ss = n + len(u), s + u.sum(axis=0), ss + u.T @ u
        flat = np.concatenate([[n], s, ss.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], names=["i", "x"])

    rows = reps.select("v").mapInArrow(sums, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    flat = np.zeros(1 + k + k * k)
    for r in rows:
        flat[r.i] = r.x
    n = max(flat[0], 1.0)
    mean = flat[1 : k + 1] / n
    cov = flat[k + 1 :].reshape(k, k) / n - np.outer(mean, mean)
    _, axes = np.linalg.eigh((cov + cov.T) / 2)
    return np.ascontiguousarray(axes[:, ::-1])


def _ordered(axes: np.ndarray, eps: float, k: int):
    dims = min(CELL_DIMS, k)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            cells = np.floor(_units(_matrix(b.column(1), k)) @ axes[:, :dims] / eps).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(list(cells), pa.list_(pa.int32()))], names=["vec_id", "v", "copies", "cells"])

    return run


def _intervals(axes: np.ndarray, k: int):
    """Numbers the rows of a sorted partition, and adds their leading coordinates."""

    def run(batches):
        at, part = 0, TaskContext.get().partitionId()
        for b in batches:
            n = b.num_rows
            place = at + np.arange(n, dtype=np.int64)
            at += n
            lead = _units(_matrix(b.column(1), k)) @ axes[:, : min(BOX_DIMS, k)] if n else np.zeros((0, min(BOX_DIMS, k)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), b.column(3), pa.array(np.full(n, part), pa.int32()), pa.array(place), pa.array(list(lead), pa.list_(pa.float64()))],
                names=["vec_id", "v", "copies", "cells", "part", "place", "lead"],
            )

    return run


class _Side:
    def __init__(self, ids, copies, units, lead):
        self.ids, self.copies, self.units, self.lead = ids, copies, units, lead
        self.boxes: dict = {}

    def box(self, a, b):
        if (a, b) not in self.boxes:
            self.boxes[a, b] = self.lead[a:b].min(axis=0), self.lead[a:b].max(axis=0)
        return self.boxes[a, b]


def _join(left: _Side, right: _Side, same: bool, eps: float, cosine: float, found: UnionFind, counts: dict) -> None:
    far = (eps + SLACK) ** 2

    def recurse(a0, a1, b0, b1):
        if same and b1 <= a0 or a0 >= a1 or b0 >= b1:
            return
        (alo, ahi), (blo, bhi) = left.box(a0, a1), right.box(b0, b1)
        gap = np.maximum(0, np.maximum(alo - bhi, blo - ahi))
        if (gap * gap).sum() > far:
            return
        if a1 - a0 > BLOCK or b1 - b0 > BLOCK:
            am, bm = (a0 + a1) // 2, (b0 + b1) // 2
            for x0, x1 in ((a0, am), (am, a1)) if a1 - a0 > BLOCK else ((a0, a1),):
                for y0, y1 in ((b0, bm), (bm, b1)) if b1 - b0 > BLOCK else ((b0, b1),):
                    recurse(x0, x1, y0, y1)
            return
        la, lb = left.lead[a0:a1], right.lead[b0:b1]
        near = (la * la).sum(axis=1)[:, None] + (lb * lb).sum(axis=1)[None, :] - 2 * (la @ lb.T) <= far
        if not near.any():
            return
        i, j = np.nonzero(near)
        ok = np.einsum("ij,ij->i", left.units[a0 + i], right.units[b0 + j]) >= cosine
        i, j = a0 + i[ok], b0 + j[ok]
        if same:
            keep = i < j
            i, j = i[keep], j[keep]
        if not len(i):
            return
        for side, other, at, to in ((left, right, i, j), (right, left, j, i)):
            order = np.argsort(at, kind="stable")
            at, to = at[order], to[order]
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            for v, c in zip(side.ids[at[first]].tolist(), np.add.reduceat(other.copies[to], first).tolist(), strict=True):
                counts[v] = counts.get(v, 0) + c
        for x, y in zip(left.ids[i].tolist(), right.ids[j].tolist(), strict=True):
            found.union(x, y)

    recurse(0, len(left.ids), 0, len(right.ids))


def _compare(eps: float, cosine: float, k: int):
    """Rows come sorted by (p, q, side); gives (vec_id, other, n): links counted (other null) and forest edges (n null)."""

    def run(batches):
        found, counts = UnionFind(), {}
        now, rows = None, []

        def close():
            if not rows:
                return
            part = pa.Table.from_batches(rows).combine_chunks()
            pick = lambda s: part.filter(pc.equal(part["side"], s))
            p, q = now
            sides = []
            for s in (0,) if p == q else (0, 1):
                t = pick(s)
                if not t.num_rows:
                    return
                lead = np.asarray(t["lead"].combine_chunks().flatten()).reshape(t.num_rows, -1)
                sides.append(_Side(t["vec_id"].to_numpy(), t["copies"].to_numpy(), _units(_matrix(t["v"].combine_chunks(), k)), lead))
            _join(sides[0], sides[-1], p == q, eps, cosine, found, counts)

        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column("p").to_numpy(), b.column("q").to_numpy()], axis=1)
            cut = [0, *(np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1).tolist(), len(key)]
            for x, y in zip(cut, cut[1:], strict=False):
                if now != tuple(key[x]):
                    close()
                    now, rows = tuple(key[x]), []
                rows.append(b.slice(x, y - x))
        close()
        edges = found.stars()
        out = [(v, None, c) for v, c in counts.items()] + [(s, d, None) for s, d in edges]
        for i in range(0, len(out), 50_000):
            a, o, n = zip(*out[i : i + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(o, pa.int64()), pa.array(n, pa.int64())], names=["vec_id", "other", "n"])

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of vectors.

    Links are pairs with a cosine of `cosine` or more, in double precision. Vectors that are null, zero or hold null or
    non-finite components link with nothing, and are components of their own. Vectors of another length than the commonest
    are compared among themselves, as each length is joined for itself. Equal vectors link with each other. An empty table gives no rows.
    """
    eps = float(np.sqrt(2 - 2 * cosine))
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"))
    rows = staged(usable(vectors, id_col, vec_col), "vectors")
    reps = staged(rows.groupBy("v").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")), "distinct-vectors")
    parts = [_links(reps.where(F.size("v") == k), k, eps, cosine) for (k,) in sorted(tuple(r) for r in reps.select(F.size("v")).distinct().collect())]
    spark = vectors.sparkSession
    found = spark.createDataFrame([], "vec_id long, other long, n long")
    for p in parts:
        found = found.unionByName(p)
    found = staged(found, "links")
    counted = found.where("n is not null").groupBy("vec_id").agg(F.sum("n").alias("n"))
    comps = connected_components(found.where("other is not null").select(F.col("vec_id").alias("src"), F.col("other").alias("dst")))
    named = reps.join(counted, "vec_id", "left").join(comps.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    named = named.select("v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    linked = rows.join(staged(named, "named-vectors"), "v").select("vec_id", "n_links", "component_id")
    out = given.join(linked, "vec_id", "left")
    comp = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), (F.col("vec_id") == comp).alias("kept"))


def interval_size(count: int, k: int) -> int:
    """Vectors of k dimensions in an interval, of `count`. An interval goes to every interval that may be near, so a vector is sent about PARTS times as
    long as two intervals of that size fit into a task; beyond it intervals stay as large as fits."""
    return min(max(INTERVAL, -(-count // PARTS)), max(BLOCK, INTERVAL_BYTES // (8 * (2 * k + BOX_DIMS))))


def _links(reps: DataFrame, k: int, eps: float, cosine: float) -> DataFrame:
    axes = principal_axes(reps, k)
    n, count = partitions_of(reps), reps.count()
    size = interval_size(count, k)
    sorted_ = reps.select("vec_id", "v", "copies").mapInArrow(_ordered(axes, eps, k), "vec_id long, v array<double>, copies long, cells array<int>")
    sorted_ = staged(sorted_, "cells").repartitionByRange(max(1, min(n, 1 + count // INTERVAL)), "cells").sortWithinPartitions("cells")
    seq = staged(sorted_.mapInArrow(_intervals(axes, k), "vec_id long, v array<double>, copies long, cells array<int>, part int, place long, lead array<double>"), "sequence")
    # Intervals run on over the parts of the sorted sequence; one row per part says where it begins.
    parts = seq.groupBy("part").agg(F.count("*").alias("n"))
    begin = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = staged(parts.select("part", begin.alias("begin")), "parts")
    seq = seq.join(F.broadcast(begins), "part").withColumn("interval", F.floor((F.col("begin") + F.col("place")) / size))
    dims = min(BOX_DIMS, k)
    box = [f(F.col("lead")[i]).alias(f"{name}{i}") for i in range(dims) for f, name in ((F.min, "lo"), (F.max, "hi"))]
    boxes = staged(seq.groupBy("interval").agg(*box), "boxes")
    second = F.coalesce(F.try_element_at("cells", F.lit(2)), F.lit(0))
    cells = staged(seq.select("interval", F.col("cells")[0].alias("x"), second.alias("y")).distinct(), "interval-cells")
    around = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)).alias(c)
    near = cells.select("interval", around("x"), "y").select("interval", "x", around("y"))
    pairs = cells.select(F.col("interval").alias("p"), "x", "y").join(near.withColumnRenamed("interval", "q"), ["x", "y"]).where("p <= q").select("p", "q").distinct()
    left, right = (boxes.select(F.col("interval").alias(c), *(F.col(f"{e}{i}").alias(f"{c}_{e}{i}") for i in range(dims) for e in ("lo", "hi"))) for c in ("p", "q"))
    gaps = [F.greatest(F.lit(0.0), F.col(f"p_lo{i}") - F.col(f"q_hi{i}"), F.col(f"q_lo{i}") - F.col(f"p_hi{i}")) for i in range(dims)]
    apart = sum((g * g for g in gaps), F.lit(0.0))
    pairs = staged(pairs.join(left, "p").join(right, "q").where(apart <= (eps + SLACK) ** 2).select("p", "q"), "interval-pairs")
    sides = pairs.select("p", "q", F.col("p").alias("interval"), F.lit(0).alias("side")).unionByName(pairs.where("p <> q").select("p", "q", F.col("q").alias("interval"), F.lit(1).alias("side")))
    dealt = sides.join(seq.select("interval", "vec_id", "v", "copies", "lead"), "interval").select("p", "q", "side", "vec_id", "copies", "v", "lead")
    dealt = dealt.repartition(max(n, min(TASKS, pairs.count())), "p", "q").sortWithinPartitions("p", "q", "side")
    return dealt.mapInArrow(_compare(eps, cosine, k), "vec_id long, other long, n long")


def op4_embedding_ego(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
