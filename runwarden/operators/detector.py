"""Anomalous traces of calls: windows of calls, a forest for each image, a threshold for windows and one for traces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from . import forest
from .graph import written

SIZE, STRIDE, PERCENTILE = 15, 3, 99.5
#: Traces of an image that are left out in one unit of work, about.
HELD = 8


def call_windows(calls: DataFrame, kinds: list[str], size: int = SIZE, stride: int = STRIDE) -> DataFrame:
    """(digest, trace, id, x) of calls (digest, trace, seq, t_ns, kind): each `size` calls in order, every `stride` calls; a shorter trace is one window.

    x has the share of each kind, then mean, deviation and greatest of the times between calls (0 for one call); id is the first call's seq.
    """
    trace = Window.partitionBy("digest", "trace")
    order = trace.orderBy("t_ns", "seq")
    wait = F.greatest(F.lit(0), F.col("t_ns") - F.lag("t_ns").over(order)).alias("wait")
    rows = calls.select("digest", "trace", "seq", "kind", (F.row_number().over(order) - 1).alias("at"), F.count("*").over(trace).alias("n"), wait)
    first = F.greatest(F.lit(0), F.ceil((F.col("at") - size + 1) / stride)).cast("int")
    last = F.least(F.floor(F.col("at") / stride), F.floor(F.greatest(F.lit(0), F.col("n") - size) / stride)).cast("int")
    rows = rows.select("*", F.explode(F.when(first <= last, F.sequence(first, last))).alias("nth"))
    inner = F.when(F.col("at") > F.col("nth") * stride, F.col("wait").cast("double"))
    times = [F.coalesce(f(inner), F.lit(0.0)) for f in (F.avg, F.stddev_pop, F.max)]
    x = F.array(*(F.count_if(F.col("kind") == k) / F.count("*") for k in kinds), *times)
    return rows.groupBy("digest", "trace", "nth").agg(F.min_by("seq", "at").cast("long").alias("id"), x.alias("x")).drop("nth")


def nearest_rank(scores: DataFrame, percentile: float = PERCENTILE) -> DataFrame:
    """(digest, theta): the score of nearest rank, of each digest."""
    w = Window.partitionBy("digest")
    rows = scores.select("digest", "score", (F.row_number().over(w.orderBy("score")) - 1).alias("at"), (F.count("*").over(w) - 1).alias("most"))
    return rows.where(F.col("at") == F.least("most", F.bround(percentile / 100 * F.col("most")))).select("digest", F.col("score").alias("theta"))


def share_above(scores: DataFrame, theta: DataFrame, *by: str) -> DataFrame:
    """(digest, *by, windows, above, fraction) of scored windows."""
    rows = scores.join(theta, "digest").groupBy("digest", *by).agg(F.count("*").alias("windows"), F.count_if(F.col("score") > F.col("theta")).alias("above"))
    return rows.withColumn("fraction", F.col("above") / F.col("windows"))


def dealt(base: DataFrame, tested: DataFrame | None = None, trees: int = forest.TREES, sample: int = forest.SAMPLE, held: int = HELD, part_rows: int = forest.PART_ROWS) -> DataFrame:
    """Windows (digest, trace, id, x) dealt to units (digest, part, block): a part of about part_rows windows of an image is scored by its forest (block 0) and
    by those that leave out one of about `held` traces. Every unit grows its forests itself, from the windows `drawn`, which are the same in all parts: all of an
    image in one part, else those that a tree can draw. `own` windows are scored there. An image of few windows and traces is one unit, and each window is sent once.

    Images with fewer than two baseline windows are left out.
    """
    each = base.groupBy("digest", "trace").agg(F.count("*").alias("own_n"), F.min("id").alias("first"))
    image = Window.partitionBy("digest")
    most = image.orderBy(F.desc("own_n"), "trace").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # The fewest windows that a forest with this trace is grown from.
    other = F.when(F.row_number().over(image.orderBy(F.desc("own_n"), "trace")) == 1, F.coalesce(F.nth_value("own_n", 2).over(most), F.lit(0))).otherwise(F.first("own_n").over(most))
    each = each.select("*", F.count("*").over(image).alias("traces"), F.sum("own_n").over(image).alias("n"), other.alias("other")).where("n >= 2")
    if tested is None:
        tested = base.limit(0)
    each = each.join(tested.groupBy("digest").agg(F.count("*").alias("tests")), "digest", "left")
    each = each.select(
        "digest", "trace", "first", F.greatest(F.lit(1), F.ceil(F.greatest("n", F.coalesce("tests", F.lit(0))) / part_rows)).cast("int").alias("parts"), F.ceil(F.col("traces") / held).cast("int").alias("blocks"),
        ((sample + 6 * sample**0.5 + 18) / F.greatest(F.lit(1), F.col("n") - F.col("other"))).alias("share"),
    )
    each = written(each, "traces")

    @F.pandas_udf("boolean")
    def low(ids: pd.Series, share: pd.Series) -> pd.Series:
        out = np.ones(len(ids), bool)
        i = np.flatnonzero(share.to_numpy() < 1)
        out[i] = (forest.unit(draws(ids.to_numpy()[i], trees)) < share.to_numpy()[i, None]).any(axis=1)
        return pd.Series(out)

    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    base = base.join(each, ["digest", "trace"])
    few = base.where("parts = 1").withColumn("drawn", F.lit(True)).withColumn("part", F.lit(0))
    many = base.where("parts > 1").withColumn("drawn", low("id", "share") | (F.col("id") == F.col("first"))).withColumn("part", F.explode(F.when(F.col("drawn"), upto("parts")).otherwise(F.array(own))))
    base = few.unionByName(many).withColumn("held_in", F.pmod(F.xxhash64("trace"), F.col("blocks")).cast("int")).withColumn("block", F.explode(upto("blocks")))
    base = base.select("digest", "part", "block", "trace", "id", "x", F.lit(True).alias("base"), "drawn", (F.col("part") == own).alias("own"), "held_in")
    tested = tested.join(each.groupBy("digest").agg(F.max("parts").alias("parts")), "digest")
    tested = tested.select("digest", own.alias("part"), F.lit(0).alias("block"), "trace", "id", "x", F.lit(False).alias("base"), F.lit(False).alias("drawn"), F.lit(True).alias("own"), F.lit(-1).alias("held_in"))
    unit = ["digest", "part", "block"]
    return forest.spread(base.unionByName(tested), *unit).sortWithinPartitions(*unit, "base", "id")


def draws(ids: np.ndarray, trees: int) -> np.ndarray:
    """(ids, trees): the windows of the least numbers are a tree's sample."""
    return forest.mixed(forest.mixed(1, ids)[:, None], np.arange(trees)[None, :])


def units(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames sorted by (digest, part, block), one for each unit."""
    open_, key = [], None
    for pdf in frames:
        names = list(zip(pdf["digest"], pdf["part"], pdf["block"], strict=True))
        cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if key != names[a] and open_:
                yield pd.concat(open_)
                open_ = []
            key = names[a]
            open_.append(pdf.iloc[a:b])
    if open_:
        yield pd.concat(open_)


SCORES = "digest string, held string, role string, trace string, score double"


def scored(rows: DataFrame, trees: int = forest.TREES, sample: int = forest.SAMPLE) -> DataFrame:
    """SCORES of dealt rows: by the image's forest (held is null, role is base or tested), and by forests of the image's other traces (role is other or held);
    an image with one trace only is judged by its own."""
    depth = forest.deepest(sample)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        xs, drawn, sizes, walks, grown = [], [], [], [], 0

        def done() -> pd.DataFrame:
            side = forest.grow(np.concatenate(xs, axis=1), np.concatenate(drawn), np.concatenate(sizes), np.tile(np.arange(trees), len(walks)), depth)
            xt = np.concatenate(xs, axis=1)
            of = np.repeat(np.arange(len(walks)), [len(w[0]) for w in walks])
            row, most = np.concatenate([w[0] for w in walks]), np.array([w[1] for w in walks])
            tree = lambda r: (of[r][:, None] * trees + np.arange(trees)).ravel()
            s = [forest.anomaly(side.path_lengths(tree(r), xt, np.repeat(row[r], trees)).reshape(-1, trees), most[of[r]], sample) for r in forest.slices(len(row), trees)]
            each = [np.concatenate([w[i] for w in walks]) for i in (4, 5)]
            return pd.DataFrame({"digest": np.array([w[2] for w in walks], object)[of], "held": np.array([w[3] for w in walks], object)[of], "role": each[0], "trace": each[1], "score": np.concatenate(s)})

        for pdf in units(frames):
            x = np.ascontiguousarray(np.stack(pdf["x"].to_numpy()).astype(np.float64).T)
            base, own, can = (pdf[c].to_numpy(bool) for c in ("base", "own", "drawn"))
            digest, block, trace = pdf["digest"].iloc[0], pdf["block"].iloc[0], pdf["trace"].to_numpy()
            names, code = np.unique(trace[base].astype(str), return_inverse=True)
            codes = np.full(len(pdf), -1)
            codes[base] = code
            left_out = np.unique(codes[base & (pdf["held_in"].to_numpy() == block)])
            order = draws(pdf["id"].to_numpy(), trees) if can.sum() > sample else None
            first = sum(a.shape[1] for a in xs)
            xs.append(x)
            for c in [None, *left_out] if block == 0 else left_out:
                alone = len(names) == 1
                of = np.flatnonzero(can & (codes != c)) if c is not None and not alone else np.flatnonzero(can)
                if len(of) < 2:
                    continue
                if len(of) <= sample:
                    rows = np.tile(of, trees)
                else:
                    some = [np.argpartition(order[of, k : k + 10], sample - 1, axis=0)[:sample] for k in range(0, trees, 10)]
                    rows = of[np.concatenate(some, axis=1)].T.ravel()
                n = min(len(of), sample)
                if c is None:
                    to = np.flatnonzero(own)
                    role = np.where(base[to], "base", "tested").astype(object)
                else:
                    to = np.flatnonzero(own & base)
                    role = np.where(codes[to] == c, "held", "other").astype(object)
                    if alone:
                        to, role = np.r_[to, to], np.r_[role, np.full(len(to), "other")]
                drawn.append(rows + first)
                sizes.append(np.full(trees, n))
                walks.append((to + first, n, digest, None if c is None else names[c], role, trace[to]))
                grown += len(rows)
            if grown >= forest.ITEMS:
                yield done()
                xs, drawn, sizes, walks, grown = [], [], [], [], 0
            elif not walks:
                xs = []
        if walks:
            yield done()

    return rows.mapInPandas(work, SCORES)


def left_out_thresholds(scores: DataFrame, percentile: float = PERCENTILE) -> DataFrame:
    """(digest, most): the greatest share of anomalous windows of a baseline trace, judged by a forest of the image's other traces."""
    keyed = scores.where("held is not null").select(F.to_json(F.array("digest", "held")).alias("digest"), F.col("digest").alias("image"), "role", "score")
    shares = share_above(keyed.where("role = 'held'"), nearest_rank(keyed.where("role = 'other'"), percentile), "image")
    return shares.groupBy(F.col("image").alias("digest")).agg(F.max("fraction").alias("most"))


def trace_thresholds(base: DataFrame, trees: int = forest.TREES, percentile: float = PERCENTILE) -> DataFrame:
    """(digest, most): the greatest share of anomalous windows of a baseline trace, judged by a forest of the image's other traces."""
    return left_out_thresholds(written(scored(dealt(written(base, "baseline"), None, trees), trees), "scores"), percentile)


def judge(base: DataFrame, tested: DataFrame, trees: int = forest.TREES, percentile: float = PERCENTILE) -> DataFrame:
    """(digest, trace, windows, above, fraction, anomalous) of tested traces: anomalous if the share of their windows above the image's threshold is
    above that of every baseline trace. base and tested are (digest, trace, id, x); images with fewer than two baseline windows judge nothing."""
    scores = written(scored(dealt(written(base, "baseline"), written(tested, "tested"), trees), trees), "scores")
    theta = nearest_rank(scores.where("role = 'base'"), percentile)
    out = share_above(scores.where("role = 'tested'"), theta, "trace").join(left_out_thresholds(scores, percentile), "digest", "left")
    return out.select("digest", "trace", "windows", "above", "fraction", ((F.col("above") > 0) & (F.col("fraction") > F.coalesce("most", F.lit(0.0)))).alias("anomalous"))
