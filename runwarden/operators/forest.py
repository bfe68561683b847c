"""Isolation forests per image: seeded samples drawn by hash; a task group grows its trees side by side, level by level in numpy, and scores by them all at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

TREES, SAMPLE = 100, 256
#: Trees that one task group grows, and rows of an image that one group scores.
BLOCK, PART_ROWS = 20, 20_000
#: Rows of trees that are grown side by side, and walks that are made side by side.
ITEMS = 60_000
EULER = 0.5772156649015329
NODES = "digest string, tree int, lefts array<int>, rights array<int>, features array<int>, thresholds array<double>, sizes array<int>"


def average_path(n):
    """c(n): the mean path length of a failed search among n; 0 for one, 1 for two."""
    n = np.asarray(n, float)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2 * (np.log(np.maximum(n - 1, 1)) + EULER) - 2 * (n - 1) / np.maximum(n, 1)))


def sampled(rows: DataFrame, trees: int = TREES, sample: int = SAMPLE, seed: int = 0) -> DataFrame:
    """rows (digest, id, x) repeated for each tree whose sample they are in: about 4/3 of the sample is drawn by hash, the first `sample` by hash
    stay. An image with no more rows than a sample gives all of them to each tree."""
    n = rows.groupBy("digest").agg(F.count("*").alias("n"))
    draw = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda i: (F.col("n") <= sample) | (F.pmod(F.xxhash64("id", i, F.lit(seed)), F.col("n")) < int(sample * 4 / 3)))
    out = rows.join(n, "digest").withColumn("tree", F.explode(draw))
    nth = F.row_number().over(Window.partitionBy("digest", "tree").orderBy(F.xxhash64("id", "tree", F.lit(seed + 1)), "id"))
    return out.withColumn("nth", nth).where(F.col("nth") <= sample).select("digest", "tree", "id", "x")


def mixed(z, *parts) -> np.ndarray:
    """64 bits of whole numbers (rounds of SplitMix64), each an array or one number."""
    z = np.atleast_1d(np.asarray(z)).astype(np.uint64)
    for p in parts:
        z = z + np.atleast_1d(np.asarray(p)).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return z


def unit(z: np.ndarray) -> np.ndarray:
    """At least 0 and below 1."""
    return (z >> np.uint64(11)) * 2.0**-53


class Trees:
    """Trees side by side: tree k has the nodes first[k] to first[k + 1]; children are counted from there, -1 at leaves; level is the depth of a node."""

    def __init__(self, first, lefts, rights, features, thresholds, sizes, level):
        self.first, self.lefts, self.rights, self.features, self.thresholds, self.sizes = first, lefts, rights, features, thresholds, sizes
        # Leaves lead to themselves, so that all walks take as many steps as the longest.
        here = np.arange(len(lefts))
        root = np.repeat(first[:-1], np.diff(first))
        self.next = np.stack([np.where(lefts < 0, here, root + lefts), np.where(lefts < 0, here, root + rights)], axis=1).ravel()
        self.asks = np.maximum(features, 0)
        self.length = level + average_path(sizes)

    @classmethod
    def of(cls, rows: list) -> Trees:
        """Of (lefts, rights, features, thresholds, sizes) of each tree."""
        first = np.r_[0, np.cumsum([len(r[0]) for r in rows])]
        lefts, rights, features, thresholds, sizes = (np.concatenate([np.asarray(r[i]) for r in rows]) for i in range(5))
        root, level, here, d = np.repeat(first[:-1], np.diff(first)), np.zeros(len(lefts), int), first[:-1], 0
        while len(here := here[lefts[here] >= 0]):
            here, d = np.concatenate([root[here] + lefts[here], root[here] + rights[here]]), d + 1
            level[here] = d
        return cls(first, lefts, rights, features, thresholds, sizes, level)

    def path_lengths(self, tree: np.ndarray, xt: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Of column row[i] of xt in tree[i]."""
        at = self.first[tree]
        while True:
            # What is not comparable goes right.
            step = self.next[2 * at + ~(xt[self.asks[at], row] <= self.thresholds[at])]
            if (step == at).all():
                return self.length[at]
            at = step


def grow(xt: np.ndarray, rows: np.ndarray, sizes: np.ndarray, tree: np.ndarray, depth: int, seed: int = 0) -> Trees:
    """Trees side by side, level by level: tree k has the next sizes[k] of `rows`, which are columns of xt. What a node draws depends on the seed, the number
    tree[k] and its place in the tree alone. A feature is tried first, all are looked at where its values are one; so each that varies is as likely."""
    width, n = xt.shape
    flat, drawn = xt.ravel(), mixed(seed, tree)
    count = np.ones(len(sizes), int)
    at, mine, place, size, levels = np.arange(len(sizes)), np.zeros(len(sizes), int), np.ones(len(sizes), int), np.asarray(sizes), []
    rows = rows[np.repeat(size, size) > 1]
    for level in range(depth + 1):
        left, feature, threshold = np.full(len(size), -1), np.full(len(size), -1), np.zeros(len(size))
        levels.append((at, mine, left, feature, threshold, size, np.full(len(size), level)))
        if level == depth or not len(rows):
            break
        # Nodes of two rows or more; rows has theirs.
        on = np.flatnonzero(size > 1)
        size = size[on]
        begin, s = np.cumsum(size) - size, np.repeat(np.arange(len(on)), size)
        draw = mixed(drawn[at[on]], place[on])
        f = (unit(draw) * width).astype(int)
        v = flat[(f * n)[s] + rows]
        low, high = np.minimum.reduceat(v, begin), np.maximum.reduceat(v, begin)
        one = ~(high > low)
        if one.any():
            i, k = np.flatnonzero(one), one[s]
            values, own = xt[:, rows[k]], np.cumsum(size[i]) - size[i]
            lows, highs = np.minimum.reduceat(values, own, axis=1), np.maximum.reduceat(values, own, axis=1)
            varied = np.cumsum(highs > lows, axis=0)
            f[i] = (varied > (unit(mixed(draw[i], 2)) * varied[-1]).astype(int)).argmax(axis=0)
            low[i], high[i] = lows[f[i], np.arange(len(i))], highs[f[i], np.arange(len(i))]
            v[k] = values[np.repeat(f[i], size[i]), np.arange(values.shape[1])]
        with np.errstate(over="ignore", invalid="ignore"):
            t = low + unit(mixed(draw, 1)) * (high - low)
        t = np.where(t < high, t, low)
        split = high > low
        if not split.all():
            keep = split[s]
            rows, v, on, f, t, size = rows[keep], v[keep], on[split], f[split], t[split], size[split]
            begin, s = np.cumsum(size) - size, np.repeat(np.arange(len(on)), size)
            if not len(on):
                break
        owner = at[on]
        nth = np.arange(len(on)) - np.maximum.accumulate(np.where(np.r_[True, owner[1:] != owner[:-1]], np.arange(len(on)), 0))
        child = count[owner] + 2 * nth
        left[on], feature[on], threshold[on] = child, f, t
        count += 2 * np.bincount(owner, minlength=len(count))
        # The rows of the left child before those of the right one; those of children of one row are done.
        go = v <= t[s]
        lefts = np.cumsum(go) - go
        before = lefts - lefts[begin][s]
        n_left = np.add.reduceat(go, begin, dtype=int)
        to = np.where(go, begin[s] + before, n_left[s] + np.arange(len(rows)) - before)
        moved = np.empty_like(rows)
        moved[to] = rows
        both = lambda a, b: np.stack([a, b], axis=1).ravel()
        at, mine, place, size = np.repeat(owner, 2), both(child, child + 1), both(2 * place[on], 2 * place[on] + 1), both(n_left, size - n_left)
        rows = moved[np.repeat(size, size) > 1]
    at, mine, left, feature, threshold, size, level = (np.concatenate(c) for c in zip(*levels, strict=True))
    first = np.r_[0, np.cumsum(count)]
    order = np.empty(len(at), int)
    order[first[at] + mine] = np.arange(len(at))
    left = left[order]
    return Trees(first, left, np.where(left < 0, -1, left + 1), feature[order], threshold[order], size[order], level[order])


def anomaly(lengths: np.ndarray, size: int, sample: int) -> np.ndarray:
    """Scores of path lengths (rows, trees); size is that of the greatest root."""
    return 2.0 ** (-lengths.sum(axis=1) / (lengths.shape[1] * np.maximum(average_path(np.minimum(size, sample)), 1e-9)))


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """rows in as many partitions as shuffles of the session have: their bytes are few and their work is much, so they are not to be coalesced."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def deepest(sample: int) -> int:
    return int(np.ceil(np.log2(max(sample, 2))))


def train(rows: DataFrame, trees: int = TREES, sample: int = SAMPLE, seed: int = 0) -> DataFrame:
    """A row per (digest, tree); the same seed gives the same forest."""
    depth = deepest(sample)

    def some(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tree", "id"])
        xt, (own, sizes) = np.stack(pdf["x"].to_numpy()).astype(np.float64).T, np.unique(pdf["tree"].to_numpy(), return_counts=True)
        grown = grow(np.ascontiguousarray(xt), np.arange(len(pdf)), sizes, own, depth, seed)
        cut = lambda a: np.split(a, grown.first[1:-1])
        return pd.DataFrame({"digest": key[0], "tree": own, "lefts": cut(grown.lefts), "rights": cut(grown.rights), "features": cut(grown.features), "thresholds": cut(grown.thresholds), "sizes": cut(grown.sizes)})

    drawn = sampled(rows, trees, sample, seed).withColumn("block", F.floor(F.col("tree") / BLOCK))
    return spread(drawn, "digest", "block").groupBy("digest", "block").applyInPandas(some, NODES)


def usable(forest: DataFrame, width: int) -> DataFrame:
    """(digest, ok): arrays of equal length, children inside the tree, features in range, one tree or more."""
    n = F.size("lefts")
    same = (F.size("rights") == n) & (F.size("features") == n) & (F.size("thresholds") == n) & (F.size("sizes") == n)
    inside = F.forall(F.concat("lefts", "rights"), lambda c: (c >= -1) & (c < F.size("lefts")))
    known = F.forall("features", lambda f: (f >= -1) & (f < width))
    return forest.groupBy("digest").agg((F.bool_and(same & inside & known) & (F.count("*") >= 1)).alias("ok"))


def slices(n: int, trees: int) -> list:
    """0, ..., n - 1 in pieces that walk through about ITEMS trees at once."""
    return np.array_split(np.arange(n), max(1, -(-n * trees // ITEMS)))


def score(rows: DataFrame, forest: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(digest, id, score): rows meet their image's trees by a join on digest, in (digest, part) groups of about PART_ROWS rows: forests of any number of
    images never come to the driver, and a large image is many groups. Rows of images without a forest have no score."""
    parts = rows.groupBy("digest").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))
    keyed = rows.join(parts, "digest").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    trees = forest.join(parts, "digest").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def both(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"digest": pd.Series([], dtype=object), "id": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})
        xt = np.ascontiguousarray(np.stack(left["x"].to_numpy()).astype(np.float64).T)
        right = right.sort_values("tree")
        forest = Trees.of(list(zip(*(right[c] for c in ("lefts", "rights", "features", "thresholds", "sizes")), strict=True)))
        size, n = max(int(r[0]) for r in right["sizes"]), len(right)
        s = [anomaly(forest.path_lengths(np.tile(np.arange(n), len(r)), xt, np.repeat(r, n)).reshape(-1, n), size, sample) for r in slices(len(left), n)]
        return pd.DataFrame({"digest": left["digest"].to_list(), "id": left["id"].to_numpy(), "score": np.concatenate(s)})

    return spread(keyed, "digest", "part").groupBy("digest", "part").cogroup(spread(trees, "digest", "part").groupBy("digest", "part")).applyInPandas(both, "digest string, id long, score double")

