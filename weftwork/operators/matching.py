"""Descriptor matching and assignment. Points have set (or tile), idx and a vector column."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def euclidean(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d))


#: Points of a block and of a shard, whose distances one task holds together.
BLOCK, SHARD = 512, 4096


def _dealt(points: DataFrame, by: str, size: int, name: str) -> DataFrame:
    """Points with a part of their key's, of about a size."""
    parts = points.groupBy(by).agg(F.ceil(F.count("*") / size).alias("parts"))
    return points.join(parts, by).withColumn(name, F.pmod(F.xxhash64("idx"), F.col("parts"))).drop("parts")


def nearest(a: DataFrame, b: DataFrame, by: str, k: int = 2) -> DataFrame:
    """(by, a, b, distance, rank): the k nearest of b for each of a with the same key, ties to the smaller index.

    Both sides are dealt to blocks and shards; a task compares one block with one shard and gives k rows for each
    point, so pairs are never rows and a key may hold any number of points. Distances are of the differences.
    """
    kind = dict(a.dtypes)[by]

    def run(key: tuple, p: pa.Table, q: pa.Table) -> pa.Table:
        x, y = (np.array(t.column("vector").to_pylist(), float).reshape(t.num_rows, -1) for t in (p, q))
        ids, others = p.column("idx").to_numpy(), q.column("idx").to_numpy()
        if not len(x) or not len(y):
            return pa.table([[]] * 4, schema=pa.schema([(by, p.schema.field(by).type), ("a", pa.int64()), ("b", pa.int64()), ("distance", pa.float64())]))
        rough = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * x @ y.T
        m = min(k, len(y))
        limit = np.partition(rough, m - 1, axis=1)[:, m - 1] + 1e-9 * (1 + np.abs(rough).max())
        rows, cols = np.nonzero(rough <= limit[:, None])
        exact = np.sqrt(((x[rows] - y[cols]) ** 2).sum(axis=1))
        order = np.lexsort((others[cols], exact, rows))
        rows, cols, exact = rows[order], cols[order], exact[order]
        best = np.arange(len(rows)) - np.searchsorted(rows, rows) < m
        keys = pa.array([key[0].as_py()] * int(best.sum()), p.schema.field(by).type)
        return pa.table({by: keys, "a": pa.array(ids[rows[best]], pa.int64()), "b": pa.array(others[cols[best]], pa.int64()), "distance": exact[best]})

    left = _dealt(a.select(by, "idx", F.col("vector").cast("array<double>").alias("vector")), by, BLOCK, "block")
    right = _dealt(b.select(by, "idx", F.col("vector").cast("array<double>").alias("vector")), by, SHARD, "shard")
    left = left.join(right.select(by, "shard").distinct(), by)  # each block with each shard of its key
    blocks = a.groupBy(by).agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    right = right.join(blocks, by).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    right = right.select(*(F.col(c).alias(c if c in ("idx", "vector") else f"q_{c}") for c in (by, "shard", "block", "idx", "vector")))
    found = left.groupBy(by, "shard", "block").cogroup(right.groupBy(f"q_{by}", "q_shard", "q_block")).applyInArrow(run, f"`{by}` {kind}, a long, b long, distance double")
    order = W.partitionBy(by, "a").orderBy("distance", "b")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ratio_test(found: DataFrame, by: str, ratio: float = 0.92) -> DataFrame:
    """Best matches that are nearer than ratio times the second best."""
    best = found.groupBy(by, "a").agg(F.min_by("b", "rank").alias("b"), F.min("distance").alias("distance"), F.max(F.when(F.col("rank") == 2, F.col("distance"))).alias("second"))
    return best.where(F.col("second").isNull() | (F.col("distance") < ratio * F.col("second"))).select(by, "a", "b", "distance")


def cross_checked(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    """Pairs that are each other's nearest."""
    there = nearest(a, b, by, 1)
    back = nearest(b, a, by, 1).select(by, F.col("a").alias("b"), F.col("b").alias("a"))
    return there.join(back, [by, "a", "b"], "left_semi").select(by, "a", "b", "distance")


def nn_distance(points: DataFrame, by: str) -> DataFrame:
    """(by, nn): median distance to the nearest other distinct point, 1 with fewer than two."""
    distinct = points.groupBy(by, "vector").agg(F.min("idx").alias("idx"))
    least = nearest(distinct, distinct.select("*"), by, 2).where("a != b").groupBy(by, "a").agg(F.min("distance").alias("d"))
    return points.select(by).distinct().join(least.groupBy(by).agg(F.percentile("d", F.lit(0.5)).alias("nn")), by, "left").select(by, F.coalesce("nn", F.lit(1.0)).alias("nn"))


#: Distances that an assignment holds at a time.
CELLS = 1 << 18


def _distances(some: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Distances of the differences, part by part; what isn't a number is infinitely far."""
    square = np.zeros((len(some), len(others)))
    for a in range(some.shape[1]):
        part = np.subtract.outer(some[:, a], others[:, a])
        part *= part
        square += part
    np.sqrt(square, out=square)
    square[np.isnan(square)] = np.inf
    return square


def assignment(fixed: np.ndarray, moving: np.ndarray, threshold: float, ratio: float | None = None) -> list[tuple[int, int, float, bool]]:
    """(fixed, moving, distance, inlier), one-to-one, greedy by each fixed point's nearest distance.

    Distances are made twice, some rows at a time, and never held whole: once for the order, once along it.
    """
    if not len(fixed) or not len(moving):
        return []
    block = max(1, CELLS // len(moving))
    least = np.concatenate([_distances(fixed[k : k + block], moving).min(axis=1) for k in range(0, len(fixed), block)])
    order = np.lexsort((np.arange(len(fixed)), least))
    taken, out = np.zeros(len(moving), bool), []
    for k in range(0, len(order), block):
        rows = order[k : k + block]
        for i, free in zip(rows, _distances(fixed[rows], moving), strict=True):
            free[taken] = np.inf
            at = int(np.argmin(free))
            best = free[at]
            if not np.isfinite(best):
                continue
            free[at] = np.inf
            inlier = bool(best < threshold and (ratio is None or best < ratio * free.min()))
            taken[at] |= inlier
            out.append((int(i), at, float(best), inlier))
    return out


def match_assign(fixed: DataFrame, moving: DataFrame, by: str, threshold: float, ratio: float | None = None) -> DataFrame:
    """(by, a, b, distance, is_inlier) of :func:`assignment` for each key; a group is one pair's point sets."""

    def run(key: tuple, p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        p, q = p.sort_values("idx"), q.rename(columns={"q_idx": "idx", "q_vector": "vector"}).sort_values("idx")
        found = assignment(np.array(p.vector.tolist(), float), np.array(q.vector.tolist(), float), threshold, ratio) if len(p) and len(q) else []
        return pd.DataFrame([(key[0], p.idx.iloc[i], q.idx.iloc[j], d, ok) for i, j, d, ok in found], columns=[by, "a", "b", "distance", "is_inlier"])

    kind = dict(fixed.dtypes)[by]
    moving = moving.select(*(F.col(c).alias(f"q_{c}") for c in (by, "idx", "vector")))
    return fixed.select(by, "idx", "vector").groupBy(by).cogroup(moving.groupBy(f"q_{by}")).applyInPandas(run, f"`{by}` {kind}, a long, b long, distance double, is_inlier boolean")


def match_metrics(matches: DataFrame, sizes: DataFrame, by: str, threshold: float) -> DataFrame:
    """n_matches, match_rate (by the smaller set), distance and norm_distance; sizes has by, n1, n2."""
    found = matches.groupBy(by).agg(F.sum(F.col("is_inlier").cast("long")).alias("n_matches"), F.avg("distance").alias("distance"))
    return sizes.join(found, by, "left").select(by, F.coalesce("n_matches", F.lit(0)).alias("n_matches"), (F.coalesce("n_matches", F.lit(0)) / F.least("n1", "n2")).alias("match_rate"), F.coalesce("distance", F.lit(float("inf"))).alias("distance"), (F.coalesce("distance", F.lit(float("inf"))) / threshold).alias("norm_distance"))


def translation_ransac(matches: DataFrame, by: str, trials: int, threshold: float) -> DataFrame:
    """(by, dx, dy, inliers): the shift that most matches agree with, among those of ``trials`` matches by a seeded hash.

    ``matches`` has m (its number), dx and dy.
    """
    order = W.partitionBy(by).orderBy(F.pmod(F.col("m") * 7919 + 17, F.lit(104729)), "m")
    tried = matches.withColumn("n", F.row_number().over(order)).where(F.col("n") <= trials).select(by, F.col("m").alias("trial"), F.col("dx").alias("tx"), F.col("dy").alias("ty"))
    near = F.sqrt(F.pow(F.col("dx") - F.col("tx"), 2) + F.pow(F.col("dy") - F.col("ty"), 2)) <= threshold
    votes = tried.join(matches, by).groupBy(by, "trial", "tx", "ty").agg(F.sum(near.cast("long")).alias("inliers"))
    best = votes.groupBy(by).agg(F.max_by(F.struct("tx", "ty", "inliers"), F.struct("inliers", -F.col("trial"))).alias("t"))
    return best.select(by, F.col("t.tx").alias("dx"), F.col("t.ty").alias("dy"), F.col("t.inliers").alias("inliers"))
