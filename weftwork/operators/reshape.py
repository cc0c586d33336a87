"""Pixels in long form over any of the axes t, c, z, y, x: axes added and dropped, projected, cropped, resized, retyped."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def redimensioned(pixels: DataFrame, old: str, new: str, **at: int) -> DataFrame:
    """Pixels over other axes: those that go are taken at a place (0 if not given), new ones are 0."""
    for axis in old:
        if axis not in new:
            pixels = pixels.where(F.col(axis) == at.get(axis, 0)).drop(axis)
    rest = [c for c in pixels.columns if c not in old]
    return pixels.select(*rest[:-1], *(F.col(a) if a in old else F.lit(0).alias(a) for a in new), rest[-1])


def sliced(pixels: DataFrame, **at: int) -> DataFrame:
    """Pixels at places of axes (``z=1``), or in ranges from one to before another (``y0=2, y1=6``), with the same places."""
    for axis in sorted({k.rstrip("01") for k in at}):
        if f"{axis}0" in at and f"{axis}1" in at:
            pixels = pixels.where((F.col(axis) >= at[f"{axis}0"]) & (F.col(axis) < at[f"{axis}1"]))
        elif axis in at:
            pixels = pixels.where(F.col(axis) == at[axis])
    return pixels


def squeezed(pixels: DataFrame) -> DataFrame:
    """Pixels of the first time, without t, and without c where there is only one channel."""
    if "t" in pixels.columns:
        pixels = pixels.where("t = 0").drop("t")
    return pixels.drop("c") if "c" in pixels.columns and pixels.select("c").distinct().limit(2).count() <= 1 else pixels


def max_projected(pixels: DataFrame, axis: str = "z") -> DataFrame:
    """The largest value along an axis; NULL counts for nothing."""
    return pixels.groupBy(*(c for c in pixels.columns if c not in (axis, "value"))).agg(F.max("value").alias("value"))


def channel(pixels: DataFrame, which: int | str | None = None, labels: list[str] | None = None) -> DataFrame:
    """The pixels of one channel, by place or label; without a choice there must be only one."""
    if which is None:
        if pixels.select("c").distinct().limit(2).count() > 1:
            raise ValueError("choose a channel: there are several")
        return pixels
    return pixels.where(F.col("c") == (which if isinstance(which, int) else (labels or []).index(which)))


def stacked(planes: list[DataFrame]) -> DataFrame:
    """Planes one above the other: the place in the list is z."""
    return reduce(DataFrame.unionByName, (p.drop("z").withColumn("z", F.lit(z)) for z, p in enumerate(planes)))


def colored(pixels: DataFrame) -> DataFrame:
    """Gray pixels as three equal channels c."""
    return pixels.drop("c").withColumn("c", F.explode(F.array(*(F.lit(c) for c in range(3)))))


def grayed(pixels: DataFrame) -> DataFrame:
    """Pixels of three or four channels c as their lightness; others as they are, without c."""
    by = [c for c in pixels.columns if c not in ("c", "value")]
    part = F.when(F.col("c") == 0, 0.299).when(F.col("c") == 1, 0.587).when(F.col("c") == 2, 0.114).otherwise(0.0)
    rows = pixels.groupBy(*by).agg(F.sum(F.col("value") * part).alias("light"), F.max_by("value", -F.col("c")).alias("first"), F.count("*").alias("n"))
    return rows.select(*by, F.when(F.col("n") > 1, F.col("light")).otherwise(F.col("first")).alias("value"))


def fitted(pixels: DataFrame, size: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """Planes (y, x) of one size with zeros added around them up to a target size, and then cut to it from the corner."""
    (h, w), (th, tw) = size, target
    keys = [c for c in pixels.columns if c not in ("y", "x", "value")]
    top, left = max(th - h, 0) // 2, max(tw - w, 0) // 2
    moved = pixels.withColumns({"y": (F.col("y") + top).cast("int"), "x": (F.col("x") + left).cast("int")}).where((F.col("y") < th) & (F.col("x") < tw))
    places = pixels.select(*keys).distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(th - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(tw - 1))))
    return places.join(moved, [*keys, "y", "x"], "left").withColumn("value", F.coalesce("value", F.lit(0.0))).select(*pixels.columns)


def resize_weights(n: int, target: int, how: str) -> list[tuple[int, int, float]]:
    """(place in the target, place in the source, weight) along one axis: by area, linear, or cubic with a border that repeats."""
    step, out = n / target, []
    for o in range(target):
        if how == "area":
            a, b = o * step, (o + 1) * step
            out += [(o, i, (min(i + 1, b) - max(i, a)) / step) for i in range(int(a), min(n, int(np.ceil(b)))) if min(i + 1, b) > max(i, a)]
            continue
        at = (o + 0.5) * step - 0.5
        low = int(np.floor(at))
        for i in range(low, low + 2) if how == "linear" else range(low - 1, low + 3):
            t = abs(at - i)
            if how == "linear":
                weight = 1 - t
            else:
                weight = 1.25 * t**3 - 2.25 * t**2 + 1 if t <= 1 else -0.75 * (t**3 - 5 * t**2 + 8 * t - 4)
            out.append((o, min(max(i, 0), n - 1), weight))
    return out


def resized(pixels: DataFrame, size: tuple[int, int], target: tuple[int, int], how: str | None = None) -> DataFrame:
    """Planes (y, x) of one size in another, by cubic interpolation where they grow and by area where they shrink.

    One join with a few weights for each row of the target and one for each column: rows first, then columns.
    """
    if how is None:
        how = "cubic" if np.mean([size[0] / target[0], size[1] / target[1]]) < 1 else "area"
    spark, keys = pixels.sparkSession, [c for c in pixels.columns if c not in ("y", "x", "value")]
    for axis, other, n, m in (("y", "x", size[0], target[0]), ("x", "y", size[1], target[1])):
        weights = F.broadcast(spark.createDataFrame(resize_weights(n, m, how), f"o int, {axis} int, w double"))  # a few rows for each of one side's places
        pixels = pixels.withColumn(axis, F.col(axis).cast("int")).join(weights, axis).groupBy(*keys, F.col("o").alias(axis), other).agg(F.sum(F.col("value") * F.col("w")).alias("value"))
    return pixels.select(*keys, "y", "x", "value")


def rescaled(pixels: DataFrame, size: tuple[int, int], width: int) -> DataFrame:
    """Planes of a width with the same aspect, by linear interpolation."""
    return resized(pixels, size, (width * size[0] // size[1], width), "linear")


def _most(dtype: str) -> float:
    return float((1 << int(dtype.lstrip("uint"))) - 1)


def to_float(value: Column, dtype: str) -> Column:
    """Integers as parts of their type's largest unsigned number; floats as they are."""
    return value if dtype.startswith("float") else value / _most(dtype)


def to_uint8(value: Column, dtype: str) -> Column:
    """Any type as 8 bits: floats from 0 to 1 times 255, wider integers without their lower bits."""
    if dtype.startswith("float"):
        return (value * 255).cast("int")
    bits = int(dtype.lstrip("uint"))
    return (F.floor(value / float(1 << (bits - 8))) if bits > 8 else value).cast("int")


def with_sign(value: Column, dtype: str, target: str) -> Column:
    """Integers of a signed type moved into the unsigned range, or back."""
    if dtype.startswith("u") == target.startswith("u"):
        return value
    half = float(1 << (int(target.lstrip("uint")) - 1))
    return value + half if target.startswith("u") else value - half


def inverted(value: Column, dtype: str) -> Column:
    """The type's largest number less the value; 1 less the value for floats."""
    if dtype.startswith("float"):
        return 1.0 - value
    bits = int(dtype.lstrip("uint"))
    return ((1 << bits) - 1 if dtype.startswith("u") else (1 << (bits - 1)) - 1) - value


def otsu_split(tiles: DataFrame, value: str) -> DataFrame:
    """``tiles`` with threshold and is_over, by the whole-numbered value whose two sides differ most; of equal ones the smallest.

    Window sums run over distinct values, of which a 16-bit type has 65,536 at most.
    """
    counts = tiles.groupBy(F.col(value).cast("long").alias("v")).agg(F.count("*").alias("n"))
    below = W.orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(F.lit(0))
    sums = counts.select("v", F.sum("n").over(below).alias("n0"), F.sum(F.col("v") * F.col("n")).over(below).alias("s0"), F.sum("n").over(whole).alias("n"), F.sum(F.col("v") * F.col("n")).over(whole).alias("s"))
    part = F.col("n0") / F.col("n")
    between = F.coalesce(F.pow(F.col("s") / F.col("n") * part - F.col("s0") / F.col("n"), 2) / F.nullif(part * (1 - part), F.lit(0.0)), F.lit(0.0))
    best = sums.agg(F.max_by("v", F.struct(F.round(between, 9), -F.col("v"))).alias("threshold"))
    return tiles.crossJoin(F.broadcast(best)).withColumn("is_over", F.col(value).cast("long") > F.col("threshold"))  # one row


def noise_split(pixels: DataFrame, scale: float = 1.0) -> DataFrame:
    """(tile_id, deviation, threshold, is_over): tiles whose deviation, as a whole number, is over Otsu's threshold of all tiles' ones."""
    deviation = pixels.groupBy("tile_id").agg(F.floor(F.stddev_pop("value") * scale).alias("deviation"))
    return otsu_split(deviation, "deviation")


def marked(pixels: DataFrame, points: DataFrame, value: float, radius: int = 0) -> DataFrame:
    """Pixels with a value drawn at points (tile_id, y, x), squares of a radius."""
    near = F.sequence(F.lit(-radius), F.lit(radius))
    spots = points.select("tile_id", F.explode(F.transform(near, lambda d: F.col("y") + d)).alias("y"), "x").select("tile_id", "y", F.explode(F.transform(near, lambda d: F.col("x") + d)).alias("x")).distinct().withColumn("hit", F.lit(True))
    return pixels.join(spots, ["tile_id", "y", "x"], "left").withColumn("value", F.when(F.col("hit"), F.lit(value)).otherwise(F.col("value"))).select(*pixels.columns)


def match_lines(matches: DataFrame, fixed: DataFrame, moving: DataFrame, height: int, width: int) -> DataFrame:
    """(a, b, is_inlier, y0, x0, y1, x1) of matches (a, b, is_inlier) between points (idx, y, x) of two images side by side.

    The second image is put beyond the first one's shorter side; inliers are the last rows in order ``n``.
    """
    dy, dx = (height, 0) if height <= width else (0, width)
    p, q = fixed.select(F.col("idx").alias("a"), F.col("y").alias("y0"), F.col("x").alias("x0")), moving.select(F.col("idx").alias("b"), (F.col("y") + dy).alias("y1"), (F.col("x") + dx).alias("x1"))
    return matches.join(p, "a").join(q, "b").select("a", "b", "is_inlier", "y0", "x0", "y1", "x1").withColumn("n", F.col("is_inlier").cast("int"))


def grid(spark: SparkSession, height: int, width: int) -> DataFrame:
    """All places (y, x) of a field."""
    return spark.range(height * width).select(F.floor(F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))
