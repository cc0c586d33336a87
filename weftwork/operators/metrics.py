"""Metrics of pairs by name and transform key, channel windows, matches measured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.functions import units
from weftwork.operators.pixels import large_quantiles


def _inverse(value: Column) -> Column:
    return F.lit(1.0) / F.nullif(value, F.lit(0.0))




def methods(names: list[str] | str, extra: dict[str, Column] | None = None) -> dict[str, Column]:
    """Aggregates of a and b by name: ncc, ncc2, mse (its inverse), or all; and any that are added."""
    correlation = F.covar_pop("a", "b") / F.nullif(F.stddev_pop("a") * F.stddev_pop("b"), F.lit(0.0))
    known = {
        "ncc": correlation,
        "ncc2": correlation,
        "mse": _inverse(F.avg(F.pow(F.col("a") - F.col("b"), 2))),
    } | (extra or {})
    if names == "all":
        return known
    if missing := [n for n in names if n not in known]:
        raise ValueError(f"unknown metrics: {missing}")
    return {n: known[n] for n in names}


def by_key(pixels: dict[str, DataFrame], names: list[str] | str, extra: dict[str, Column] | None = None, qualities: DataFrame | None = None) -> DataFrame:
    """(transform_key, i, j, metric, value) of each pair, and with null i and j the mean over pairs.

    ``pixels`` holds (i, j, y, x, a, b) in the common space of each transform key. ``qualities`` (transform_key,
    i, j, quality) are one more metric, whose zeros count for no mean. Null and NaN values are left out.
    """
    chosen, rows = methods(names, extra), None
    for key, both in pixels.items():
        own = both.groupBy("i", "j").agg(*(f.alias(n) for n, f in chosen.items()))
        own = own.select(F.lit(key).alias("transform_key"), "i", "j", F.explode(F.create_map(*(x for n in chosen for x in (F.lit(n), F.col(n))))).alias("metric", "value"))
        rows = own if rows is None else rows.unionByName(own)
    if qualities is not None:
        rows = rows.unionByName(qualities.where("quality != 0").select("transform_key", "i", "j", F.lit("quality").alias("metric"), F.col("quality").alias("value")))
    rows = rows.where("value IS NOT NULL AND NOT isnan(value)").withColumn("pair", F.struct("i", "j"))
    return rows.groupingSets([["transform_key", "metric", "pair"], ["transform_key", "metric"]], "transform_key", "metric", "pair").agg(F.avg("value").alias("value")).select("transform_key", "pair.i", "pair.j", "metric", "value")


def looked_up(metrics: DataFrame, metric: str, pairs: Column | None, order: list[str]) -> DataFrame:
    """(i, j, value) of a metric for some pairs, or of the summary, under the last of the transform keys that has it."""
    rows = metrics.where(F.col("metric") == metric).where(F.col("i").isNull() if pairs is None else pairs)
    place = F.array_position(F.array(*map(F.lit, order)), F.col("transform_key"))
    return rows.groupBy("i", "j").agg(F.max_by("value", place).alias("value"))


def channel_windows(pixels: DataFrame, channels: DataFrame, dtype: str) -> DataFrame:
    """(c, label, color, start, end_, min, max) of ``channels`` (c, color) from their pixels (c, value).

    start and end_ are the type's range (0 to 1 for floats); min and max the same for types of 8 bits, else the
    0.001 and 0.999 quantiles. A channel without a colour is white.
    """
    bits = int(dtype.lstrip("uintfloa"))
    if dtype.startswith("float"):
        start, end = 0.0, 1.0
    else:
        start, end = (0.0, float((1 << bits) - 1)) if dtype.startswith("u") else (-float(1 << (bits - 1)), float((1 << (bits - 1)) - 1))
    white = F.array(*(F.lit(1.0) for _ in range(4)))
    named = channels.select("c", F.concat(F.lit("Channel "), F.col("c").cast("string")).alias("label"), units.hex_rgb(F.coalesce("color", white)).alias("color"))
    if bits == 8:
        return named.select("*", F.lit(start).alias("start"), F.lit(end).alias("end_"), F.lit(start).alias("min"), F.lit(end).alias("max"))
    q = large_quantiles(pixels, ["c"], [0.001, 0.999])
    return named.join(q, "c").select("c", "label", "color", F.lit(start).alias("start"), F.lit(end).alias("end_"), F.col("q0").alias("min"), F.col("q1").alias("max"))
