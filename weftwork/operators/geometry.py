"""Contours, points and positions: moments, borders, rotations undone, stage coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftwork.operators.matching import nn_distance


def moments(contours: DataFrame, by: str) -> DataFrame:
    """(by, m00, m10, m01) of closed contours ``by``, i, x, y, their points in the order of i; and the points' mean mx, my.

    The sums are signed by the contour's direction; m00 is made positive and the others with it.
    """
    order = W.partitionBy(by).orderBy("i").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    following = W.partitionBy(by).orderBy("i")
    nexts = contours.select(by, "x", "y", *(F.coalesce(F.lead(c).over(following), F.first(c).over(order)).alias(f"n{c}") for c in "xy"))
    cross = F.col("x") * F.col("ny") - F.col("nx") * F.col("y")
    sums = nexts.groupBy(by).agg((F.sum(cross) / 2).alias("a"), (F.sum((F.col("x") + F.col("nx")) * cross) / 6).alias("b"), (F.sum((F.col("y") + F.col("ny")) * cross) / 6).alias("c"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    sign = F.when(F.col("a") < 0, -1.0).otherwise(1.0)
    return sums.select(by, (sign * F.col("a")).alias("m00"), (sign * F.col("b")).alias("m10"), (sign * F.col("c")).alias("m01"), "mx", "my")


def centers(contours: DataFrame, by: str) -> DataFrame:
    """(by, m00, cx, cy): the center by moments, or the mean of the points where the contour has no area."""
    area = F.abs(F.col("m00")) > 1e-9
    return moments(contours, by).select(by, "m00", F.when(area, F.col("m10") / F.col("m00")).otherwise(F.col("mx")).alias("cx"), F.when(area, F.col("m01") / F.col("m00")).otherwise(F.col("my")).alias("cy"))


def _inside(x: Column, y: Column, width: float, height: float, part: float) -> Column:
    """From 0 at the border to 1 at a part of the way to the center."""
    far = F.greatest(F.abs(x / (width / 2) - 1), F.abs(y / (height / 2) - 1))
    return F.greatest(F.least((1 - far) / part, F.lit(1.0)), F.lit(0.0))


def off_edges(points: DataFrame, width: float, height: float, part: float = 0.1, threshold: float = 0.5) -> DataFrame:
    """Points (set, idx, x, y) whose weight by distance from the border, times 1 to 1/2 by their rank, is over a threshold."""
    rank = 1 - (F.row_number().over(W.partitionBy("set").orderBy("idx")) - 1) / F.count("*").over(W.partitionBy("set")) / 2
    return points.withColumn("weight", _inside(F.col("x"), F.col("y"), width, height, part) * rank).where(F.col("weight") > threshold)


def edge_weights(spark: SparkSession, height: int, width: int, part: float = 0.1) -> DataFrame:
    """(y, x, weight) of every place of a field."""
    places = spark.range(height * width).select(F.floor(F.col("id") / width).alias("y"), (F.col("id") % width).alias("x"))
    return places.withColumn("weight", _inside(F.col("x"), F.col("y"), float(width), float(height), part))


def unrotated(tiles: DataFrame, angles: DataFrame, center: tuple[float, float] | None = None) -> DataFrame:
    """``tiles`` (x, y, rotation) turned back around one center, by their rotation or, without one, by minus the mean of pairs' angles.

    The center is the mean position if not given. A tile without a rotation where there is no angle stays.
    """
    about = tiles.agg(F.avg("x").alias("cx"), F.avg("y").alias("cy")) if center is None else tiles.sparkSession.range(1).select(F.lit(center[0]).alias("cx"), F.lit(center[1]).alias("cy"))
    mean = angles.agg((-F.avg("angle")).alias("mean_angle"))
    rows = tiles.crossJoin(F.broadcast(about)).crossJoin(F.broadcast(mean)).withColumn("rotation", F.coalesce("rotation", "mean_angle"))  # one row each
    turn = F.radians(-F.coalesce(F.col("rotation"), F.lit(0.0)))
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    return rows.withColumns({"x": F.cos(turn) * dx + F.sin(turn) * dy + F.col("cx"), "y": F.cos(turn) * dy - F.sin(turn) * dx + F.col("cy")}).drop("cx", "cy", "mean_angle")


def mean_nn(fixed: DataFrame, moving: DataFrame, by: str) -> DataFrame:
    """(by, nn): the mean of both sets' median nearest distances."""
    a, b = (nn_distance(p, by).withColumnRenamed("nn", c) for p, c in ((fixed, "a"), (moving, "b")))
    return a.join(b, by, "full").select(by, ((F.coalesce("a", F.lit(1.0)) + F.coalesce("b", F.lit(1.0))) / 2).alias("nn"))


def _setting(config: Column, section: str, name: str) -> Column:
    """A value in a section of a configuration in lines."""
    body = F.regexp_extract(config, rf"(?s)\[{section}\]\n(.*?)(?:\n\[|$)", 1)
    return F.nullif(F.trim(F.regexp_extract(body, rf"(?m)^{name} *[=:] *(.*)$", 1)), F.lit(""))


def from_stage(tiles: DataFrame) -> DataFrame:
    """``tiles`` (path, x, y, nx, ny, config) with corners x and y and pixel size ``pixel`` from stage positions and their program's configuration.

    The stage's scale and the skew of its axes are undone; the pixel size is that of the tile's grid (by
    its region of interest where the name has one) or overview; the center becomes the corner. Without a pixel size there is no corner.
    """
    config, path = F.col("config"), F.element_at(F.split("path", r"[/\\]"), -1)
    microtome = F.coalesce(_setting(config, "sys", "use_microtome"), F.lit("")) != ""

    def stage(name: str) -> Column:
        return F.when(microtome, _setting(config, "microtome", name)).otherwise(_setting(config, "sem", name)).cast("double")

    def index(label: str) -> Column:
        return F.nullif(F.regexp_extract(path, rf"(?:^|[._-]){label}(\d+)", 1), F.lit("")).cast("int")

    def numbers(section: str, name: str) -> Column:
        return F.from_json(_setting(config, section, name), "array<double>")

    grid = F.when(index("r").isNotNull(), F.array_position(F.from_json(_setting(config, "grids", "roi_index"), "array<int>"), index("r")) - 1).otherwise(index("g")).cast("int")
    overview = F.when(F.contains(F.lower(path), F.lit("_stubov_")), _setting(config, "overviews", "stub_ov_pixel_size").cast("double"))
    nanometers = F.when(index("t").isNotNull(), F.get(numbers("grids", "pixel_size"), grid)).otherwise(F.coalesce(F.get(numbers("overviews", "ov_pixel_size"), index("ov")), overview))
    rows = tiles.withColumns({"u": F.col("x") / stage("stage_scale_factor_x"), "v": F.col("y") / stage("stage_scale_factor_y"), "rx": stage("stage_rotation_angle_x"), "ry": stage("stage_rotation_angle_y"), "pixel": nanometers * 1e-3})
    skew = F.cos(F.col("rx") - F.col("ry"))
    rows = rows.withColumns({"a": F.cos("ry") / skew, "b": -F.sin("ry") / skew, "c": F.sin("rx") / skew, "d": F.cos("rx") / skew})
    det = F.col("a") * F.col("d") - F.col("b") * F.col("c")
    rows = rows.withColumns({"x": (F.col("d") * F.col("u") - F.col("b") * F.col("v")) / det - F.col("nx") * F.col("pixel") / 2, "y": (F.col("a") * F.col("v") - F.col("c") * F.col("u")) / det - F.col("ny") * F.col("pixel") / 2})
    return rows.drop("u", "v", "rx", "ry", "a", "b", "c", "d")


def filesets_together(tiles: DataFrame, by: str, every: Column, some: Column) -> DataFrame:
    """One row: the mean of the filesets' mean centers, the largest pixel size, and whether conditions hold for all and for some tiles."""
    sets = tiles.groupBy(by).agg(F.avg(F.col("x") + F.col("sx") / 2).alias("cx"), F.avg(F.col("y") + F.col("sy") / 2).alias("cy"), F.max("pixel").alias("pixel"), F.every(every).alias("all_hold"), F.some(some).alias("some_hold"))
    return sets.agg(F.avg("cx").alias("cx"), F.avg("cy").alias("cy"), F.max("pixel").alias("pixel"), F.every("all_hold").alias("all_hold"), F.some("some_hold").alias("some_hold"))


def either_order(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (i, j) with the columns of the edge between both, whichever way it goes; null where there is none."""
    ends = lambda df: df.withColumns({"low": F.least("i", "j"), "high": F.greatest("i", "j")})
    return ends(asked).join(ends(edges).drop("i", "j"), ["low", "high"], "left").drop("low", "high")
