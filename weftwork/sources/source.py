"""Which reader an image file needs, and what it says of itself, in one form for all formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.functions import text
from weftwork.sources import chunks, ngff, tiff


def kind(path: Column) -> Column:
    """"tiff" or "zarr" by a path's name; null for others."""
    name = F.lower(path)
    return F.when(F.regexp_extract(name, r"\.([^./]*)$", 1).rlike("^tif"), "tiff").when(F.contains(name, F.lit(".zar")), "zarr")


def described(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """(path, label, kind, level, dims, height, width, dtype, pixel, position, rotation) of image files of any known format.

    Paths of unknown names are refused when their rows are made.
    """
    rows = paths.select("path", F.coalesce(kind(F.col("path")), F.raise_error(F.concat(F.lit("unknown image format: "), "path"))).alias("kind"))
    tiffs = tiff.headers(rows.where("kind = 'tiff'")).where("page = 0")
    tiffs = tiffs.select("path", text.file_title(F.col("path")).alias("label"), F.lit("tiff").alias("kind"), "level", F.lit("yx").alias("dims"), "height", "width", "dtype", "pixel", "position", "rotation")
    folders = [r[0] for r in rows.where("kind = 'zarr'").select("path").distinct().collect()]  # one path for each image
    if not folders:
        return tiffs
    images = ngff.images(spark, folders).select("path", "label", "dims", F.posexplode("levels").alias("level", "l"))
    shapes = chunks.arrays(spark, folders).select(F.col("array"), "shape", "dtype")
    found = images.join(shapes, F.col("array") == F.concat_ws("/", "path", "l.path"))
    by = lambda name: F.map_filter(F.map_from_arrays("dims", F.col(f"l.{name}")), lambda d, _: d.isin("x", "y", "z"))
    zarrs = found.select("path", "label", F.lit("zarr").alias("kind"), "level", F.concat_ws("", "dims").alias("dims"), F.element_at("shape", -2).alias("height"), F.element_at("shape", -1).alias("width"), "dtype", by("scale").alias("pixel"), by("translation").alias("position"), F.lit(None).cast("double").alias("rotation"))
    return tiffs.unionByName(zarrs)


def _not_in(dims: list[str]):
    return lambda d, _: ~d.isin(*dims)


def overridden(sources: DataFrame, settings: dict[str, str | float | dict]) -> DataFrame:
    """``sources`` with positions, pixel sizes and rotation set by settings: a number, ``source`` (kept), ``invert`` (negated), or an expression of the numbers in the file's name."""
    rows = sources.withColumn("fn", text.numbers(text.file_title(F.col("path"))))

    def value(said: str | float, known: Column) -> Column:
        if said == "source":
            return known
        if said == "invert":
            return -known
        return text.arithmetic(said, set()) if isinstance(said, str) else F.lit(float(said))

    for column, name in (("position", "position"), ("pixel", "scale")):
        own = settings.get(name)
        if own == "invert":
            rows = rows.withColumn(column, F.transform_values(column, lambda _, v: -v))
        elif isinstance(own, dict):
            new = F.create_map(*(x for d, said in own.items() for x in (F.lit(d), value(said, F.element_at(column, d)))))
            rows = rows.withColumn(column, F.map_concat(F.map_filter(column, _not_in(list(own))), new))
    if "rotation" in settings:
        rows = rows.withColumn("rotation", value(settings["rotation"], F.col("rotation")))
    return rows.drop("fn")
