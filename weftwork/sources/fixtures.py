"""Tiles, pixels and names derived from the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 25.6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector of 64 numbers as a tile of 8 by 8 pixels; NaN is no value."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("p", "v"))
    value = F.nanvl(F.col("v").cast("double"), F.lit(None).cast("double"))
    return e.select(F.col("vec_id").alias("tile_id"), F.col("label").alias("z"), F.floor(F.col("p") / 8).cast("int").alias("y"), (F.col("p") % 8).alias("x"), value.alias("value"))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers on a stage grid of the step of 24 with tiles of 25.6 micrometers."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("tile_id"), ((k % 10) * 24.0 + F.col("s_acctbal") / 10000.0).alias("x"), (F.floor(k / 10) * 24.0).alias("y"), F.col("s_nationkey").cast("double").alias("z"), F.lit(SIDE).alias("sx"), F.lit(SIDE).alias("sy"))
