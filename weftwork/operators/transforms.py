"""Tables of transforms: (tile_id, transform_key, matrix), copied, composed and lifted to three dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.functions import affine


def keys(transforms: DataFrame) -> DataFrame:
    """The distinct transform keys."""
    return transforms.select("transform_key").distinct()


def copied(source: DataFrame, target: DataFrame, key: str, have: str = "xy", want: str = "xy") -> DataFrame:
    """``target`` (tile_id, transform_key, matrix) with the source's matrices of a key, for the target's dimensions; the identity where the source has none."""
    own = source.where(F.col("transform_key") == key).select("tile_id", affine.for_dims(F.col("matrix"), have, want).alias("m"))
    identity = F.array(*(F.lit(float(i == j)) for i in range(len(want) + 1) for j in range(len(want) + 1)))
    rest = target.where(F.col("transform_key") != key).select("tile_id", "transform_key", "matrix")
    new = target.select("tile_id").distinct().join(own, "tile_id", "left").select("tile_id", F.lit(key).alias("transform_key"), F.coalesce("m", identity).alias("matrix"))
    return rest.unionByName(new)


def composed(tiles: DataFrame, slices: DataFrame) -> DataFrame:
    """(slice, tile_id, matrix): each slice's transform after its tiles' ones; a slice without a transform leaves its tiles out."""
    whole = slices.select("slice", F.col("matrix").alias("global"))
    return tiles.join(whole, "slice").select("slice", "tile_id", affine.product(F.col("global"), F.col("matrix")).alias("matrix"))


def by_label(composites: DataFrame, to_3d: bool = False) -> DataFrame:
    """(label, matrix) of slices' tiles, labelled slice_tile, in three dimensions where asked."""
    matrix: Column = F.col("matrix")
    return composites.select(F.concat_ws("_", "slice", "tile_id").alias("label"), (affine.in_3d(matrix) if to_3d else matrix).alias("matrix"))


def best(transforms: DataFrame, order: tuple[str, ...] = ("registered", "transform", "source_metadata")) -> DataFrame:
    """Each tile's transform of the first key that it has."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("transform_key"))
    return transforms.where(place > 0).groupBy("tile_id").agg(F.min_by(F.struct("transform_key", "matrix"), place).alias("t")).select("tile_id", "t.transform_key", "t.matrix")


def in_3d(tiles: DataFrame, z_scale: float = 1.0) -> DataFrame:
    """``tiles`` (tile_id, n, x, y, z, matrix) with z, that of its place n where it has none, and a 4x4 matrix."""
    return tiles.withColumn("z", F.coalesce("z", F.col("n") * z_scale)).withColumn("matrix", affine.in_3d(F.col("matrix")))


def in_2d(tiles: DataFrame) -> DataFrame:
    """``tiles`` without z and with the 3x3 part of x and y of their 4x4 matrix."""
    return tiles.drop("z").withColumn("matrix", affine.for_dims(F.col("matrix"), "xyz", "xy"))
