"""Tiles, their pairs and the output grid. A tile has tile_id, x, y, z (its corner, in micrometers) and sx, sy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _sides(tiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    cols = ("tile_id", "x", "y", "z", "sx", "sy", *(c for c in ("zr", "cell") if c in tiles.columns))
    return tuple(tiles.select(*(F.col(c).alias(f"{s}_{c}") for c in cols)) for s in "ab")


def _neighbours(tiles: DataFrame, limit: Column | float, z: str = "far") -> DataFrame:
    """Pairs i < j from the same or a neighbouring grid cell: an equi-join on cells instead of all pairs."""
    size = tiles.agg(F.max(limit if isinstance(limit, Column) else F.lit(limit))).first()[0] or 1.0
    return _around(tiles, tiles, size, z).where("a_tile_id < b_tile_id")


def _around(some: DataFrame, tiles: DataFrame, size: float, z: str = "far") -> DataFrame:
    """Each of some tiles with all others in its grid cell and those next to it.

    Cells have a third part: z in steps of the size where distance counts z ("near"), its rank of ``zr`` ("rank"), z itself
    where only one plane counts ("same"), or nothing ("far").
    """
    third = {"far": F.lit(0.0), "near": F.floor(F.col("z") / size).cast("double"), "rank": F.col("zr").cast("double") if "zr" in tiles.columns else F.lit(0.0), "same": F.col("z")}[z]
    own, other = (_sides(t.withColumn("cell", F.struct(F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy"), third.alias("cz"))))[k] for k, t in enumerate((some, tiles)))
    steps = (-1.0, 0.0, 1.0) if z in ("near", "rank") else (0.0,)
    near = F.explode(F.array(*(F.struct((F.col("a_cell.cx") + dx).alias("cx"), (F.col("a_cell.cy") + dy).alias("cy"), (F.col("a_cell.cz") + dz).alias("cz")) for dx in (-1, 0, 1) for dy in (-1, 0, 1) for dz in steps)))
    return own.withColumn("cell", near).join(other, F.col("cell") == F.col("b_cell")).where("a_tile_id != b_tile_id").drop("cell", "a_cell", "b_cell")


def _center(side: str, axis: str) -> Column:
    return F.col(f"{side}_{axis}") + F.col(f"{side}_s{axis}") / 2


def _distance(flat: bool) -> Column:
    d = F.pow(_center("a", "x") - _center("b", "x"), 2) + F.pow(_center("a", "y") - _center("b", "y"), 2)
    return F.sqrt(d if flat else d + F.pow(F.col("a_z") - F.col("b_z"), 2))


_LARGEST = ("a_sx", "a_sy", "b_sx", "b_sy")


def pairs(tiles: DataFrame, overlap: bool = False, mixed_z: bool = False) -> DataFrame:
    """(i, j, distance): tiles whose centers are nearer than the largest side (or half of it, with ``overlap``).

    With ``mixed_z`` distances are in the plane, tiles must be on the same or on adjacent distinct z, and the
    limit is 0.8 of the side between different z.
    """
    if mixed_z:
        ranks = tiles.select("z").distinct().withColumn("zr", F.dense_rank().over(W.orderBy("z")))  # one row for each z
        tiles = tiles.join(ranks, "z")
    found = _neighbours(tiles, F.greatest("sx", "sy"), "rank" if mixed_z else "near").withColumn("distance", _distance(mixed_z))
    limit = F.greatest(*_LARGEST) * (0.5 if overlap else 1.0)
    if mixed_z:
        found = found.where(F.abs(F.col("a_zr") - F.col("b_zr")) <= 1)
        limit = F.when(F.col("a_z") == F.col("b_z"), limit).otherwise(limit * 0.8)
    return found.where(F.col("distance") < limit).select(F.col("a_tile_id").alias("i"), F.col("b_tile_id").alias("j"), "distance")


def pairs_between(new: DataFrame, known: DataFrame) -> DataFrame:
    """(i, j, distance) of new tiles with known ones, the smaller id first; pairs among the known ones are not looked at."""
    size = new.select("sx", "sy").union(known.select("sx", "sy")).agg(F.max(F.greatest("sx", "sy"))).first()[0] or 1.0
    found = _around(new, known, size, "near").withColumn("distance", _distance(False)).where(F.col("distance") < F.greatest(*_LARGEST))
    return found.select(F.least("a_tile_id", "b_tile_id").alias("i"), F.greatest("a_tile_id", "b_tile_id").alias("j"), "distance").distinct()


def pair_angles(tiles: DataFrame) -> DataFrame:
    """(i, j, angle) of the pairs of :func:`pairs`: the direction between centers in the plane, turned by 90 where near, folded to -90..90."""
    found = _neighbours(tiles, F.greatest("sx", "sy"), "near").withColumn("distance", _distance(False)).where(F.col("distance") < F.greatest(*_LARGEST))
    raw = F.degrees(F.atan2(_center("b", "y") - _center("a", "y"), _center("b", "x") - _center("a", "x")))
    raw = raw + F.when(F.col("distance") < F.least(*_LARGEST), 90.0).otherwise(0.0)
    folded = F.when(raw > 90, raw - 180).when(raw < -90, raw + 180).otherwise(raw)
    return found.select(F.col("a_tile_id").alias("i"), F.col("b_tile_id").alias("j"), folded.alias("angle"))


def following(rows: DataFrame, key: str, parts: int = 200) -> DataFrame:
    """(i, j): each key with the next larger one. Keys are ordered within ranges of equal width, and ranges joined at their ends."""
    ids = rows.select(F.col(key).alias("i")).where("i IS NOT NULL").distinct()
    low, high = ids.agg(F.min("i"), F.max("i")).first()
    if low is None:
        return ids.select("i", F.col("i").alias("j"))
    width = max(1, -(-(high - low + 1) // parts))
    ids = ids.withColumn("part", F.floor((F.col("i") - low) / width))
    after = ids.groupBy("part").agg(F.min("i").alias("first")).select(F.col("part"), F.lead("first").over(W.orderBy("part")).alias("after"))  # ``parts`` rows
    within = ids.withColumn("j", F.lead("i").over(W.partitionBy("part").orderBy("i")))
    return within.join(F.broadcast(after), "part").select("i", F.coalesce("j", "after").alias("j")).where("j IS NOT NULL")


def consecutive(tiles: DataFrame) -> DataFrame:
    """Each tile of a stack with the next by z, then id, within its part of the grid."""
    order = W.partitionBy("x", "y").orderBy("z", "tile_id")
    return tiles.withColumn("j", F.lead("tile_id").over(order)).where("j IS NOT NULL").select(F.col("tile_id").alias("i"), "j")


def overlaps(tiles: DataFrame) -> DataFrame:
    """(tile_id, nearest, has_overlap, large): nearest center distance, z included, over the mean diagonal.

    Neighbours are searched first. A tile whose nearest may lie beyond them is searched again in cells twice
    as wide, until it can't or all tiles are neighbours.
    """
    mean = (F.sqrt(F.pow("a_sx", 2) + F.pow("a_sy", 2)) + F.sqrt(F.pow("b_sx", 2) + F.pow("b_sy", 2))) / 2

    def ratios(found: DataFrame) -> DataFrame:
        return found.select("a_tile_id", "b_tile_id", (F.col("distance") / mean).alias("ratio"))

    found = ratios(_neighbours(tiles, F.greatest("sx", "sy") * 2, "near").withColumn("distance", _distance(False)))
    found = found.select(F.explode(F.array("a_tile_id", "b_tile_id")).alias("tile_id"), "ratio").groupBy("tile_id").agg(F.min("ratio").alias("nearest"))
    found = tiles.select("tile_id").join(found, "tile_id", "left")
    side, diagonal, width = tiles.agg(F.max(F.greatest("sx", "sy")), F.max(F.sqrt(F.pow("sx", 2) + F.pow("sy", 2))), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.max("z") - F.min("z"))).first()
    size = 2 * (side or 0.0)
    while diagonal and size < width:
        # a tile out of the searched cells is further than their size from corner to corner
        found = found.persist()
        open_ = found.where(F.coalesce(F.col("nearest") > (size - side / 2) / diagonal, F.lit(True))).select("tile_id")
        if open_.isEmpty():
            break
        size *= 2
        more = _around(tiles.join(open_, "tile_id"), tiles, size, "near").withColumn("distance", _distance(False))
        more = ratios(more).groupBy(F.col("a_tile_id").alias("tile_id")).agg(F.min("ratio").alias("further"))
        found = found.join(more, "tile_id", "left").select("tile_id", F.least("nearest", "further").alias("nearest"))
    return found.select("tile_id", "nearest", F.coalesce(F.col("nearest") < 1, F.lit(False)).alias("has_overlap"), F.coalesce(F.col("nearest") <= 0.5, F.lit(False)).alias("large"))


def overlap_boxes(tiles: DataFrame) -> DataFrame:
    """(i, j, x0, y0, x1, y1, area) of the common area of tiles on one z."""
    found = _neighbours(tiles, F.greatest("sx", "sy"), "same")
    found = found.select(F.col("a_tile_id").alias("i"), F.col("b_tile_id").alias("j"), *(F.greatest(f"a_{c}", f"b_{c}").alias(f"{c}0") for c in "xy"), *(F.least(F.col(f"a_{c}") + F.col(f"a_s{c}"), F.col(f"b_{c}") + F.col(f"b_s{c}")).alias(f"{c}1") for c in "xy"))
    return found.where("x0 < x1 AND y0 < y1").withColumn("area", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))


def output_grid(tiles: DataFrame, spacing: float) -> DataFrame:
    """Origin and size of the grid that holds all tiles; z counts distinct positions."""
    low = tiles.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("sx")).alias("x1"), F.max(F.col("y") + F.col("sy")).alias("y1"), F.count_distinct("z").alias("nz"))
    return low.select("x0", "y0", F.ceil((F.col("x1") - F.col("x0")) / spacing).alias("nx"), F.ceil((F.col("y1") - F.col("y0")) / spacing).alias("ny"), "nz")


def z_spacing(tiles: DataFrame) -> DataFrame:
    """The least step between distinct z."""
    steps = tiles.select("z").distinct().withColumn("step", F.col("z") - F.lag("z").over(W.orderBy("z")))  # one row for each z
    return steps.agg(F.min("step").alias("z_spacing"))


def z_groups(tiles: DataFrame) -> DataFrame:
    """(z, n, first_tile): tiles by z where a z repeats, else one group of z null."""
    n = tiles.agg((F.count("*") > F.count_distinct("z")).alias("repeats"))
    keyed = tiles.crossJoin(F.broadcast(n)).withColumn("z", F.when(F.col("repeats"), F.col("z")))  # one row
    return keyed.groupBy("z").agg(F.count("*").alias("n"), F.min("tile_id").alias("first_tile"))


def summary(tiles: DataFrame, by: str) -> DataFrame:
    """Mean center, extent and area of each fileset."""
    return tiles.groupBy(by).agg(F.count("*").alias("n"), F.avg(F.col("x") + F.col("sx") / 2).alias("cx"), F.avg(F.col("y") + F.col("sy") / 2).alias("cy"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("sx")).alias("x1"), F.max(F.col("y") + F.col("sy")).alias("y1")).withColumn("area", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))


def pyramid(shapes: DataFrame, levels: int, factor: float = 2.0) -> DataFrame:
    """(tile_id, level, nx, ny): sizes of further levels, rounded half to even, at least 1."""
    def size(c: str) -> Column:
        return F.greatest(F.bround(F.col(c) * F.pow(F.lit(factor), -F.col("level"))), F.lit(1.0)).cast("long").alias(c)

    return shapes.select("*", F.explode(F.sequence(F.lit(1), F.lit(levels))).alias("level")).select("tile_id", "level", size("nx"), size("ny"))


def level_for(levels: DataFrame, target: Column) -> DataFrame:
    """(tile_id, level, residual): the first level close to a target scale, else the last one not above it; residual scale."""
    close = F.abs(F.col("factor") - target) <= 1e-4 * F.abs(target)
    rows = levels.withColumn("target", target)
    pick = rows.groupBy("tile_id").agg(F.min(F.when(close, F.col("level"))).alias("near"), F.max(F.when(F.col("factor") <= target, F.col("level"))).alias("below"))
    pick = pick.select("tile_id", F.coalesce("near", "below", F.lit(0)).alias("level"))
    residual = F.col("target") / F.col("factor")
    return rows.join(pick, ["tile_id", "level"]).select("tile_id", "level", F.when((F.col("level") == 0) & (residual < 1), 1.0).otherwise(residual).alias("residual"))


def interpolated(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Linear interpolation of missing values by row order, the ends taking the nearest value."""
    rows = rows.withColumn("n", F.row_number().over(W.partitionBy(key).orderBy(order)))
    before = W.partitionBy(key).orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    after = W.partitionBy(key).orderBy("n").rowsBetween(0, W.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct("n", value))
    rows = rows.withColumn("p", F.last(known, True).over(before)).withColumn("q", F.first(known, True).over(after))
    a, b = F.col(f"p.{value}"), F.col(f"q.{value}")
    between = a + (b - a) * (F.col("n") - F.col("p.n")) / (F.col("q.n") - F.col("p.n"))
    return rows.withColumn("filled", F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("p").isNull(), b).when(F.col("q").isNull(), a).otherwise(between)).drop("n", "p", "q")


def as_of(rows: DataFrame, versions: DataFrame, key: str, at: str, since: str, content: str) -> DataFrame:
    """Each row with the latest version of its key that is not later than the row.

    Versions and rows are merged in one sorted pass over each key, so nothing is multiplied.
    """
    v = versions.select(F.col(key), F.col(since).alias("t"), F.struct(F.col(since).alias("since"), F.col(content).alias("content")).alias("v"), F.lit(0).alias("kind"), F.lit(None).cast(rows.schema).alias("r"))
    r = rows.select(F.col(key), F.col(at).alias("t"), F.lit(None).cast(v.schema["v"].dataType).alias("v"), F.lit(1).alias("kind"), F.struct(*rows.columns).alias("r"))
    order = W.partitionBy(key).orderBy("t", "kind").rowsBetween(W.unboundedPreceding, 0)
    return v.union(r).withColumn("last", F.last("v", True).over(order)).where("kind = 1").select("r.*", "last.since", "last.content")
