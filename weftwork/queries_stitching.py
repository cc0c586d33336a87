"""Registered queries of stitching: a known scene cut into tiles of wrong positions, and put together again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.catalog import query, rounded
from weftwork.operators import metrics, stitch, tiles
from weftwork.sources.fixtures import table

#: Sides of a tile, steps between tiles along y and x, and the pixel size.
SIDE, STEP_Y, STEP_X, PIXEL = 32, 20, 16, 0.5


def scene_tiles(spark, sf_dir) -> DataFrame:
    """All vectors as the rows of a scene 64 wide, cut into overlapping tiles whose stage positions are off by up to 2 pixels.

    A tile has up to 32 rows; its id is 3 times its row of tiles plus its column.
    """
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("y"), F.col("embedding").cast("array<double>").alias("row"))
    last = e.agg(F.max(F.greatest(F.ceil((F.col("y") + 1 - SIDE) / STEP_Y), F.lit(0))).alias("last"))
    rows = e.crossJoin(F.broadcast(last))  # one row
    own = F.sequence(F.greatest(F.ceil((F.col("y") - SIDE + 1) / STEP_Y), F.lit(0)), F.least(F.floor(F.col("y") / STEP_Y), F.col("last")))
    rows = rows.select("y", "row", F.explode(own).alias("r")).select("y", "r", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("c"), "row")
    rows = rows.select("r", "c", "y", F.slice("row", F.col("c") * STEP_X + 1, SIDE).alias("row"))
    cut = rows.groupBy("r", "c").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "row"))), lambda s: s["row"]).alias("image"))
    r, c = F.col("r"), F.col("c")
    off_x, off_y = (r * 7 + c * 3) % 5 - 2, (r * 5 + c * 11) % 5 - 2
    return cut.select((r * 3 + c).alias("tile_id"), ((c * STEP_X + off_x) * PIXEL).alias("x"), ((r * STEP_Y + off_y) * PIXEL).alias("y"), F.lit(0.0).alias("z"), F.lit(PIXEL).alias("px"), F.lit(PIXEL).alias("py"), "image")


def _registered(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    images = scene_tiles(spark, sf_dir).persist()
    edges = stitch.register(images, tiles.pairs(stitch.boxes(images)), "peaks", subpixel=False).persist()
    return images, edges, stitch.resolve(edges.where("quality >= 0.9"), images.select("tile_id")).persist()


@query("SELECT vec_id AS y, x::BIGINT AS x, round(embedding[x + 1]::DOUBLE, 6) + 0.0::DOUBLE AS value FROM embeddings, (SELECT unnest(generate_series(0, 63)) AS x)")
def stitched_scene(spark, sf_dir):
    """The scene from its tiles: overlaps cropped by stage positions, registered, solved, resampled and averaged."""
    images, _, transforms = _registered(spark, sf_dir)
    grid = stitch.output_grid(images, transforms)
    return rounded(stitch.chunk_pixels(stitch.fused(stitch.views(images, transforms, grid), grid)).select("y", "x", "value"), "value")


_TILES = "t AS (SELECT r * 3 + c AS tile_id, r, c, (r * 7 + c * 3) % 5 - 2 AS ox, (r * 5 + c * 11) % 5 - 2 AS oy FROM (SELECT unnest(generate_series(0, (SELECT greatest(ceil((max(vec_id) + 1 - 32) / 20.0), 0)::BIGINT FROM embeddings))) AS r), (SELECT unnest([0, 1, 2]) AS c))"


@query(f"WITH {_TILES} SELECT tile_id, round((c * 16 + ox) * 0.5 + dx, 6) + 0.0::DOUBLE AS x, round((r * 20 + oy) * 0.5 + dy, 6) + 0.0::DOUBLE AS y FROM (SELECT *, (-2 - ox) * 0.5 AS dx, (-2 - oy) * 0.5 AS dy FROM t)")
def stitched_positions(spark, sf_dir):
    """The tiles' positions after registration."""
    images, _, transforms = _registered(spark, sf_dir)
    out = images.select("tile_id", "x", "y").join(transforms, "tile_id")
    return rounded(out.select("tile_id", (F.col("x") + F.col("matrix")[2]).alias("x"), (F.col("y") + F.col("matrix")[5]).alias("y")), "x", "y")


@query(f"""WITH {_TILES}, p AS (SELECT a.tile_id AS i, b.tile_id AS j, a.ox - b.ox AS dx, a.oy - b.oy AS dy FROM t a JOIN t b ON a.tile_id < b.tile_id AND ((a.r = b.r AND b.c = a.c + 1) OR (a.c = b.c AND b.r = a.r + 1)))
SELECT i, j, dx * 0.5::DOUBLE AS dx, dy * 0.5::DOUBLE AS dy FROM p""")
def stitched_edges(spark, sf_dir):
    """The shifts between tiles next to each other."""
    _, edges, _ = _registered(spark, sf_dir)
    near = (F.col("j") - F.col("i") == 3) | ((F.col("j") - F.col("i") == 1) & (F.col("i") % 3 != 2))
    return rounded(edges.where(near).select("i", "j", F.col("matrix")[2].alias("dx"), F.col("matrix")[5].alias("dy")), "dx", "dy")


@query(f"""WITH {_TILES}, p AS (SELECT a.tile_id AS i, b.tile_id AS j FROM t a JOIN t b ON a.tile_id < b.tile_id AND ((a.r = b.r AND b.c = a.c + 1) OR (a.c = b.c AND b.r = a.r + 1))) SELECT i, j, 1.0::DOUBLE AS value FROM p""")
def stitched_metrics(spark, sf_dir):
    """The correlation of neighbours in their overlap after registration, in the fused image's grid."""
    images, edges, transforms = _registered(spark, sf_dir)
    near = edges.where((F.col("j") - F.col("i") == 3) | ((F.col("j") - F.col("i") == 1) & (F.col("i") % 3 != 2))).select("i", "j")
    grid = stitch.output_grid(images, transforms)
    both = {"registered": stitch.pair_views(images, near, transforms, grid)}
    return rounded(metrics.looked_up(metrics.by_key(both, ["ncc"]), "ncc", F.col("i").isNotNull(), ["source_metadata", "registered"]), "value")
