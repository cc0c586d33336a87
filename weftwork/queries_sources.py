"""Registered queries of sources and sinks: files are written to the shared folder and read again; and the equivalent SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.catalog import query, rounded
from weftwork.functions import affine
from weftwork.operators import kernels, metrics, stitch, tiles
from weftwork.sources import chunks, files, ngff, source, store, tiff
from weftwork.sources.fixtures import pixels as pixel_rows
from weftwork.sources.fixtures import table
from weftwork.sources.fixtures import tiles as tile_rows
from weftwork.queries_stitching import scene_tiles

PIXELS = "pixels AS (SELECT vec_id AS tile_id, label AS z, ((p - 1) // 8)::INTEGER AS y, ((p - 1) % 8)::INTEGER AS x, embedding[p]::DOUBLE AS value FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS p))"
TILES = "tiles AS (SELECT s_suppkey AS tile_id, (s_suppkey % 10) * 24.0::DOUBLE + s_acctbal / 10000.0::DOUBLE AS x, floor(s_suppkey / 10) * 24.0::DOUBLE AS y, s_nationkey::DOUBLE AS z FROM supplier)"


def shared(spark: SparkSession, name: str) -> str:
    """A new folder where driver and executors meet."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        path = tempfile.mkdtemp(prefix="weftwork-")
    return f"{path.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _stored(spark, sf_dir, name: str, suffix: str) -> tuple[str, DataFrame]:
    folder = shared(spark, name)
    px = pixel_rows(spark, sf_dir).select(F.format_string(f"{folder}/t%06d{suffix}", "tile_id").alias("path"), F.lit(0).alias("c"), "y", F.col("x").cast("int").alias("x"), "value", "tile_id")
    return folder, px


@query(f"WITH {PIXELS} SELECT tile_id, y::BIGINT AS y, x::BIGINT AS x, round(value, 6) + 0.0::DOUBLE AS value FROM pixels")
def tiff_tiles(spark, sf_dir):
    """Tiles as TIFF files, with compressed segments, read again segment by segment."""
    folder, px = _stored(spark, sf_dir, "tiff", ".tif")
    written = tiff.save(px.drop("tile_id"), "float64", levels=1, tile=4, pixel=0.5)
    names = written.select("path").persist()
    names.count()
    got = tiff.pixels(tiff.segments(tiff.headers(names)))
    return rounded(got.select(F.regexp_extract("path", r"t(\d+)\.tif$", 1).cast("long").alias("tile_id"), "y", "x", "value"), "value")


@query("SELECT vec_id AS tile_id, unnest([0, 1]) AS level, (8 / 2 ** unnest([0, 1]))::BIGINT AS height, 'float64' AS dtype, 0.5::DOUBLE AS px, (vec_id % 7) * 1.0::DOUBLE AS x, -(vec_id % 5) * 2.0::DOUBLE AS y, 30.0::DOUBLE AS rotation FROM embeddings")
def tiff_metadata(spark, sf_dir):
    """What headers say of tiles' pyramids, with positions inverted and rotation set by settings."""
    folder, px = _stored(spark, sf_dir, "tiff-meta", ".ome.tif")
    placed = px.withColumns({"px": F.lit(0.5), "x0": -(F.col("tile_id") % 7) * 1.0, "y0": (F.col("tile_id") % 5) * 2.0}).drop("tile_id")
    names = tiff.save(placed, "float64", levels=1, tile=None).select("path").persist()
    names.count()
    found = source.overridden(source.described(spark, names), {"position": "invert", "rotation": "10 * 3"})
    at = lambda c, d: F.element_at(c, d) + 0.0
    return found.select(F.regexp_extract("path", r"t(\d+)\.ome", 1).cast("long").alias("tile_id"), "level", "height", "dtype", at("pixel", "x").alias("px"), at("position", "x").alias("x"), at("position", "y").alias("y"), "rotation")


@query(f"WITH {PIXELS} SELECT z::BIGINT AS plane, 1 AS level, (y // 2)::BIGINT AS y, (x // 2)::BIGINT AS x, round(avg(value), 6) + 0.0::DOUBLE AS value FROM (SELECT z, y, x, avg(value) AS value FROM pixels GROUP BY z, y, x) GROUP BY ALL")
def zarr_pyramid(spark, sf_dir):
    """Mean planes as images with two levels in a store; the second level read by its keys."""
    folder = shared(spark, "zarr")
    planes = pixel_rows(spark, sf_dir).groupBy("z", "y", "x").agg(F.avg("value").alias("value"))
    rows = planes.select(F.format_string(f"{folder}/p%03d.ome.zarr", "z").alias("array"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "value")
    chunks.save_pyramid(spark, rows, [8, 8], [4, 4], "float64", levels=2, pixel={"x": 0.5, "y": 0.5}, channels=[{"label": "mean"}])
    got = chunks.pixels(chunks.chunks(spark, folder, level=1))
    return rounded(got.select(F.regexp_extract("array", r"p(\d+)\.ome", 1).cast("long").alias("plane"), F.lit(1).alias("level"), "y", "x", "value"), "value")


@query("SELECT DISTINCT 'p' || lpad(label::VARCHAR, 3, '0') AS label, unnest([0, 1]) AS level, 0.5 * 2 ** unnest([0, 1])::DOUBLE AS px, 0.25 * unnest([0, 1])::DOUBLE AS x, 'yx' AS dims, (8 / 2 ** unnest([0, 1]))::BIGINT AS width FROM embeddings")
def zarr_metadata(spark, sf_dir):
    """What stores of either format say of their images' levels."""
    folder = shared(spark, "zarr-meta")
    planes = pixel_rows(spark, sf_dir).groupBy("z", "y", "x").agg(F.avg("value").alias("value"))
    rows = planes.select(F.format_string(f"{folder}/p%03d.ome.zarr", "z").alias("array"), "z", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "value")
    for version, part in (("0.4", 0), ("0.5", 1)):
        chunks.save_pyramid(spark, rows.where(F.col("z") % 2 == part).drop("z"), [8, 8], [8, 8], "float64", levels=2, pixel={"x": 0.5, "y": 0.5}, version=version)
    found = source.described(spark, rows.select(F.col("array").alias("path")).distinct())
    return found.select("label", "level", F.element_at("pixel", "x").alias("px"), F.element_at("position", "x").alias("x"), "dims", "width")


def _edges(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    t = tile_rows(spark, sf_dir)
    p = tiles.pairs(t).select("i", "j", affine.rotation(F.lit(0.0), ((F.col("j") - F.col("i")) % 7).cast("double"), ((F.col("i") + F.col("j")) % 5).cast("double")).alias("matrix"), ((F.col("i") * 31 + F.col("j") * 17) % 100 / 100.0).alias("quality"))
    return p, t.select("tile_id", F.format_string("tile%05d", "tile_id").alias("label"))


EDGES = f"{TILES}, edges AS (SELECT a.tile_id AS i, b.tile_id AS j, ((b.tile_id - a.tile_id) % 7)::DOUBLE AS tx, ((a.tile_id + b.tile_id) % 5)::DOUBLE AS ty, (a.tile_id * 31 + b.tile_id * 17) % 100 / 100.0::DOUBLE AS quality FROM tiles a JOIN tiles b ON a.tile_id < b.tile_id WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) < 25.6)"


@query(f"WITH {EDGES} SELECT i, j, tx, ty, quality FROM edges")
def pair_mapping_files(spark, sf_dir):
    """Edges as JSON by labels, read again as edges."""
    edges, labels = _edges(spark, sf_dir)
    path = shared(spark, "pair-mappings")
    files.write_json(files.edge_json(edges, labels), path)
    back = files.edges_from_json(files.read_json(spark, path, "first string, second string, mapping array<array<double>>, quality double"), labels)
    return back.select("i", "j", F.col("matrix")[2].alias("tx"), F.col("matrix")[5].alias("ty"), "quality")


@query(f"""WITH {TILES}, m AS (SELECT *, radians(tile_id % 90) AS g, (tile_id % 7)::DOUBLE AS tx FROM tiles) SELECT printf('tile%05d', tile_id) AS id, round((x + tx) / 0.032, 6) AS x_pixels, round((y - 1) / 0.032, 6) + 0.0::DOUBLE AS y_pixels, round(z / 0.032, 6) AS z_pixels, round(x + tx, 6) AS x, round(y - 1, 6) AS y, z, round(degrees(g), 6) AS rotation FROM m""")
def mapping_tables(spark, sf_dir):
    """Transforms as JSON by labels, then as rows of a CSV file, both read again."""
    t = tile_rows(spark, sf_dir)
    labels = t.select("tile_id", F.format_string("tile%05d", "tile_id").alias("label"))
    m = t.select("tile_id", affine.rotation((F.col("tile_id") % 90).cast("double"), (F.col("tile_id") % 7).cast("double"), F.lit(-1.0)).alias("matrix"))
    path = shared(spark, "mappings")
    files.write_json(files.mapping_json(m, labels), f"{path}/json")
    back = files.mappings_from_json(files.read_json(spark, f"{path}/json", "label string, mapping array<array<double>>"), labels)
    files.write_csv(files.mapping_rows(back.join(labels, "tile_id"), t, 0.032), f"{path}/table.csv")
    got = files.read_metadata(spark, "table.csv", ["id", "x_pixels", "y_pixels", "z_pixels", "x", "y", "z", "rotation"], f"{path}/other.json")
    return rounded(got, "x_pixels", "y_pixels", "z_pixels", "x", "y", "rotation")


@query(f"WITH {EDGES} SELECT printf('tile%05d', i) AS first, printf('tile%05d', j) AS second, quality AS value FROM edges WHERE quality <> 0")
def metric_files(spark, sf_dir):
    """Metrics of pairs as JSON, read again."""
    edges, labels = _edges(spark, sf_dir)
    both = edges.select("i", "j", F.explode(F.array(*(F.struct(F.lit(float(k)).alias("a"), F.lit(float(k * k)).alias("b")) for k in range(3)))).alias("v")).select("i", "j", "v.a", "v.b")
    rows = metrics.by_key({"registered": both}, ["ncc"], qualities=edges.select(F.lit("registered").alias("transform_key"), "i", "j", "quality"))
    path = shared(spark, "metrics")
    files.write_json(files.metric_json(rows, labels), path)
    got = files.read_json(spark, path, "first string, second string, metrics map<string, double>")
    return got.select("first", "second", F.element_at("metrics", "quality").alias("value")).where("value IS NOT NULL")


@query(f"SELECT s_suppkey AS n, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal ELSE CASE WHEN s_suppkey % 4 = 1 THEN s_suppkey * 1.5 END END::DOUBLE AS x, 'slice' || lpad(s_suppkey::VARCHAR, 5, '0') AS label FROM supplier")
def source_overrides(spark, sf_dir):
    """Metadata for files by their label, else by their place, with labels as slices."""
    from weftwork.functions import text

    s = table(spark, sf_dir, "supplier")
    own = s.select(text.slice_label(F.col("s_suppkey")).alias("label"), F.col("s_suppkey").alias("n"))
    none = F.lit(None)
    known = s.where("s_suppkey % 2 = 0").select(text.slice_label(F.col("s_suppkey")).alias("label"), none.cast("long").alias("n"), F.col("s_acctbal").alias("x"))
    known = known.unionByName(s.where("s_suppkey % 4 <= 1").select(none.cast("string").alias("label"), F.col("s_suppkey").alias("n"), (F.col("s_suppkey") * 1.5).alias("x")))
    return files.with_metadata(own, known).select("n", "x", "label")


_SCENE = "t AS (SELECT r * 3 + c AS tile_id, r, c, (r * 7 + c * 3) % 5 - 2 AS ox, (r * 5 + c * 11) % 5 - 2 AS oy FROM (SELECT unnest(generate_series(0, (SELECT greatest(ceil((max(vec_id) + 1 - 32) / 20.0), 0)::BIGINT FROM embeddings))) AS r), (SELECT unnest([0, 1, 2]) AS c)), p AS (SELECT a.tile_id AS i, b.tile_id AS j, a.ox - b.ox AS dx, a.oy - b.oy AS dy FROM t a JOIN t b ON a.tile_id < b.tile_id AND a.r = b.r AND b.c = a.c + 1)"


def _across(spark, sf_dir, method: str, **options) -> DataFrame:
    images = scene_tiles(spark, sf_dir)
    near = images.select(F.col("tile_id").alias("i"), (F.col("tile_id") + 1).alias("j")).where("i % 3 <> 2")
    found = stitch.register(images, near, method, **options)
    return found.select("i", "j", F.round(F.col("matrix")[2] / 0.5).cast("long").alias("dx"), F.round(F.col("matrix")[5] / 0.5).cast("long").alias("dy"))


@query(f"WITH {_SCENE} SELECT i, j, dx, dy FROM p")
def feature_registration(spark, sf_dir):
    """Shifts, in whole pixels, between tiles side by side, by corners and their surroundings."""
    return _across(spark, sf_dir, "features", margin=32, kind="translation", sigma=0.8, blur=0.5)


@query("SELECT label AS tile_id, unnest([1, 2]) AS n, 6.0 AS z, (5.0 + label % 3)::DOUBLE AS y, CASE WHEN unnest([1, 2]) = 1 THEN 5.0 ELSE 19.0 - label % 2 END::DOUBLE AS x FROM (SELECT DISTINCT label FROM embeddings)".replace("6.0 AS z", "6.0::DOUBLE AS z"))
def volume_blobs(spark, sf_dir):
    """Centers of bright balls in volumes, by the Laplacian of Gaussians."""
    import numpy as np
    import pandas as pd

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        k = int(key[0])
        z, y, x = np.indices((13, 14, 25))
        volume = np.zeros(z.shape)
        for at in ((6, 5 + k % 3, 5), (6, 5 + k % 3, 19 - k % 2)):
            volume[np.sqrt((z - at[0]) ** 2 + (y - at[1]) ** 2 + (x - at[2]) ** 2) <= 2] = 1.0
        found = kernels.volume_points(volume, 1, 3, 5, 0.2)
        found = found[np.argsort(found[:, 2])]
        return pd.DataFrame({"tile_id": k, "n": np.arange(1, len(found) + 1), "z": found[:, 0], "y": found[:, 1], "x": found[:, 2]})

    labels = table(spark, sf_dir, "embeddings").select("label").distinct()
    return labels.groupBy("label").applyInPandas(run, "tile_id int, n int, z double, y double, x double")


@query("SELECT s_nationkey AS shape, 6.0::DOUBLE AS volume, 8 AS corners, 17 AS path FROM (SELECT DISTINCT s_nationkey FROM supplier)")
def boxes_3d(spark, sf_dir):
    """Least boxes around the corners of turned blocks of 1 by 2 by 3, and the path along their edges."""
    import numpy as np
    import pandas as pd

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        a, b = np.radians(10.0 + key[0]), np.radians(25.0)
        turn = np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]]) @ np.array([[1, 0, 0], [0, np.cos(b), -np.sin(b)], [0, np.sin(b), np.cos(b)]])
        cloud = np.array([[x, y, z] for x in (0, 1.0) for y in (0, 2.0) for z in (0, 3.0)]) @ turn.T + key[0]
        box = kernels.oriented_box_3d(cloud)
        sides = [np.linalg.norm(box[0] - box[k]) for k in (1, 3, 4)]
        near = sum(np.linalg.norm(cloud - c, axis=1).min() < 1e-6 for c in box)
        return pd.DataFrame({"shape": [key[0]], "volume": [round(float(np.prod(sides)), 6)], "corners": [near], "path": [len(kernels.box_edges(box))]})

    shapes = table(spark, sf_dir, "supplier").select("s_nationkey").distinct()
    return shapes.groupBy("s_nationkey").applyInPandas(run, "shape int, volume double, corners int, path int")
