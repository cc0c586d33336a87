"""Stitching and the staged job: known scenes cut into tiles and put together again."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftwork.operators import kernels, stitch, tiles
from weftwork.plans.registration import Config, Job, State, run
from weftwork.sources import files

PX = 0.5
IMAGE = "tile_id long, x double, y double, z double, px double, py double, image array<array<double>>"


def cut(spark, scene, places, off, z=0.0, first=0, side=40):
    """Tile and pixel rows of places (row, column) of a scene, their positions off by whole pixels."""
    tile = [(first + k, (c + off[k][1]) * PX, (r + off[k][0]) * PX, z, side * PX, side * PX) for k, (r, c) in enumerate(places)]
    px = [(first + k, int(z), y, x, float(scene[r + y, c + x])) for k, (r, c) in enumerate(places) for y in range(side) for x in range(side)]
    return spark.createDataFrame(tile, "tile_id long, x double, y double, z double, sx double, sy double"), spark.createDataFrame(px, "tile_id long, z int, y int, x int, value double")


PLACES, OFF = [(0, 0), (0, 28), (28, 0), (28, 28)], [(0, 0), (1, -2), (-2, 1), (2, 2)]


@pytest.fixture(scope="module")
def scene():
    return kernels.gaussian(np.random.default_rng(2).random((68, 68)), 0.7)


def test_job_stitches(spark, tmp_path, scene):
    tile, pixel = cut(spark, scene, PLACES, OFF)
    job = Job(spark, tile, pixel, Config.of({"registration": {"method": "peaks"}, "fusion": "mean"}), str(tmp_path))
    assert job.state() == State.NEW and job.is_initialised() and not job.is_pairs_registered()
    got = {t.tile_id: (t.matrix[5] / PX, t.matrix[2] / PX) for t in job.register_global().collect()}
    for k, (dy, dx) in enumerate(OFF):
        assert got[k] == pytest.approx((-dy, -dx), abs=0.3)
    assert job.state() == State.GLOBAL and not job.is_fused()
    fused = {(p.y, p.x): p.value for p in stitch.chunk_pixels(job.fuse()).collect()}
    assert job.is_fused() and (tmp_path / job.folder().rsplit("/", 1)[1] / "fused").exists()
    inner = [(y, x) for y in range(5, 60) for x in range(5, 60)]
    assert np.mean([abs(fused[p] - scene[p]) for p in inner]) < 0.05 * scene.std()
    by = {(m.transform_key, m.metric): m.value for m in job.metrics().where("i IS NULL").collect()}
    assert by["registered", "ncc"] > 0.95 > 0.6 > by["source_metadata", "ncc"] and by["registered", "quality"] > 0.9
    labels = tile.select("tile_id", F.format_string("t%02d", "tile_id").alias("label"))
    job.save(labels, PX)
    back = files.edges_from_json(files.read_json(spark, f"{job.folder()}/pair_mappings"), labels)
    assert sorted((e.i, e.j, [round(v, 9) for v in e.matrix]) for e in back.collect()) == sorted((e.i, e.j, [round(v, 9) for v in e.matrix]) for e in job.register_pairs().collect())
    table = {r.id: r for r in files.read_csv(spark, f"{job.folder()}/mappings_csv").collect()}
    assert (table["t03"].y_pixels, table["t03"].x_pixels) == pytest.approx((28, 28), abs=0.3)
    assert "ncc" in files.read_json(spark, f"{job.folder()}/metrics", "first string, second string, metrics map<string, double>").first().metrics
    assert files.mappings_from_json(files.read_json(spark, f"{job.folder()}/mappings"), labels).count() == 4
    again = Job(spark, tile, pixel, job.config, str(tmp_path))
    assert again.is_fused()
    assert not Job(spark, tile.where("tile_id < 3"), pixel.where("tile_id < 3"), job.config, str(tmp_path)).is_pairs_registered()  # other inputs
    again.reset()
    assert job.state() == State.NEW
    assert run({"good": job, "bad": Job(spark, tile, pixel.drop("value"), Config(fusion="sum"))}, workers=2)["good"] == "done"
    with pytest.raises(ValueError):
        Config.of({"unheard": 1})


def test_planes_are_stitched_apart(spark, scene):
    parts = [cut(spark, scene if z == 0 else scene[::-1], PLACES, OFF, float(z), 4 * z) for z in range(2)]
    job = Job(spark, parts[0][0].union(parts[1][0]), parts[0][1].union(parts[1][1]), Config(method="peaks", quality_threshold=0.9, output_spacing="min"))  # planes that show other things don't correlate
    got = stitch.chunk_pixels(job.fuse())
    by = {(p.z, p.y, p.x): p.value for p in got.where("y BETWEEN 10 AND 12 AND x BETWEEN 5 AND 60").collect()}
    assert {z for z, *_ in by} == {0.0, 1.0}
    for z in range(2):
        own = scene if z == 0 else scene[::-1]
        assert np.mean([abs(v - own[y, x]) for (k, y, x), v in by.items() if k == z]) < 0.1 * own.std()


def test_preprocessing_and_preview(spark, scene):
    tile, pixel = cut(spark, scene, PLACES, [(0, 0)] * 4)
    job = Job(spark, tile, pixel, Config(method="peaks", normalisation="global", gaussian_sigma=0.6, flatfield_quantiles=(0.05, 0.95), overlap_threshold=0.1))
    assert job.config.preprocesses() and not Config(normalisation="none").preprocesses() and Config(scale=2).preprocesses() and not Config(scale=1).preprocesses()
    assert job.preprocess().agg(F.min("value"), F.max("value")).first() != (None, None)
    small = {(p.y, p.x): p.value for p in Job(spark, tile, pixel, Config(method="peaks")).preview(4).collect()}
    means = scene.reshape(17, 4, 17, 4).mean(axis=(1, 3))
    assert set(small) == {(y, x) for y in range(17) for x in range(17)}
    assert np.mean([abs(small[p] - means[p]) for p in small]) < 0.05
    frames = Job(spark, tile, pixel, Config()).frames(3, 1.2, 1.0)
    assert {f.frame for f in frames.select("frame").distinct().collect()} == {0, 1, 2}
    assert frames.agg(F.min("value")).first()[0] >= 0 and frames.agg(F.max("value")).first()[0] <= 1


@pytest.mark.parametrize("kind", ["rigid", "similarity"])
def test_turns_and_shifts_are_solved(spark, kind):
    r = np.random.default_rng(7)
    n, size = 9, [1.0] * 9 if kind == "rigid" else [1, 1.1, 0.95, 1.05, 1, 1.2, 0.9, 1, 1.0]
    true = []
    for k in range(n):
        a, t = (0.0, np.zeros(2)) if k == 0 else (r.uniform(-1, 1), r.normal(size=2) * 9)
        true.append(np.array([[size[k] * np.cos(a), -size[k] * np.sin(a), t[0]], [size[k] * np.sin(a), size[k] * np.cos(a), t[1]], [0, 0, 1.0]]))
    links = [(i, j) for i in range(n) for j in range(i + 1, n) if j == i + 1 or r.random() < 0.4]
    edges = spark.createDataFrame([(i, j, (np.linalg.inv(true[i]) @ true[j]).ravel().tolist(), float(r.uniform(0.3, 1))) for i, j in links], "i long, j long, matrix array<double>, quality double")
    got = {t.tile_id: np.array(t.matrix).reshape(3, 3) for t in stitch.resolve(edges, spark.range(n + 1).withColumnRenamed("id", "tile_id"), kind).collect()}
    for k in range(n):
        assert got[k] == pytest.approx(true[k], abs=1e-6)
    assert got[n] == pytest.approx(np.eye(3))
    shifts = {t.tile_id: np.array(t.matrix) for t in stitch.resolve(edges.limit(0), spark.range(2).withColumnRenamed("id", "tile_id"), kind).collect()}
    assert shifts[1] == pytest.approx(np.eye(3).ravel())


def test_a_turned_tile_is_resampled(spark, scene):
    angle = np.radians(20)
    m = np.array([[np.cos(angle), -np.sin(angle), 12.0], [np.sin(angle), np.cos(angle), -3.0], [0, 0, 1]])
    y, x = np.mgrid[0:30, 0:40]
    image = 2.0 * x + 3.0 * y  # a plane stays one under bilinear sampling
    rows = spark.createDataFrame([(0, 5.0, 7.0, 0.0, PX, PX, image.tolist())], IMAGE)
    transforms = spark.createDataFrame([(0, m.ravel().tolist())], "tile_id long, matrix array<double>")
    grid = stitch.output_grid(rows, transforms)
    got = stitch.chunk_pixels(stitch.fused(stitch.views(rows, transforms, grid, 16), grid, "mean", 16), 16).collect()
    back = np.linalg.inv(m)
    assert len(got) > 0.9 * image.size
    for p in got[::37]:
        u, v, _ = back @ [grid[0] + p.x * grid[2], grid[1] + p.y * grid[3], 1]
        assert p.value == pytest.approx(2 * (u - 5) / PX + 3 * (v - 7) / PX, abs=1e-6)


def test_fusions(spark):
    image = lambda v: [[v] * 3, [v, None if v > 1 else v, v]]
    rows = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1.0, 1.0, image(1.0)), (1, 1.0, 0.0, 0.0, 1.0, 1.0, image(5.0))], IMAGE)
    still = spark.createDataFrame([(k, np.eye(3).ravel().tolist()) for k in range(2)], "tile_id long, matrix array<double>")
    grid = stitch.output_grid(rows, still)
    assert grid == (0.0, 0.0, 1.0, 1.0, 4, 2)
    for how, middle in (("mean", 3.0), ("", 3.0), ("additive", 3.0), ("sum", 6.0), ("max", 5.0), ("exclusive", 5.0)):
        got = {(p.y, p.x): p.value for p in stitch.chunk_pixels(stitch.fused(stitch.views(rows, still, grid), grid, how)).collect()}
        assert got[0, 0] == 1 and got[0, 1] == middle and got[0, 3] == 5 and got[1, 2] == 1.0
    capped = stitch.chunk_pixels(stitch.fused(stitch.views(rows, still, grid), grid, "sum", most=4.0))
    assert capped.agg(F.max("value")).first()[0] == 4


def test_overlap_crops(spark):
    rows = [(0, 0.0, 0.0, 0.0, 1.0, 1.0, np.arange(20.0).reshape(4, 5).tolist()), (1, 3.0, 1.0, 0.0, 1.0, 1.0, np.arange(20.0).reshape(4, 5).tolist()), (2, 50.0, 0.0, 0.0, 1.0, 1.0, [[1.0]])]
    image = spark.createDataFrame(rows, IMAGE)
    pairs = spark.createDataFrame([(0, 1), (0, 2)], "i long, j long")
    got = stitch.crops(image, pairs).collect()
    assert [(c.i, c.j) for c in got] == [(0, 1)]
    assert got[0].i_crop == [[8.0, 9.0], [13.0, 14.0], [18.0, 19.0]] and got[0].j_crop == [[0.0, 1.0], [5.0, 6.0], [10.0, 11.0]]
    assert (got[0].i_x, got[0].i_y, got[0].j_x) == (3.0, 1.0, 3.0)
    found = {(e.i, e.j): e for e in stitch.register(image, pairs, "dummy").collect()}
    assert found[0, 1].quality == 1.0 and stitch.register(image, pairs.limit(0)).count() == 0
    assert tiles.pairs(stitch.boxes(image)).count() == 1


@pytest.mark.parametrize("dy, dx", [(0, 0), (3, -4), (-6, 2), (9, 7)])
def test_shift_by_peaks(scene, dy, dx):
    fixed, moving = scene[10:50, 10:50], scene[10 + dy : 50 + dy, 10 + dx : 50 + dx]
    got = kernels.shift_by_peaks(fixed, moving)
    assert got[:2] == pytest.approx((dy, dx), abs=0.3) and got[2] > 0.9
    assert kernels.shift_by_peaks(fixed, moving, subpixel=False)[:2] == (dy, dx)
    assert kernels.shift_by_peaks(np.ones((8, 8)), np.ones((8, 8))) == (0.0, 0.0, 0.0)
