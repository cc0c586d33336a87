import numpy as np
import pytest
from pyspark.sql import functions as F

from weftwork.functions import affine, dims, text, units
from weftwork.operators import graph, kernels, matching, pixels, tiles
from weftwork.sources import chunks, ngff


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("a, ta, b, tb, angle, shift", [(10, (1, 2), 35, (4, 6), 25, (2.25983055, 4.46017555)), (0, (0, 0), 0, (3, 4), 0, (3, 4))])
def test_rigid_difference(spark, a, ta, b, tb, angle, shift):
    # rotations are stored so that the golden pair comes out with the inverse rotation of its stored form
    m1, m2 = (affine.rotation(F.lit(float(-g)), F.lit(float(t[0])), F.lit(float(t[1]))) for g, t in ((a, ta), (b, tb)))
    got = one(spark, affine.difference(m1, m2))
    assert np.degrees(np.arctan2(got[3], got[0])) == pytest.approx(-angle)
    c, s = np.cos(np.radians(a)), np.sin(np.radians(a))
    assert (got[2], got[5]) == pytest.approx((c * (tb[0] - ta[0]) - s * (tb[1] - ta[1]), s * (tb[0] - ta[0]) + c * (tb[1] - ta[1])))


def test_inverse_gives_identity(spark):
    m = affine.about(F.lit(33.0), F.lit(2.0), F.lit(-5.0))
    assert one(spark, affine.product(m, affine.inverse(m))) == pytest.approx(list(affine.IDENTITY), abs=1e-12)
    assert one(spark, affine.center(m)) == pytest.approx([2, -5])
    assert one(spark, affine.wrapped(F.lit(180.0))) == 180 and one(spark, affine.wrapped(F.lit(190.0))) == -170
    assert one(spark, affine.valid(affine.identity())) and not one(spark, affine.valid(F.array(*[F.lit(0.0)] * 9)))


def test_text(spark):
    assert one(spark, text.file_title(F.lit("a/b/some.ome.tif"))) == "some"
    assert one(spark, text.numbers(F.lit("S001_02-3"))) == [1, 2, 3]
    assert one(spark, text.target_number(F.lit("x/L12_a"), "L")) == 12 and one(spark, text.target_number(F.lit("x"), "L")) is None
    assert one(spark, text.labelled_numbers(F.lit("S001_7_c3"))) == ["1=7", "S=001", "c=3"]
    assert one(spark, text.significant(F.lit(1234.5), 2)) == 1200
    assert one(spark, units.rgba_int(units.rgba(F.lit(-16776961)))) == -16776961
    with pytest.raises(ValueError):
        text.arithmetic("__import__('os')", {"x"})


def test_fixed_decimals(spark):
    """As C prints: exact values, ties to even; units up to the largest."""
    xs = [k / 1024 for k in range(0, 9000, 7)] + [k / 20 for k in range(999)] + [k / 7 for k in range(51)] + [0.0005, 2.675, 0.25, 0.75, 0.9996, -0.25, -0.04, -0.0, 123456789012345.67, 2.0**52 + 0.5, 1e15 + 0.125, float("nan"), float("inf"), float("-inf")]
    for row in spark.createDataFrame([(x,) for x in xs], "x double").select("x", *(text.fixed(F.col("x"), d).alias(f"d{d}") for d in (0, 1, 3))).collect():
        assert tuple(row[1:]) == tuple(f"{row.x:.{d}f}" for d in (0, 1, 3))
    assert one(spark, text.fixed(F.lit(None).cast("double"), 1)) is None
    assert one(spark, text.human_bytes(F.lit(5376))) == "5.2KB" and one(spark, text.human_bytes(F.lit(3 << 30))) == "3.0GB" and one(spark, text.human_bytes(F.lit(3 << 30), "MB")) == "3072.0MB"
    assert one(spark, dims.shown(F.create_map(F.lit("b"), F.lit(0.0625), F.lit("a"), F.lit(0.1875)))) == "a: 0.188 b: 0.062"


def test_grid_pairs_equal_nested_loop(spark):
    r = np.random.default_rng(3)
    at = [(i, float(x), float(y), float(z), 25.6, 25.6) for i, (x, y, z) in enumerate(np.c_[r.uniform(-200, 200, (150, 2)), r.integers(0, 3, 150)])]
    df = spark.createDataFrame(at, "tile_id long, x double, y double, z double, sx double, sy double")
    got = {(p.i, p.j) for p in tiles.pairs(df).collect()}
    assert got == {(a[0], b[0]) for a in at for b in at if a[0] < b[0] and np.linalg.norm(np.subtract(a[1:4], b[1:4])) < 25.6}
    assert tiles.pairs(df.limit(0)).collect() == []


def test_fixture_grid(spark):
    rows = [(k, 24.0 * (k % 2), 24.0 * (k // 2 % 2), 0.1 * (k // 4), 25.6, 25.6) for k in range(8)]
    df = spark.createDataFrame(rows, "tile_id long, x double, y double, z double, sx double, sy double")
    assert tiles.pairs(df.where("z = 0")).count() == 4
    assert tiles.pairs(df, mixed_z=True).count() == 12


def test_ngff_metadata(spark, tmp_path):
    for name, y in (("S000_000_000", 0.0), ("S000_001_000", 24.0)):
        folder = tmp_path / f"{name}.ome.zarr"
        folder.mkdir()
        ngff.write_metadata(spark, str(folder), ngff.metadata("tczyx", {"x": 0.032, "y": 0.032}, 3, 2.0, {"y": y}))
    levels = ngff.levels(spark, str(tmp_path))
    assert levels.count() == 30
    second = levels.where("axis = 'y' AND level = 1 AND label = 'S000_001_000'").first()
    assert second.scale == pytest.approx(0.064) and second.translation == pytest.approx(24.016)
    assert {r.label: r.y for r in ngff.positions(levels).collect()} == {"S000_000_000": 0.0, "S000_001_000": 24.0}


def test_assignment():
    fixed, moving = np.array([[0, 0], [0, 10], [10, 0.0]]), np.array([[11, 2], [1, 2], [1, 12.0]])
    found = matching.assignment(fixed + [1, 2], moving, 5.0)
    assert {(a, b) for a, b, _, ok in found if ok} == {(0, 1), (1, 2), (2, 0)}
    assert matching.assignment(fixed, np.zeros((0, 2)), 1.0) == []


def test_assignment_of_many_points():
    """Some rows at a time: the same as over all distances, in memory that doesn't grow with pairs."""
    import tracemalloc

    rng = np.random.default_rng(4)
    fixed, moving = rng.integers(0, 9, (700, 8)).astype(float), rng.integers(0, 9, (900, 8)).astype(float)  # with ties
    distances, taken, wanted = np.sqrt(((fixed[:, None] - moving[None]) ** 2).sum(axis=2)), set(), []
    for i in sorted(range(700), key=lambda i: (distances[i].min(), i)):
        free = sorted((d, j) for j, d in enumerate(distances[i].tolist()) if j not in taken)
        ok = free[0][0] < 5 and free[0][0] < 0.98 * free[1][0]
        wanted.append((i, free[0][1], free[0][0], ok))
        taken |= {free[0][1]} if ok else set()
    tracemalloc.start()
    assert matching.assignment(fixed, moving, 5.0, 0.98) == wanted
    assert tracemalloc.get_traced_memory()[1] < 15_000_000  # all differences are 40 MB
    tracemalloc.stop()


def test_phase_correlation_recovers_shift():
    image = kernels.gaussian(np.random.default_rng(1).random((64, 64)), 1.5)
    for dy, dx in ((3, -5), (0, 0), (-7, 2)):
        got = kernels.phase_correlation(np.roll(image, (dy, dx), (0, 1)), image)
        assert got[:2] == pytest.approx((dy, dx), abs=0.5) and got[2] > 0.9


def test_points_and_boxes():
    r = np.random.default_rng(5)
    points = r.random((30, 2)) * 20
    c, s = np.cos(0.2), np.sin(0.2)
    fixed = points @ np.array([[c, -s], [s, c]]).T + [1, 2]
    t = kernels.cpd(fixed, points)
    assert points @ t[:2, :2].T + t[:2, 2] == pytest.approx(fixed, abs=0.05)
    assert kernels.cpd(fixed[:1], points) is None
    fit, inliers = kernels.ransac(np.r_[fixed, r.random((5, 2)) * 90], np.r_[points, r.random((5, 2)) * 90], 0.1)
    assert inliers[:30].all() and fit == pytest.approx(kernels.similarity_fit(fixed, points), abs=0.01)
    box = kernels.oriented_box(np.array([[0, 0], [2, 2], [1, 3], [-1, 1], [0.5, 1.5]]))
    assert sorted(map(tuple, np.round(box, 6))) == [(-1, 1), (0, 0), (1, 3), (2, 2)]
    image = np.zeros((32, 48))
    image[4:8, 5:9], image[20:24, 30:34] = 255, 255
    assert sorted(map(tuple, kernels.area_points(image))) == [(5.5, 6.5), (21.5, 31.5)]
    assert kernels.frc(image, image)[:5] == pytest.approx(1)


def test_drift_of_many_points():
    """A round cloud, in which single steps are small: turn, scale and shift come out whole."""
    points = np.random.default_rng(2).normal(0, 0.125, (500, 2))
    c, s = np.cos(np.radians(10)), np.sin(np.radians(10))
    t = kernels.cpd(points @ np.array([[c, -s], [s, c]]).T + (2, -1), points)
    assert t.ravel() == pytest.approx([c, -s, 2, s, c, -1, 0, 0, 1], abs=1e-4)


def test_gauss_sums(monkeypatch):
    """Polynomials, grids and near pairs give what all pairs give, with a point far out and on lines."""
    r = np.random.default_rng(3)
    at, to = np.vstack((r.normal(0, 0.125, (1500, 2)), [[1.5, -1]])), r.normal(0.1, 0.125, (1300, 2))
    weights = np.column_stack((np.ones(1501), r.normal(0, 1, (1501, 2))))
    used, grid, polynomials = set(), kernels._by_grid, kernels._by_polynomials
    monkeypatch.setattr(kernels, "_by_grid", lambda *a: used.add("grid") or grid(*a))
    monkeypatch.setattr(kernels, "_by_polynomials", lambda *a: used.add("polynomials") or polynomials(*a))
    for spread, way in ((0.1, {"polynomials"}), (3e-3, {"grid"}), (1e-6, set())):
        for a, t in ((at, to), (at * [1, 0], to * [1, 0]), (at, to[:1])):
            wanted = np.exp(((t[:, None] - a) ** 2).sum(axis=2) * (-0.5 / spread)) @ weights
            used.clear()
            assert kernels.gauss_sums(a, weights, t, spread) == pytest.approx(wanted, abs=1e-8)
            if t.size > 2 and t[0, 1]:
                assert used == way


def test_drift_deals_groups_to_tasks(spark):
    """Each group of a small table is one task's, and a large set comes out as small ones do."""
    points = np.random.default_rng(4).normal(0, [0.1, 0.15], (2700, 2))
    rows_ = [(int(k > 2400) * (1 + k % 5), float(x), float(y)) for k, (x, y) in enumerate(points)]
    found = kernels.drifted(spark.createDataFrame(rows_, "label int, x double, y double"), "label", 10.0, (2.0, -1.0)).select("label", "m", F.spark_partition_id().alias("task")).collect()
    assert sorted(r.label for r in found) == list(range(6)) and len({r.task for r in found}) == 6
    c, s = np.cos(np.radians(10)), np.sin(np.radians(10))
    for r in found:
        assert r.m == pytest.approx([c, -s, 2, s, c, -1, 0, 0, 1], abs=1e-4)


def test_single_tile_fuses_to_itself(spark):
    px = spark.createDataFrame([(1, 0, y, x, float(y * x)) for y in range(3) for x in range(3)], "tile_id long, z int, y int, x int, value double")
    for how in ("mean", "sum", "max", "exclusive"):
        assert {(r.y, r.x): r.value for r in pixels.fused(px, how).collect()} == {(y, x): y * x for y in range(3) for x in range(3)}


def test_arrivals(spark, tmp_path):
    from weftwork.streaming.arrivals import pair_arrivals

    schema = "tile_id long, x double, y double, z double, sx double, sy double"
    for batch in range(2):
        spark.createDataFrame([(2 * batch + k, 20.0 * (2 * batch + k), 0.0, 0.0, 25.6, 25.6) for k in range(2)], schema).write.mode("append").parquet(f"{tmp_path}/in")
        query = pair_arrivals(spark, spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/known", f"{tmp_path}/edges", f"{tmp_path}/check")
        query.awaitTermination()
    assert sorted((e.i, e.j) for e in spark.read.parquet(f"{tmp_path}/edges").collect()) == [(0, 1), (1, 2), (2, 3)]


@pytest.mark.parametrize("codec", ["zstd", "gzip", ""])
def test_zarr_chunks(spark, tmp_path, codec):
    image = np.random.default_rng(2).integers(0, 60_000, (2, 10, 7)).astype(float)
    name = f"file://{tmp_path}/tile.ome.zarr/0"
    at = [(name, *map(int, p), float(image[p])) for p in np.ndindex(image.shape)]
    more = [at[0], (name, 0, 10, 0, 1.0), (name, 0, -1, 0, 1.0), (name, 1, 1, 1, None)]  # repeated, outside, null
    df = spark.createDataFrame([*at, *more], "array string, z long, y long, x long, value double").withColumn("chunk_z", F.lit("clash"))
    chunks.save(spark, chunks.encoded(df, [2, 10, 7], [1, 4, 4], "uint16", codec), [2, 10, 7], [1, 4, 4], "uint16", codec)
    stored = chunks.chunks(spark, str(tmp_path), level=0)
    assert stored.count() == 2 * 3 * 2 and chunks.chunks(spark, str(tmp_path), level=1).count() == 0
    got = chunks.pixels(stored).collect()
    assert {(p.z, p.y, p.x): p.value for p in got} == {p[1:4]: p[4] for p in at} and len(got) == image.size
    assert {(p.t, p.c) for p in got} == {(0, 0)}
    assert chunks.encoded(df.where("false"), [2, 10, 7], [1, 4, 4], "uint16").count() == 0


def test_zarr_codecs():
    block = np.arange(6, dtype=">i4").tobytes()
    assert chunks._decoded(block + chunks.crc32c(block).to_bytes(4, "little"), ["bytes:big", "crc32c"]) == (block, ">")
    with pytest.raises(ValueError):
        chunks._decoded(block + b"none", ["bytes:big", "crc32c"])
    with pytest.raises(ValueError):
        chunks._decoded(block, ["bytes:little", "blosc"])


def test_translations_of_many_tiles(spark, monkeypatch):
    r = np.random.default_rng(4)
    tiles_ = spark.range(23).select(F.col("id").alias("tile_id"))  # two parts and a tile without edges
    links = [(i, j) for part in (range(12), range(12, 22)) for i in part for j in part if i < j and (j == i + 1 or r.random() < 0.2)]
    made = [(i, j, [1.0, 0.0, float(r.normal()), 0.0, 1.0, float(r.normal())], float(r.random()) if j == i + 1 else float(r.integers(0, 2))) for i, j in links]
    edges = spark.createDataFrame(made, "i long, j long, matrix array<double>, quality double")
    whole = {x.tile_id: (x.dx, x.dy) for x in graph.translations(edges, tiles_).collect()}
    monkeypatch.setattr(graph, "SOLVE_TILES", 5)
    found = {x.tile_id: (x.dx, x.dy) for x in graph.translations(edges, tiles_).collect()}
    assert found.keys() == whole.keys() and all(found[k] == pytest.approx(whole[k], abs=1e-9) for k in whole)


def test_graph_rounds_keep_small_estimates(spark):
    """A chain takes several rounds, whose plans must not multiply the estimates of the rounds before; hops end where asked."""
    tiles_ = spark.range(60).select(F.col("id").alias("tile_id"))
    edges = tiles_.where("tile_id < 59").select(F.col("tile_id").alias("i"), (F.col("tile_id") + 1).alias("j"), affine.identity().alias("matrix"), F.lit(1.0).alias("quality"))
    found = graph.components(edges, tiles_)
    assert int(str(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())).bit_length() < 40
    assert {r.component for r in found.collect()} == {0} and found.count() == 60
    assert sorted((r.tile_id, r.hops) for r in graph.shortest_paths(edges, tiles_, most=5).collect()) == [(k, k) for k in range(6)]


def test_hops_of_long_ways(spark, monkeypatch):
    """A chain of 90 tiles, cut into blocks that it crosses up and down, a ring, and tiles without edges."""
    chain = [*range(44, -1, -2), *range(1, 90, 2), *range(88, 44, -2)]
    links = [*zip(chain, chain[1:]), *((100 + k, 100 + (k + 1) % 7) for k in range(7)), (100, 100)]
    edges = spark.createDataFrame([(i, j, [1.0, 0.0, float(i + 1), 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], 1.0) for i, j in links], "i long, j long, matrix array<double>, quality double")
    tiles_ = spark.range(110).select(F.col("id").alias("tile_id"))
    wanted = {t: abs(k - chain.index(0)) for k, t in enumerate(chain)} | {100 + k: min(k, 7 - k) for k in range(7)} | dict.fromkeys([*range(90, 100), 107, 108, 109], 0)
    for rows_ in (1 << 18, 100):
        monkeypatch.setattr(graph, "WALK_ROWS", rows_)
        assert dict(graph.hops(edges, tiles_).collect()) == wanted
    found = {x.tile_id: (x.hops, x.matrix) for x in graph.shortest_paths(edges, tiles_).collect()}
    assert {t: h for t, (h, _) in found.items()} == wanted
    at = chain.index(0)
    assert found[chain[-1]][1][2] == sum(i + 1 for i in chain[at:-1]) and found[chain[0]][1][2] == -sum(i + 1 for i in chain[:at])
    assert {x.tile_id: x.hops for x in graph.hops(edges, tiles_, 103).collect()} == {100 + k: abs(k - 3) for k in range(7)}
    assert {x.tile_id: x.hops for x in graph.hops(edges.limit(0), tiles_).collect()} == dict.fromkeys(range(110), 0)


def test_overlaps_of_far_tiles(spark):
    at = [(0, 0.0, 0.0, 1.0), (1, 0.6, 0.0, 1.0), (2, 9.9, 9.9, 1.0), (3, 13.9, 13.9, 1.0), (4, 9.9, 14.1, 1.0), (5, 200.0, -80.0, 1.0), (6, 100.0, 3.0, 1.5)]
    df = spark.createDataFrame([(i, x, y, 0.0, s, s) for i, x, y, s in at], "tile_id long, x double, y double, z double, sx double, sy double")
    got = {r.tile_id: r for r in tiles.overlaps(df).collect()}
    for i, x, y, s in at:
        least = min(np.hypot(x + s / 2 - u - t / 2, y + s / 2 - v - t / 2) / ((s + t) / 2 * np.sqrt(2)) for j, u, v, t in at if j != i)
        assert got[i].nearest == pytest.approx(least) and got[i].has_overlap == (least < 1) and got[i].large == (least <= 0.5)
    alone = tiles.overlaps(df.where("tile_id = 5")).collect()
    assert [(r.nearest, r.has_overlap) for r in alone] == [(None, False)]
