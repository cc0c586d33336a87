"""Registered queries of transforms, points and positions; and the equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftwork.catalog import query, rounded
from weftwork.functions import affine
from weftwork.operators import geometry, transforms
from weftwork.sources.fixtures import table, tiles


def _part(spark, sf_dir):
    """(k, g, cx, cy, tx, ty): angles, centers and shifts."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("k"), F.col("p_size").cast("double").alias("g"), (F.col("p_partkey") % 11).cast("double").alias("cx"), (F.col("p_partkey") % 5).cast("double").alias("cy"), (F.col("p_partkey") % 13).cast("double").alias("tx"), (F.col("p_partkey") % 7).cast("double").alias("ty"))


PART = "p AS (SELECT p_partkey AS k, radians(p_size::DOUBLE) AS g, (p_partkey % 11)::DOUBLE AS cx, (p_partkey % 5)::DOUBLE AS cy, (p_partkey % 13)::DOUBLE AS tx, (p_partkey % 7)::DOUBLE AS ty FROM part), q AS (SELECT *, cos(g) AS c, sin(g) AS s FROM p)"


def _r(**columns):
    return ", ".join(f"round({v}, 6) + 0.0::DOUBLE AS {k}" for k, v in columns.items())


@query(f"""WITH {PART} SELECT k, {_r(a='1.5 * c', b='1.5 * s', sx='(1 - 1.5 * c) * cx - 1.5 * s * cy + tx', sy='1.5 * s * cx + (1 - 1.5 * c) * cy + ty', ux='cx - (c * cx + s * cy) + tx', uy='cy - (c * cy - s * cx) + ty', zx='c * 3 + s * 4 + (cx - (c * cx + s * cy) + tx)', zy='-s * 3 + c * 4 + (cy - (c * cy - s * cx) + ty)', zz='7.0', mx='c * 3 + s * 4 + (cx - (c * cx + s * cy) + tx)')}, 9.0::DOUBLE AS mz FROM q""")
def transform_builders(spark, sf_dir):
    """Turns around points, scaled and in three dimensions, applied to points and maps."""
    p = _part(spark, sf_dir)
    a = affine.centered(F.col("g"), F.lit(1.5), *map(F.col, ("cx", "cy", "tx", "ty")))
    center, shift = F.array("cx", "cy"), F.array("tx", "ty")
    p = p.withColumn("a", a).withColumn("u", affine.turned(F.col("g"), center, shift)).withColumn("v", affine.turned(F.col("g"), center, shift, 4))
    z = affine.applied_n(F.col("v"), F.array(F.lit(3.0), F.lit(4.0), F.lit(7.0)), 4)
    m = affine.applied_map(F.col("u"), F.create_map(F.lit("x"), F.lit(3.0), F.lit("y"), F.lit(4.0), F.lit("z"), F.lit(9.0)))
    out = p.select("k", F.col("a")[0].alias("a"), F.col("a")[1].alias("b"), F.col("a")[2].alias("sx"), F.col("a")[5].alias("sy"), F.col("u")[2].alias("ux"), F.col("u")[5].alias("uy"), *(z[i].alias(n) for i, n in enumerate(("zx", "zy", "zz"))), m["x"].alias("mx"), m["z"].alias("mz"))
    return rounded(out, "a", "b", "sx", "sy", "ux", "uy", "zx", "zy", "zz", "mx")


@query(f"""WITH {PART} SELECT k, {_r(x='tx', y='ty', rotation='degrees(atan2(s, c))', scale='1.0', gx='cx + tx', gy='cy + ty', turn='5 + 2 * degrees(atan2(s, c))', fx='c * (c * 3 - s * 4 + tx) - s * (s * 3 + c * 4 + ty) + tx + 5', fy='s * (c * 3 - s * 4 + tx) + c * (s * 3 + c * 4 + ty) + ty + 2', wx='2 * c * (1 / 4.0) * (10 - cx) - 2 * s * (1 / 4.0) * (8 - cy) + 2 * tx + 1', wy='2 * s * (1 / 4.0) * (10 - cx) + 2 * c * (1 / 4.0) * (8 - cy) + 2 * ty + 3')} FROM q""")
def transform_mappings(spark, sf_dir):
    """Properties of transforms, data mappings, positions after several transforms, pixel transforms as physical ones."""
    p = _part(spark, sf_dir).withColumn("m", affine.rotation(F.col("g"), F.col("tx"), F.col("ty")))
    m = F.col("m")
    prop, moved = affine.properties(m), affine.mapping(F.struct(F.col("cx").alias("x"), F.col("cy").alias("y")), F.lit(5.0), m, m)
    last = affine.final_position(F.lit(3.0), F.lit(4.0), F.array(m, m), 10.0, 4.0)
    side = lambda px, x, y: F.struct(F.lit(px).alias("px"), F.lit(px).alias("py"), x.alias("x"), y.alias("y"))
    whole = affine.applied(F.col("w"), F.lit(10.0), F.lit(8.0))
    p = p.withColumn("w", affine.from_pixels(m, side(2.0, F.lit(1.0), F.lit(3.0)), side(4.0, F.col("cx"), F.col("cy"))))
    out = p.select("k", prop["x"].alias("x"), prop["y"].alias("y"), prop["rotation"].alias("rotation"), prop["scale"].alias("scale"), moved["x"].alias("gx"), moved["y"].alias("gy"), moved["rotation"].alias("turn"), last[0].alias("fx"), last[1].alias("fy"), whole[0].alias("wx"), whole[1].alias("wy"))
    return rounded(out, "x", "y", "rotation", "scale", "gx", "gy", "turn", "fx", "fy", "wx", "wy")


def _transforms(spark, sf_dir):
    p = _part(spark, sf_dir).withColumn("m", affine.rotation(F.col("g"), F.col("tx"), F.col("ty")))
    first = p.select(F.col("k").alias("tile_id"), F.lit("source_metadata").alias("transform_key"), F.col("m").alias("matrix"))
    return first.union(p.where("k % 3 = 0").select("k", F.lit("registered"), affine.product(F.col("m"), F.col("m"))))


@query(f"""WITH {PART}, t AS (SELECT k, 'source_metadata' AS transform_key, tx, ty, c FROM q WHERE k % 2 = 0 UNION ALL SELECT k, 'registered', CASE WHEN k % 3 = 0 THEN c * tx - s * ty + tx ELSE 0 END, CASE WHEN k % 3 = 0 THEN s * tx + c * ty + ty ELSE 0 END, CASE WHEN k % 3 = 0 THEN c * c - s * s ELSE 1 END FROM q WHERE k % 2 = 0)
SELECT k AS tile_id, transform_key, {_r(tx='tx', ty='ty', a='c')} FROM t""")
def transforms_copied(spark, sf_dir):
    """Registered transforms copied onto other tiles of three dimensions, and back."""
    every = _transforms(spark, sf_dir)
    target = every.where("tile_id % 2 = 0 AND transform_key = 'source_metadata'").withColumn("matrix", affine.in_3d(F.col("matrix")))
    lifted = transforms.copied(every, target, "registered", "xy", "xyz")
    out = transforms.in_2d(lifted.withColumn("z", F.lit(0.0)))
    return rounded(out.select("tile_id", "transform_key", F.col("matrix")[2].alias("tx"), F.col("matrix")[5].alias("ty"), F.col("matrix")[0].alias("a")), "tx", "ty", "a")


@query(f"""WITH {PART} SELECT (k % 4)::VARCHAR || '_' || k::VARCHAR AS label, {_r(tx='tx + 10 * (k % 4)', ty='ty - (k % 4)', z='1.0')} FROM q WHERE k % 4 <> 3""")
def transforms_composite(spark, sf_dir):
    """Slices' transforms after their tiles', flattened to labels, in three dimensions."""
    own = _transforms(spark, sf_dir).where("transform_key = 'source_metadata'").withColumn("slice", F.col("tile_id") % 4)
    whole = spark.range(3).select(F.col("id").alias("slice"), affine.rotation(F.lit(0.0), F.col("id") * 10.0, -F.col("id").cast("double")).alias("matrix"))
    out = transforms.by_label(transforms.composed(own, whole), to_3d=True)
    return rounded(out.select("label", F.col("matrix")[3].alias("tx"), F.col("matrix")[7].alias("ty"), F.col("matrix")[10].alias("z")), "tx", "ty", "z")


@query(f"""WITH {PART} SELECT k AS tile_id, CASE WHEN k % 3 = 0 THEN 'registered' ELSE 'source_metadata' END AS transform_key, {_r(tx='CASE WHEN k % 3 = 0 THEN c * tx - s * ty + tx ELSE tx END', z='CASE WHEN k % 2 = 0 THEN k * 0.5 ELSE 4 END')} FROM q""")
def transforms_best(spark, sf_dir):
    """Each tile's transform by priority, with z by place where a tile has none."""
    out = transforms.best(_transforms(spark, sf_dir)).withColumn("z", F.when(F.col("tile_id") % 2 != 0, 4.0)).withColumn("n", F.col("tile_id"))
    return rounded(transforms.in_3d(out, 0.5).select("tile_id", "transform_key", F.col("matrix")[3].alias("tx"), "z"), "tx", "z")


POLYGON = "v AS (SELECT s_nationkey AS shape, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i, s_suppkey::DOUBLE AS x, s_acctbal / 100.0::DOUBLE AS y FROM supplier)"


@query(f"""WITH {POLYGON}, n AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS u, coalesce(lead(y) OVER w, first_value(y) OVER w) AS t FROM v WINDOW w AS (PARTITION BY shape ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
m AS (SELECT shape, sum(x * t - u * y) / 2 AS a, sum((x + u) * (x * t - u * y)) / 6 AS b, sum((y + t) * (x * t - u * y)) / 6 AS c, avg(x) AS mx, avg(y) AS my FROM n GROUP BY shape)
SELECT shape, round(abs(a), 4) AS m00, round(CASE WHEN abs(a) > 1e-9 THEN b / a ELSE mx END, 4) + 0.0::DOUBLE AS cx, round(CASE WHEN abs(a) > 1e-9 THEN c / a ELSE my END, 4) + 0.0::DOUBLE AS cy FROM m""")
def contour_centers(spark, sf_dir):
    """Moments and centers of contours; the mean of the points where a contour has no area."""
    v = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("shape"), F.row_number().over(W.partitionBy("s_nationkey").orderBy("s_suppkey")).alias("i"), F.col("s_suppkey").cast("double").alias("x"), (F.col("s_acctbal") / 100).alias("y"))
    return rounded(geometry.centers(v, "shape").select("shape", "m00", "cx", "cy"), "m00", "cx", "cy", digits=4)


TILES = "tiles AS (SELECT s_suppkey AS tile_id, (s_suppkey % 10) * 24.0::DOUBLE + s_acctbal / 10000.0::DOUBLE AS x, floor(s_suppkey / 10) * 24.0::DOUBLE AS y, s_nationkey::DOUBLE AS z, 25.6::DOUBLE AS s FROM supplier)"


@query(f"""WITH {TILES}, r AS (SELECT *, CASE WHEN tile_id % 2 = 0 THEN 30.0::DOUBLE END AS r FROM tiles), f AS (SELECT *, coalesce(r, -7.5::DOUBLE) AS t FROM r), g AS (SELECT *, cos(radians(-t)) AS c, sin(radians(-t)) AS n FROM f), m AS (SELECT avg(x) AS cx, avg(y) AS cy FROM tiles)
SELECT tile_id, {_r(x='c * (x - cx) + n * (y - cy) + cx', y='c * (y - cy) - n * (x - cx) + cy', rotation='t')} FROM g, m""")
def positions_unrotated(spark, sf_dir):
    """Positions turned back by each tile's rotation, or by the mean angle of pairs, around their mean."""
    t = tiles(spark, sf_dir)
    angles = spark.createDataFrame([(5.0,), (10.0,)], "angle double")
    out = geometry.unrotated(t.withColumn("rotation", F.when(F.col("tile_id") % 2 == 0, 30.0)), angles)
    return rounded(out.select("tile_id", "x", "y", "rotation"), "x", "y", "rotation")


@query(f"""WITH p AS (SELECT l_suppkey AS set, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS n, l_quantity * 2 AS x, l_linenumber * 10.0::DOUBLE AS y FROM lineitem),
w AS (SELECT *, least(greatest((1 - greatest(abs(x / 50 - 1), abs(y / 40 - 1))) / 0.1, 0), 1) * (1 - i / n::DOUBLE / 2) AS weight FROM p)
SELECT set, i::BIGINT AS idx, floor(weight * 1e6 + 0.5) / 1e6 AS weight FROM w WHERE weight > 0.5""")
def points_off_edges(spark, sf_dir):
    """Points far enough from the border of a field of 100 by 80, weighted by their rank."""
    l = table(spark, sf_dir, "lineitem")
    p = l.select(F.col("l_suppkey").alias("set"), (F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")) - 1).cast("long").alias("idx"), (F.col("l_quantity") * 2).alias("x"), (F.col("l_linenumber") * 10.0).alias("y"))
    return geometry.off_edges(p, 100.0, 80.0).select("set", "idx", (F.floor(F.col("weight") * 1e6 + 0.5) / 1e6).alias("weight"))


@query("SELECT y, x, round(least(greatest((1 - greatest(abs(x / 8.0 - 1), abs(y / 5.0 - 1))) * 10, 0), 1)::DOUBLE, 6) AS weight FROM (SELECT unnest(generate_series(0, 9)) AS y), (SELECT unnest(generate_series(0, 15)) AS x)")
def edge_weights(spark, sf_dir):
    """The weights of all places of a field."""
    return rounded(geometry.edge_weights(spark, 10, 16).select("y", "x", "weight"), "weight")


@query("""WITH e AS (SELECT label, vec_id % 2 AS half, vec_id, embedding::DOUBLE[] AS v FROM embeddings), u AS (SELECT label, half, v, min(vec_id) AS idx FROM e GROUP BY ALL),
d AS (SELECT a.label, a.half, a.idx, min(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) ** 2)))) AS d FROM u a JOIN u b ON a.label = b.label AND a.half = b.half AND a.idx <> b.idx GROUP BY ALL), m AS (SELECT label, half, median(d) AS nn FROM d GROUP BY label, half)
SELECT k.label, round((coalesce(a.nn, 1) + coalesce(b.nn, 1)) / 2, 6) AS nn FROM (SELECT DISTINCT label FROM e) k LEFT JOIN m a ON a.label = k.label AND a.half = 0 LEFT JOIN m b ON b.label = k.label AND b.half = 1""")
def mean_nn_distance(spark, sf_dir):
    """The mean of both point sets' median nearest distances, the threshold of point matching."""
    p = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("idx"), F.col("embedding").cast("array<double>").alias("vector"))
    return rounded(geometry.mean_nn(p.where("idx % 2 = 0"), p.where("idx % 2 = 1"), "label"), "nn")


@query(f"""WITH b AS (SELECT s_suppkey AS tile_id, s_acctbal AS sx, s_suppkey * 10.0::DOUBLE AS sy, (s_suppkey % 4) AS grid, [10.0, 12.0, 8.0, 20.0]::DOUBLE[] AS px FROM supplier), p AS (SELECT *, px[grid + 1] * 1e-3 AS p, sx / 1.02::DOUBLE AS u, sy / 0.98::DOUBLE AS v, 0.01::DOUBLE AS rx, 0.02::DOUBLE AS ry FROM b),
m AS (SELECT *, cos(ry) / cos(rx - ry) AS a, -sin(ry) / cos(rx - ry) AS b, sin(rx) / cos(rx - ry) AS c, cos(rx) / cos(rx - ry) AS d FROM p)
SELECT tile_id, {_r(x='(d * u - b * v) / (a * d - b * c) - 800 * p / 2', y='(a * v - c * u) / (a * d - b * c) - 600 * p / 2', pixel='p')} FROM m""")
def stage_positions(spark, sf_dir):
    """Corners of tiles from an acquisition program's stage positions and its configuration."""
    config = "[sys]\nuse_microtome = True\n[microtome]\nstage_scale_factor_x = 1.02\nstage_scale_factor_y = 0.98\nstage_rotation_angle_x = 0.01\nstage_rotation_angle_y = 0.02\n[sem]\nstage_scale_factor_x = 5\n[grids]\npixel_size = [10.0, 12.0, 8.0, 20.0]\n[overviews]\nov_pixel_size = [100.0]\n"
    s = table(spark, sf_dir, "supplier")
    t = s.select(F.col("s_suppkey").alias("tile_id"), F.col("s_acctbal").alias("x"), (F.col("s_suppkey") * 10.0).alias("y"), F.lit(800).alias("nx"), F.lit(600).alias("ny"), F.format_string("g%04d_t%04d.tif", F.col("s_suppkey") % 4, F.col("s_suppkey")).alias("path"), F.lit(config).alias("config"))
    return rounded(geometry.from_stage(t).select("tile_id", "x", "y", "pixel"), "x", "y", "pixel")


@query(f"""WITH {TILES}, g AS (SELECT z, avg(x + s / 2) AS cx, avg(y + s / 2) AS cy, max(s / 800) AS p, bool_and(x >= 0) AS a, bool_or(x > 200) AS b FROM tiles GROUP BY z)
SELECT {_r(cx='avg(cx)', cy='avg(cy)', pixel='max(p)')}, bool_and(a) AS all_hold, bool_or(b) AS some_hold FROM g""")
def filesets_together(spark, sf_dir):
    """The mean of the filesets' centers, the largest pixel size, and whether all or some filesets hold a condition."""
    t = tiles(spark, sf_dir).withColumn("pixel", F.col("sx") / 800)
    return rounded(geometry.filesets_together(t, "z", F.col("x") >= 0, F.col("x") > 200), "cx", "cy", "pixel")


@query(f"""WITH {TILES}, p AS (SELECT a.tile_id AS i, b.tile_id AS j, (a.tile_id * 7 + b.tile_id) % 10 / 10.0::DOUBLE AS quality FROM tiles a JOIN tiles b ON a.tile_id < b.tile_id AND b.tile_id - a.tile_id <= 2), w AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey + 1 ELSE s_suppkey END AS i, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey ELSE s_suppkey + 1 END AS j FROM supplier)
SELECT w.i, w.j, p.quality FROM w LEFT JOIN p ON p.i = least(w.i, w.j) AND p.j = greatest(w.i, w.j)""")
def edges_either_way(spark, sf_dir):
    """The edge of a pair, in whichever order it is asked for."""
    t = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    near = t.select(F.col("k").alias("i"), F.explode(F.array(F.col("k") + 1, F.col("k") + 2)).alias("j")).join(t.select(F.col("k").alias("j")), "j", "left_semi")
    edges = near.select("i", "j", ((F.col("i") * 7 + F.col("j")) % 10 / 10.0).alias("quality"))
    even = F.col("k") % 2 == 0
    asked = t.select(F.when(even, F.col("k") + 1).otherwise(F.col("k")).alias("i"), F.when(even, F.col("k")).otherwise(F.col("k") + 1).alias("j"))
    return geometry.either_order(edges, asked).select("i", "j", "quality")
