"""Registered queries of pixel operators beyond statistics: axes, sizes, types, drawing, metrics; and the equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftwork.catalog import query, rounded
from weftwork.operators import metrics, pixels, reshape
from weftwork.sources.fixtures import pixels as pixel_rows
from weftwork.sources.fixtures import table

PIXELS = "pixels AS (SELECT vec_id AS tile_id, label AS z, ((p - 1) // 8)::INTEGER AS y, ((p - 1) % 8)::INTEGER AS x, embedding[p]::DOUBLE AS value FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS p))"


def _value(sql: str) -> str:
    return f"round({sql}, 6) + 0.0::DOUBLE AS value"


@query(f"WITH {PIXELS} SELECT 0 AS t, tile_id, x::INTEGER AS x, y::INTEGER AS y, {_value('value')} FROM pixels WHERE z = 3")
def axes_changed(spark, sf_dir):
    """A plane z out of z, y, x as t, x, y."""
    px = pixel_rows(spark, sf_dir).select("tile_id", "z", "y", F.col("x").cast("int").alias("x"), "value")
    return rounded(reshape.redimensioned(px, "zyx", "txy", z=3), "value")


@query(f"WITH {PIXELS} SELECT tile_id, z, y, x::INTEGER AS x, {_value('value')} FROM pixels WHERE z = 2 AND y >= 2 AND y < 6 AND x = 4")
def axes_sliced(spark, sf_dir):
    px = pixel_rows(spark, sf_dir).withColumn("x", F.col("x").cast("int"))
    return rounded(reshape.sliced(px, z=2, y0=2, y1=6, x=4), "value")


@query(f"WITH {PIXELS} SELECT z, y, x::INTEGER AS x, {_value('max(value)')} FROM pixels GROUP BY z, y, x")
def max_projection(spark, sf_dir):
    """The largest value over tiles, as over the planes of a stack."""
    px = pixel_rows(spark, sf_dir).withColumn("x", F.col("x").cast("int"))
    return rounded(reshape.max_projected(px.select(F.col("tile_id").alias("s"), "z", "y", "x", "value"), "s"), "value")


@query(f"WITH {PIXELS} SELECT tile_id, y, x::INTEGER AS x, {_value('value')}, (tile_id % 3)::INTEGER AS z FROM pixels WHERE z = 1 AND tile_id % 3 < 2")
def planes_stacked(spark, sf_dir):
    """One channel of several as a stack of planes from two files."""
    px = pixel_rows(spark, sf_dir).withColumnRenamed("z", "c").withColumn("x", F.col("x").cast("int"))
    one = reshape.squeezed(reshape.channel(px, "b", ["a", "b", "d"]).withColumn("t", F.lit(0)))
    return rounded(reshape.stacked([one.where(f"tile_id % 3 = {z}") for z in range(2)]), "value")


@query(f"WITH {PIXELS} SELECT tile_id, z, y, x::INTEGER AS x, {_value('value')} FROM pixels")
def gray_and_back(spark, sf_dir):
    """Gray pixels as three channels, and their lightness again."""
    px = pixel_rows(spark, sf_dir).withColumn("x", F.col("x").cast("int"))
    return rounded(reshape.grayed(reshape.colored(px)), "value")


@query(f"WITH {PIXELS}, g AS (SELECT DISTINCT tile_id, z FROM pixels), q AS (SELECT tile_id, z, a::INTEGER AS y, b::INTEGER AS x FROM g, (SELECT unnest(generate_series(0, 5)) AS a), (SELECT unnest(generate_series(0, 10)) AS b)) SELECT q.tile_id, q.z, q.y, q.x, {_value('coalesce(value, 0)')} FROM q LEFT JOIN pixels p ON p.tile_id = q.tile_id AND p.z = q.z AND p.y = q.y AND p.x = q.x - 1")
def planes_fitted(spark, sf_dir):
    """Planes of 8 by 8 cut and padded to 6 by 11."""
    return rounded(reshape.fitted(pixel_rows(spark, sf_dir), (8, 8), (6, 11)).withColumns({c: F.col(c).cast("int") for c in "yx"}), "value")


def _resize_sql(weights: str, height: int, width: int) -> str:
    return f"""WITH {PIXELS}, wy AS ({weights.format(n=height)}), wx AS ({weights.format(n=width)})
SELECT tile_id, z, a.o AS y, b.o AS x, {_value('sum(value * a.w * b.w)')} FROM pixels JOIN wy a ON a.i = y JOIN wx b ON b.i = x GROUP BY ALL"""


_AREA = "SELECT o::INTEGER AS o, i, (least(i + 1, (o + 1) * 8.0::DOUBLE / {n}) - greatest(i, o * 8.0::DOUBLE / {n})) * {n} / 8.0::DOUBLE AS w FROM (SELECT unnest(generate_series(0, {n} - 1)) AS o), (SELECT unnest(generate_series(0, 7)) AS i) WHERE least(i + 1, (o + 1) * 8.0::DOUBLE / {n}) > greatest(i, o * 8.0::DOUBLE / {n}) + 1e-12"
_CUBIC = "SELECT o::INTEGER AS o, least(greatest(i, 0), 7) AS i, CASE WHEN t <= 1 THEN 1.25 * t ** 3 - 2.25 * t ** 2 + 1 ELSE -0.75 * (t ** 3 - 5 * t ** 2 + 8 * t - 4) END AS w FROM (SELECT o, floor(p)::INTEGER + d AS i, abs(p - floor(p) - d) AS t FROM (SELECT o, (o + 0.5) * 8.0::DOUBLE / {n} - 0.5 AS p FROM (SELECT unnest(generate_series(0, {n} - 1)) AS o)), (SELECT unnest([-1, 0, 1, 2]) AS d))"
_LINEAR = "SELECT o::INTEGER AS o, least(greatest(i, 0), 7) AS i, 1 - t AS w FROM (SELECT o, floor(p)::INTEGER + d AS i, abs(p - floor(p) - d) AS t FROM (SELECT o, (o + 0.5) * 8.0::DOUBLE / {n} - 0.5 AS p FROM (SELECT unnest(generate_series(0, {n} - 1)) AS o)), (SELECT unnest([0, 1]) AS d))"


@query(_resize_sql(_AREA, 5, 3))
def resize_area(spark, sf_dir):
    return rounded(reshape.resized(pixel_rows(spark, sf_dir), (8, 8), (5, 3)), "value")


@query(_resize_sql(_CUBIC, 12, 10))
def resize_cubic(spark, sf_dir):
    return rounded(reshape.resized(pixel_rows(spark, sf_dir), (8, 8), (12, 10)), "value")


@query(_resize_sql(_LINEAR, 5, 5))
def resize_linear(spark, sf_dir):
    return rounded(reshape.rescaled(pixel_rows(spark, sf_dir), (8, 8), 5), "value")


@query("""SELECT p_partkey AS k, round((p_partkey * 37 % 65536) / 65535.0::DOUBLE, 6) AS as_float, floor(p_size / 51.0::DOUBLE * 255)::INTEGER AS as_int, (p_partkey * 37 % 65536 // 256)::INTEGER AS as_byte, floor(p_size / 51.0::DOUBLE * 255)::INTEGER AS float_byte,
(p_size - 25 + 128)::DOUBLE AS unsigned, (p_size - 25)::DOUBLE AS signed, (65535 - p_partkey * 37 % 65536)::BIGINT AS inverted, round(1 - p_size / 51.0::DOUBLE, 6) AS inverted_float, (127 - (p_size - 25))::INTEGER AS inverted_signed, round(0.299 * p_size + 0.587 * 3 + 0.114 * p_partkey, 6)::DOUBLE AS gray FROM part""")
def pixel_types(spark, sf_dir):
    """Values as other types of pixels."""
    wide, part, small = F.col("p_partkey") * 37 % 65536, F.col("p_size") / 51.0, F.col("p_size") - 25
    unsigned = reshape.with_sign(small, "int8", "uint8")
    out = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("k"), reshape.to_float(wide, "uint16").alias("as_float"), pixels.as_int(part).alias("as_int"), reshape.to_uint8(wide, "uint16").alias("as_byte"), reshape.to_uint8(part, "float32").alias("float_byte"),
        pixels.as_unsigned(small, 8).alias("unsigned"), reshape.with_sign(unsigned, "uint8", "int8").alias("signed"), reshape.inverted(wide, "uint16").alias("inverted"), reshape.inverted(part, "float32").alias("inverted_float"),
        reshape.inverted(small, "int8").alias("inverted_signed"), pixels.gray(F.col("p_size"), F.lit(3), F.col("p_partkey")).alias("gray"),
    )
    return rounded(out, "as_float", "inverted_float", "gray")


@query(f"""WITH {PIXELS}, d AS (SELECT tile_id, floor(stddev_pop(value) * 2000)::BIGINT AS deviation FROM pixels GROUP BY tile_id), h AS (SELECT deviation AS v, count(*) AS n FROM d GROUP BY 1),
s AS (SELECT v, sum(n) OVER (ORDER BY v) AS n0, sum(v * n) OVER (ORDER BY v) AS s0, sum(n) OVER () AS n, sum(v * n) OVER () AS s FROM h), b AS (SELECT v, n0 / n::DOUBLE AS p, s / n::DOUBLE AS m, s0 / n::DOUBLE AS m0 FROM s),
t AS (SELECT v AS threshold FROM b ORDER BY round(CASE WHEN p < 1 THEN (m * p - m0) ** 2 / (p * (1 - p)) ELSE 0 END, 9) DESC, v LIMIT 1) SELECT tile_id, deviation, threshold, deviation > threshold AS is_over FROM d, t""")
def noise_tiles(spark, sf_dir):
    """Tiles told from noise by Otsu's threshold of their deviations."""
    return reshape.noise_split(pixel_rows(spark, sf_dir), 2000.0)


@query(f"WITH {PIXELS} SELECT tile_id, z, y, x::INTEGER AS x, round(CASE WHEN tile_id % 2 = 0 AND y BETWEEN tile_id % 8 - 1 AND tile_id % 8 + 1 AND x BETWEEN 2 AND 4 THEN 9 ELSE value END, 6) + 0.0::DOUBLE AS value FROM pixels")
def points_drawn(spark, sf_dir):
    px = pixel_rows(spark, sf_dir).withColumn("x", F.col("x").cast("int"))
    points = px.where("tile_id % 2 = 0").select("tile_id").distinct().select("tile_id", (F.col("tile_id") % 8).cast("int").alias("y"), F.lit(3).alias("x"))
    return rounded(reshape.marked(px, points, 9.0, 1), "value")


@query("""SELECT l_orderkey AS a, l_partkey AS b, l_quantity > 25 AS is_inlier, l_orderkey % 100 AS y0, l_orderkey % 7 AS x0, l_partkey % 90 + 100 AS y1, l_partkey % 11 AS x1, (l_quantity > 25)::INTEGER AS n FROM lineitem""")
def match_lines(spark, sf_dir):
    """Lines between matched points of two images, one below the other."""
    l = table(spark, sf_dir, "lineitem")
    fixed = l.select(F.col("l_orderkey").alias("idx")).distinct().select("idx", (F.col("idx") % 100).alias("y"), (F.col("idx") % 7).alias("x"))
    moving = l.select(F.col("l_partkey").alias("idx")).distinct().select("idx", (F.col("idx") % 90).alias("y"), (F.col("idx") % 11).alias("x"))
    return reshape.match_lines(l.select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b"), (F.col("l_quantity") > 25).alias("is_inlier")), fixed, moving, 100, 120)


@query(f"""WITH {PIXELS}, c AS (SELECT z, min(value) AS low, quantile_cont(value, 0.001) AS a, quantile_cont(value, 0.999) AS b FROM pixels GROUP BY z)
SELECT z AS c, 'Channel ' || z AS label, CASE z % 3 WHEN 0 THEN 'FF0000' WHEN 1 THEN '00FF00' ELSE 'FFFFFF' END AS color, 0.0::DOUBLE AS start, 1.0::DOUBLE AS end_, round(a, 6) + 0.0::DOUBLE AS min, round(b, 6) + 0.0::DOUBLE AS max, (z % 2 = 0)::INTEGER * 255 AS byte_max FROM c""")
def channel_metadata(spark, sf_dir):
    """Channels with labels, colours and display windows."""
    px = pixel_rows(spark, sf_dir).withColumnRenamed("z", "c")
    colors = F.when(F.col("c") % 3 == 0, F.array(*map(F.lit, (1.0, 0.0, 0.0, 1.0)))).when(F.col("c") % 3 == 1, F.array(*map(F.lit, (0.0, 1.0, 0.0, 1.0))))
    known = px.select("c").distinct().withColumn("color", colors)
    found = metrics.channel_windows(px, known, "float32")
    byte = metrics.channel_windows(px.withColumn("value", F.col("value").cast("int")), known, "uint8").select("c", F.when(F.col("c") % 2 == 0, F.col("max")).otherwise(0.0).cast("int").alias("byte_max"))
    return rounded(found.join(byte, "c"), "min", "max")


BOTH = f"{PIXELS}, edges AS (SELECT vec_id AS i, lead(vec_id) OVER (ORDER BY vec_id) AS j FROM embeddings QUALIFY j IS NOT NULL), both_px AS (SELECT i, j, a.y, a.x, a.value AS a, b.value AS b FROM edges JOIN pixels a ON a.tile_id = i JOIN pixels b ON b.tile_id = j AND a.y = b.y AND a.x = b.x)"


@query(f"""WITH {BOTH}, k AS (SELECT 'source_metadata' AS transform_key, i, j, a, b FROM both_px UNION ALL SELECT 'registered', i, j, a, (a + b) / 2 FROM both_px), m AS (SELECT transform_key, i, j, corr(a, b) AS ncc, 1 / avg((a - b) ** 2) AS mse, avg(abs(a - b)) AS mad FROM k GROUP BY ALL),
l AS (UNPIVOT m ON ncc, mse, mad INTO NAME metric VALUE value) SELECT transform_key, i, j, metric, round(value, 6) + 0.0::DOUBLE AS value FROM l UNION ALL SELECT transform_key, NULL, NULL, metric, round(avg(value), 6) + 0.0::DOUBLE FROM l GROUP BY transform_key, metric""")
def metrics_by_key(spark, sf_dir):
    """Metrics of pairs before and after registration, one of them added by name, with their means."""
    from weftwork.queries import neighbours

    both = pixels._both(pixel_rows(spark, sf_dir), neighbours(spark, sf_dir))
    after = both.withColumn("b", (F.col("a") + F.col("b")) / 2)
    found = metrics.by_key({"source_metadata": both, "registered": after}, ["ncc", "mse", "mad"], extra={"mad": F.avg(F.abs(F.col("a") - F.col("b")))})
    return rounded(found, "value")


@query(f"""WITH {BOTH}, m AS (SELECT i, j, corr(a, b) AS ncc FROM both_px GROUP BY i, j) SELECT i, j, round(ncc, 6) + 0.0::DOUBLE AS value FROM m WHERE i % 2 = 0""")
def metric_lookup(spark, sf_dir):
    """A metric of some pairs, under the last transform key."""
    from weftwork.queries import neighbours

    both = pixels._both(pixel_rows(spark, sf_dir), neighbours(spark, sf_dir))
    found = metrics.by_key({"source_metadata": both.withColumn("b", F.lit(1.0)), "registered": both}, ["ncc"])
    return rounded(metrics.looked_up(found, "ncc", F.col("i") % 2 == 0, ["source_metadata", "registered"]), "value")
