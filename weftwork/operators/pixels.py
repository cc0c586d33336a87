"""Pixels in long form (tile_id, z, y, x, value): statistics, corrections, similarity and fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _tile() -> WindowSpec:
    return W.partitionBy("tile_id")


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def quantiles(pixels: DataFrame, by: list[str], at: list[float]) -> DataFrame:
    """Exact quantiles with linear interpolation, one column for each."""
    found = pixels.groupBy(*by).agg(F.percentile("value", F.array(*(F.lit(q) for q in at))).alias("q"))
    return found.select(*by, *(F.col("q")[i].alias(f"q{i}") for i in range(len(at))))


def large_quantiles(pixels: DataFrame, by: list[str], at: list[float], bins: int = 4096) -> DataFrame:
    """The same for few groups of many pixels: no task holds a group's values.

    A first pass counts distinct values in equal bins between a group's ends; only the bins that hold a wanted rank
    are then put in order. Missing values and null keys take no part.
    """
    counted = pixels.where("value IS NOT NULL").groupBy(*by, "value").agg(F.count("*").alias("n"))
    ends = counted.groupBy(*by).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.sum("n").alias("total"))
    place = F.least(F.floor((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1))
    binned = counted.join(ends, by).withColumn("bin", F.when(F.col("high") > F.col("low"), place).otherwise(0))
    ranks = [(i, e, F.floor(q * (F.col("total") - 1)) if e == 0 else F.ceil(q * (F.col("total") - 1))) for i, q in enumerate(at) for e in (0, 1)]
    wanted = ends.select(*by, F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(e).alias("e"), k.cast("long").alias("k")) for i, e, k in ranks))).alias("w")).select(*by, "w.*")
    order = W.partitionBy(*by).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)  # ``bins`` rows for each group
    held = binned.groupBy(*by, "bin").agg(F.sum("n").alias("held")).withColumn("before", F.coalesce(F.sum("held").over(order), F.lit(0)))
    picked = held.join(wanted, by).where("k >= before AND k < before + held").select(*by, "bin", "before", "i", "e", "k")
    inside = binned.join(picked.select(*by, "bin", "before").distinct(), [*by, "bin"])
    upto = F.sum("n").over(W.partitionBy(*by, "bin").orderBy("value").rowsBetween(W.unboundedPreceding, 0)) + F.col("before")
    inside = inside.select(*by, "bin", "value", (upto - F.col("n")).alias("a"), upto.alias("b"))
    found = inside.join(picked.drop("before"), [*by, "bin"]).where("k >= a AND k < b")
    end = lambda i, e: F.max(F.when((F.col("i") == i) & (F.col("e") == e), F.col("value")))
    out = found.groupBy(*by).agg(*(end(i, e).alias(f"v{i}_{e}") for i in range(len(at)) for e in (0, 1))).join(ends, by)
    part = lambda q: q * (F.col("total") - 1) - F.floor(q * (F.col("total") - 1))
    return out.select(*by, *((F.col(f"v{i}_0") + (F.col(f"v{i}_1") - F.col(f"v{i}_0")) * part(q)).alias(f"q{i}") for i, q in enumerate(at)))


def foreground(pixels: DataFrame) -> DataFrame:
    """(tile_id, difference, is_foreground): mean distance to the median image, above its mean; all where none or few are."""
    median = pixels.groupBy("y", "x").agg(F.percentile("value", F.lit(0.5)).alias("median"))
    tiles = pixels.join(median, ["y", "x"]).groupBy("tile_id").agg(F.avg(F.abs(F.col("value") - F.col("median"))).alias("difference"))
    mean = tiles.agg(F.avg("difference").alias("mean"), F.count("*").alias("n"), F.max("difference").alias("most"))
    every = (F.col("n") <= 2) | (F.col("most") <= F.col("mean"))
    return tiles.crossJoin(F.broadcast(mean)).select("tile_id", "difference", (every | (F.col("difference") > F.col("mean"))).alias("is_foreground"))  # one row


def flatfield(pixels: DataFrame, dark_at: float = 0.05, bright_at: float = 0.95) -> DataFrame:
    """(x - dark) * mean(bright - dark) / (bright - dark), less the tile's least value."""
    images = quantiles(pixels, ["y", "x"], [dark_at, bright_at]).select("y", "x", F.col("q0").alias("dark"), (F.col("q1") - F.col("q0")).alias("range"))
    mean = images.agg(F.avg("range").alias("mean_range"))
    out = pixels.join(images, ["y", "x"]).crossJoin(F.broadcast(mean))  # one row
    out = out.withColumn("value", (F.col("value") - F.col("dark")) * F.col("mean_range") / F.nullif("range", F.lit(0.0)))
    return out.withColumn("value", F.col("value") - F.min("value").over(_tile())).select(*pixels.columns)


def normalised(pixels: DataFrame, over_all: bool = True) -> DataFrame:
    """clip(((x - mean) / std + 1) / 2) by the tile's, or the mean of all tiles', mean and deviation."""
    stats = pixels.groupBy("tile_id").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    if over_all:
        out = pixels.crossJoin(F.broadcast(stats.agg(F.avg("m").alias("m"), F.avg("s").alias("s"))))  # one row
    else:
        out = pixels.join(stats, "tile_id")
    return out.withColumn("value", clip(((F.col("value") - F.col("m")) / F.nullif("s", F.lit(0.0)) + 1) / 2)).select(*pixels.columns)


def stretched(pixels: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """(x - low quantile) / (high - low quantile), clipped, for each tile."""
    out = pixels.join(quantiles(pixels, ["tile_id"], [low, high]), "tile_id")
    return out.withColumn("value", clip((F.col("value") - F.col("q0")) / F.nullif(F.col("q1") - F.col("q0"), F.lit(0.0)))).select(*pixels.columns)


def standardised(pixels: DataFrame, halved: bool = False) -> DataFrame:
    z = (F.col("value") - F.avg("value").over(_tile())) / F.nullif(F.stddev_pop("value").over(_tile()), F.lit(0.0))
    return pixels.withColumn("value", clip((z + 1) / 2 if halved else z))


def quantile_scaled(pixels: DataFrame, high: float = 0.99) -> DataFrame:
    """(x - mean) / (high - low quantile), clipped."""
    out = pixels.join(quantiles(pixels, ["tile_id"], [1 - high, high]), "tile_id").join(pixels.groupBy("tile_id").agg(F.avg("value").alias("m")), "tile_id")
    return out.withColumn("value", clip((F.col("value") - F.col("m")) / F.nullif(F.col("q1") - F.col("q0"), F.lit(0.0)))).select(*pixels.columns)


def _both(pixels: DataFrame, pairs: DataFrame) -> DataFrame:
    a = pixels.select(F.col("tile_id").alias("i"), "y", "x", F.col("value").alias("a"))
    b = pixels.select(F.col("tile_id").alias("j"), "y", "x", F.col("value").alias("b"))
    return pairs.select("i", "j").join(a, "i").join(b, ["j", "y", "x"])


def _correlation() -> Column:
    return F.covar_pop("a", "b") / F.nullif(F.stddev_pop("a") * F.stddev_pop("b"), F.lit(0.0))


def similarity(pixels: DataFrame, pairs: DataFrame) -> DataFrame:
    """(i, j, ncc, mse): correlation (null for a constant tile) and 1 / mean squared difference."""
    square = F.avg(F.pow(F.col("a") - F.col("b"), 2))
    return _both(pixels, pairs).groupBy("i", "j").agg(_correlation().alias("ncc"), (F.lit(1.0) / F.nullif(square, F.lit(0.0))).alias("mse"))


def ncc2(pixels: DataFrame, pairs: DataFrame) -> DataFrame:
    return _both(pixels, pairs).groupBy("i", "j").agg(_correlation().alias("ncc"))


def mutual_information(pixels: DataFrame, pairs: DataFrame, bins: int = 8, low: float = -0.6, high: float = 0.6) -> DataFrame:
    """(i, j, nmi): (H(a) + H(b)) / H(a, b) - 1 over equal bins."""
    def bin_of(c: str) -> Column:
        return clip(F.floor((F.col(c) - low) / (high - low) * bins), 0.0, bins - 1.0).cast("int").alias(c)

    cells = _both(pixels, pairs).select("i", "j", bin_of("a"), bin_of("b")).groupBy("i", "j", "a", "b").agg(F.count("*").alias("n"))

    def entropy(by: list[str], name: str) -> DataFrame:
        counts = cells.groupBy("i", "j", *by).agg(F.sum("n").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy("i", "j")))
        return counts.groupBy("i", "j").agg((-F.sum(F.col("p") * F.log("p"))).alias(name))

    h = entropy(["a"], "ha").join(entropy(["b"], "hb"), ["i", "j"]).join(entropy(["a", "b"], "hab"), ["i", "j"])
    return h.select("i", "j", ((F.col("ha") + F.col("hb")) / F.nullif("hab", F.lit(0.0)) - 1).alias("nmi"))


def ssim(pixels: DataFrame, pairs: DataFrame, window: int = 7, span: float = 1.0) -> DataFrame:
    """(i, j, ssim): mean over whole windows of the structural similarity with uniform weights."""
    r = window // 2
    both = _both(pixels, pairs).withColumns({"aa": F.col("a") * F.col("a"), "bb": F.col("b") * F.col("b"), "ab": F.col("a") * F.col("b")})
    across = W.partitionBy("i", "j", "y").orderBy("x").rangeBetween(-r, r)
    rows = both.select("i", "j", "y", "x", F.count("*").over(across).alias("n"), *(F.sum(c).over(across).alias(c) for c in ("a", "b", "aa", "bb", "ab")))
    down = W.partitionBy("i", "j", "x").orderBy("y").rangeBetween(-r, r)
    sums = rows.select("i", "j", F.sum("n").over(down).alias("n"), *(F.sum(c).over(down).alias(c) for c in ("a", "b", "aa", "bb", "ab"))).where(F.col("n") == window * window)
    n = float(window * window)
    ua, ub = F.col("a") / n, F.col("b") / n
    sample = n / (n - 1)
    va, vb, vab = (sample * (F.col(c) / n - m) for c, m in (("aa", ua * ua), ("bb", ub * ub), ("ab", ua * ub)))
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    value = (2 * ua * ub + c1) * (2 * vab + c2) / ((ua * ua + ub * ub + c1) * (va + vb + c2))
    return sums.groupBy("i", "j").agg(F.avg(value).alias("ssim"))


def fused(pixels: DataFrame, how: str = "mean", most: float | None = None) -> DataFrame:
    """One value for each (z, y, x): mean or sum of the tiles there, the exclusive tile's or the maximum.

    Exclusive takes the tile with the fewest valid pixels, ties to the smaller id.
    """
    by = ["z", "y", "x"]
    if how == "exclusive":
        sized = pixels.join(pixels.where("value IS NOT NULL").groupBy("tile_id").agg(F.count("*").alias("n_valid")), "tile_id").where("value IS NOT NULL")
        return sized.groupBy(*by).agg(F.min_by("value", F.struct("n_valid", "tile_id")).alias("value"))
    value = {"mean": F.avg, "sum": F.sum, "max": F.max}[how]("value")
    return pixels.groupBy(*by).agg((value if most is None else F.least(value, F.lit(most))).alias("value"))


def channels(*parts: tuple[str, DataFrame]) -> DataFrame:
    """Fused images side by side as labelled channels."""
    labelled = [df.withColumn("channel", F.lit(name)) for name, df in parts]
    out = labelled[0]
    for df in labelled[1:]:
        out = out.unionByName(df)
    return out


def downsampled(pixels: DataFrame, factor: int = 2) -> DataFrame:
    """Local means of ``factor`` by ``factor`` pixels."""
    return pixels.groupBy("tile_id", "z", F.floor(F.col("y") / factor).alias("y"), F.floor(F.col("x") / factor).alias("x")).agg(F.avg("value").alias("value"))


def gray(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def as_unsigned(value: Column, bits: int) -> Column:
    """Signed integers moved to the unsigned range."""
    return value + float(1 << (bits - 1))


def as_int(value: Column, bits: int = 8) -> Column:
    return (value * float((1 << bits) - 1)).cast("int")
