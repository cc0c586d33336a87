"""Edges between tiles (i, j, matrix, quality), their filters and one consistent transform for each tile."""

from __future__ import annotations

import heapq
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.functions import affine

#: Tiles that one least-squares system may hold on the driver: 200 MB; larger ones are solved by steps in Spark.
SOLVE_TILES = 5_000
#: Where these steps end: what is left of the equations' error.
TOLERANCE = 1e-13
#: Tiles and edges (each way) that one task walks along.
WALK_ROWS = 1 << 18


def filtered(edges: DataFrame, least: float) -> DataFrame:
    return edges.where(F.col("quality") >= least)


def overridden(edges: DataFrame, overrides: DataFrame) -> DataFrame:
    """Edges with the matrices of ``overrides`` (i, j, matrix), whose quality is then 1."""
    new = overrides.select("i", "j", F.col("matrix").alias("m"))
    return edges.join(new, ["i", "j"], "left").select("i", "j", F.coalesce("m", "matrix").alias("matrix"), F.when(F.col("m").isNotNull(), 1.0).otherwise(F.col("quality")).alias("quality"))


def either_way(edges: DataFrame) -> DataFrame:
    """Edges in both directions, the reverse with the inverse matrix."""
    return edges.select("i", "j", "matrix", "quality").union(edges.select("j", "i", affine.inverse(F.col("matrix")), "quality"))


def with_identity(tiles: DataFrame, transforms: DataFrame) -> DataFrame:
    """A transform for every tile: the identity where none was found."""
    return tiles.select("tile_id").join(transforms, "tile_id", "left").select("tile_id", F.coalesce("matrix", affine.identity()).alias("matrix"))


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the folder that driver and executors share and read again.

    A plan begins anew there, with the file's size as its estimate. A checkpoint keeps the estimates of the plan before it: a
    table that is joined with itself round by round then has sizes of ever more digits, until they fill the driver.
    """
    spark = df.sparkSession
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weftwork-"))
        path = spark.sparkContext.getCheckpointDir()
    path = f"{path.rstrip('/')}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, tiles: DataFrame) -> DataFrame:
    """(tile_id, component): the smallest tile that edges lead to; labels halve their way by pointer jumping."""
    edges = cut(edges.select("i", "j"))
    both = edges.select(F.col("i").alias("u"), F.col("j").alias("v")).union(edges.select("j", "i"))
    label = cut(tiles.select(F.col("tile_id").alias("u"), F.col("tile_id").alias("c")))
    while True:
        near = both.join(label.select(F.col("u").alias("v"), "c"), "v").groupBy("u").agg(F.min("c").alias("n"))
        new = label.join(near, "u", "left").select("u", F.least("c", "n").alias("c"), F.col("c").alias("old"))
        jump = new.select(F.col("u").alias("c"), F.col("c").alias("to"))
        new = cut(new.join(jump, "c", "left").select("u", F.least("c", "to").alias("c"), "old"))
        changed = new.where("c != old").isEmpty()
        label = new.drop("old")
        if changed:
            return label.select(F.col("u").alias("tile_id"), F.col("c").alias("component"))


def _nearest(key: tuple, nodes: pa.Table, edges: pa.Table) -> pa.Table:
    """A block's nodes with the least (component, hops) that the fresh ones lead to along edges inside of it; moved: which are new."""
    ids, c, hops, fresh = (nodes[k].to_pylist() for k in ("tile_id", "c", "hops", "fresh"))
    at, moved = {t: k for k, t in enumerate(ids)}, [False] * len(ids)
    heap = [(c[k], hops[k], k) for k, is_new in enumerate(fresh) if is_new and c[k] is not None]
    near: list[list[int]] = [[] for _ in ids] if heap else []
    if heap:
        for u, v in zip(edges["u"].to_pylist(), edges["v"].to_pylist(), strict=True):
            near[at[u]].append(at[v])
        heapq.heapify(heap)
    for *_, k in heap:
        moved[k] = True
    while heap:
        part, far, k = heapq.heappop(heap)
        if (part, far) == (c[k], hops[k]):
            for v in near[k]:
                if c[v] is None or (part, far + 1) < (c[v], hops[v]):
                    c[v], hops[v], moved[v] = part, far + 1, True
                    heapq.heappush(heap, (part, far + 1, v))
    changed = {"c": c, "hops": hops, "fresh": moved}
    return pa.table({f.name: pa.array(changed[f.name], f.type) if f.name in changed else nodes[f.name] for f in nodes.schema})


def hops(edges: DataFrame, tiles: DataFrame, root: int | None = None) -> DataFrame:
    """(tile_id, hops): the fewest edges from the root (or each component's smallest tile), however many they are.

    Nodes are dealt by ranges of ids to blocks, each of which one task walks to its end; a round then joins the edges between
    blocks with the nodes that the last one moved. So rounds grow with the blocks that a way crosses, not with its edges.
    """
    spark, kind = tiles.sparkSession, dict(tiles.dtypes)["tile_id"]
    edges = cut(edges.select("i", "j").where("i != j"))
    both = edges.select(F.col("i").alias("u"), F.col("j").alias("v")).union(edges.select("j", "i")).distinct()
    start = F.col("tile_id") if root is None else F.when(F.col("tile_id") == root, F.col("tile_id"))
    rows = tiles.select("tile_id", start.alias("c")).where("tile_id IS NOT NULL").union(both.select("u", F.lit(None).cast(kind)))
    blocks = max(1, -(-rows.count() // WALK_ROWS))
    bounds = rows.agg(F.percentile_approx("tile_id", [k / blocks for k in range(1, blocks)])).first()[0] if blocks > 1 else []

    @F.arrow_udf("int")
    def block(ids: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(np.array(bounds, np.int64), ids.to_numpy(zero_copy_only=False)), pa.int32())

    both = cut(both.select("u", "v", block("u").alias("block"), block("v").alias("other")))
    state = rows.groupBy("tile_id").agg(F.min("c").alias("c")).select("tile_id", block("tile_id").alias("block"), "c", F.when(F.col("c").isNotNull(), 0).alias("hops"), F.lit(True).alias("fresh"))
    inside, across = both.where("block = other").select("block", "u", "v"), both.where("block != other").select("u", "v")
    while True:
        state = cut(state.groupBy("block").cogroup(inside.groupBy("block")).applyInArrow(_nearest, f"tile_id {kind}, block int, c {kind}, hops int, fresh boolean"))
        moved = state.where("fresh")
        if blocks == 1 or moved.isEmpty():
            return state.where("c IS NOT NULL").select("tile_id", "hops")
        offers = across.join(moved.select(F.col("tile_id").alias("u"), "c", "hops"), "u").groupBy(F.col("v").alias("tile_id")).agg(F.min(F.struct("c", (F.col("hops") + 1).alias("hops"))).alias("new"))
        better = F.col("new").isNotNull() & (F.col("c").isNull() | (F.col("new") < F.struct("c", "hops")))
        state = state.drop("fresh").join(offers, "tile_id", "left").withColumn("fresh", better).select("tile_id", "block", *(F.when(F.col("fresh"), F.col(f"new.{k}")).otherwise(F.col(k)).alias(k) for k in ("c", "hops")), "fresh")


def shortest_paths(edges: DataFrame, tiles: DataFrame, root: int | None = None, most: int | None = None) -> DataFrame:
    """(tile_id, hops, matrix): transforms along the fewest edges from the root (or each component's smallest tile).

    Of equally short ways the one through the smallest tile counts. Ways are put together by doubling, in as many joins as
    their hops have binary digits; without ``most`` all tiles that edges lead to have a row, with it those up to so many hops.
    """
    edges = cut(edges.select("i", "j", "matrix", "quality"))
    far = hops(edges, tiles, root)
    far = far if most is None else far.where(F.col("hops") <= most)
    steps = either_way(edges).select(F.col("i").alias("up"), F.col("j").alias("tile_id"), F.col("matrix").alias("step"))
    steps = steps.join(far, "tile_id").join(far.select(F.col("tile_id").alias("up"), (F.col("hops") + 1).alias("hops")), ["up", "hops"]).groupBy("tile_id").agg(F.min("up").alias("up"), F.min_by("step", "up").alias("matrix"))
    ways = cut(far.join(steps, "tile_id", "left").select("tile_id", "hops", "up", F.coalesce("matrix", affine.identity()).alias("matrix")))
    while not ways.where("up IS NOT NULL").isEmpty():  # matrix: from up, or the root, to the tile
        before = ways.select(F.col("tile_id").alias("up"), F.col("up").alias("next"), F.col("matrix").alias("first"))
        whole = F.when(F.col("first").isNull(), F.col("matrix")).otherwise(affine.product(F.col("first"), F.col("matrix")))
        ways = cut(ways.join(before, "up", "left").select("tile_id", "hops", F.col("next").alias("up"), whole.alias("matrix")))
    return ways.select("tile_id", "hops", "matrix")


def translations(edges: DataFrame, tiles: DataFrame) -> DataFrame:
    """(tile_id, dx, dy): shifts that agree best with all edges, weighted by quality; each component's smallest tile stays.

    Spark sums the normal equations; the driver solves them up to ``SOLVE_TILES`` tiles. Beyond, the same
    equations are solved by conjugate gradients, whose steps are joins and sums in Spark.
    """
    n = tiles.count()
    w = edges.where("quality > 0").select("i", "j", F.col("quality").alias("w"), F.col("matrix")[2].alias("tx"), F.col("matrix")[5].alias("ty"))
    entries = w.select(F.explode(F.array(*(F.struct(F.col(a).alias("r"), F.col(b).alias("c"), (s * F.col("w")).alias("w")) for a, b, s in (("i", "i", 1), ("j", "j", 1), ("i", "j", -1), ("j", "i", -1))))).alias("e")).select("e.*").groupBy("r", "c").agg(F.sum("w").alias("w"))
    right = w.select(F.explode(F.array(F.struct(F.col("i").alias("r"), (-F.col("w") * F.col("tx")).alias("x"), (-F.col("w") * F.col("ty")).alias("y")), F.struct(F.col("j").alias("r"), (F.col("w") * F.col("tx")).alias("x"), (F.col("w") * F.col("ty")).alias("y")))).alias("e")).select("e.*").groupBy("r").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    if n > SOLVE_TILES:
        found = _by_steps(entries, right, tiles, n).join(components(edges.where("quality > 0"), tiles), "tile_id")
        still = found.where("tile_id = component").select("component", F.col("x").alias("x0"), F.col("y").alias("y0"))
        return found.join(still, "component").select("tile_id", (F.col("x") - F.col("x0")).alias("dx"), (F.col("y") - F.col("y0")).alias("dy"))
    ids = [r[0] for r in tiles.select("tile_id").orderBy("tile_id").collect()]  # SOLVE_TILES at most
    at = {t: k for k, t in enumerate(ids)}
    a, b = np.zeros((n, n)), np.zeros((n, 2))
    for r in entries.collect():
        a[at[r.r], at[r.c]] += r.w
    for r in right.collect():
        b[at[r.r]] = (r.x, r.y)
    fixed = [at[r[0]] for r in components(edges.where("quality > 0"), tiles).where("tile_id = component").collect()]
    a[fixed], b[fixed] = 0, 0
    a[fixed, fixed] = 1
    solved = np.linalg.solve(a, b)
    return tiles.sparkSession.createDataFrame([(t, float(x), float(y)) for t, (x, y) in zip(ids, solved, strict=True)], "tile_id long, dx double, dy double")


def _by_steps(entries: DataFrame, right: DataFrame, tiles: DataFrame, n: int) -> DataFrame:
    """(tile_id, x, y): a solution of the equations by conjugate gradients over their diagonal.

    No tile is held in place, so a component's solution is free by a shift. Each step joins the entries
    with the direction and brings four sums to the driver.
    """
    entries = cut(entries)
    own = entries.where("r = c").select(F.col("r").alias("tile_id"), F.col("w").alias("d"))
    state = tiles.select("tile_id").join(own, "tile_id", "left").join(right.withColumnRenamed("r", "tile_id"), "tile_id", "left")
    state = state.select("tile_id", F.coalesce("d", F.lit(1.0)).alias("d"), *(c for k in "xy" for c in (F.lit(0.0).alias(k), F.coalesce(k, F.lit(0.0)).alias(f"r{k}"))))
    state = cut(state.select("*", *((F.col(f"r{k}") / F.col("d")).alias(f"p{k}") for k in "xy")))

    def sums(df: DataFrame, *parts: str) -> list[float]:
        return [v or 0.0 for v in df.agg(*(F.sum(F.expr(p)) for p in parts)).first()]

    left = start = sums(state, "rx * rx / d", "ry * ry / d")
    for _ in range(10 * n):
        if all(now <= TOLERANCE**2 * first for now, first in zip(left, start, strict=True)):
            return state.select("tile_id", "x", "y")
        turned = entries.join(state.select(F.col("tile_id").alias("c"), "px", "py"), "c").groupBy("r").agg(F.sum(F.col("w") * F.col("px")).alias("ax"), F.sum(F.col("w") * F.col("py")).alias("ay"))
        state = cut(state.join(turned.withColumnRenamed("r", "tile_id"), "tile_id", "left").fillna(0.0, ["ax", "ay"]))
        step = [now / bent if bent > 0 else 0.0 for now, bent in zip(left, sums(state, "px * ax", "py * ay"), strict=True)]
        state = state.select("tile_id", "d", *(c for k, a in zip("xy", step, strict=True) for c in ((F.col(k) + a * F.col(f"p{k}")).alias(k), (F.col(f"r{k}") - a * F.col(f"a{k}")).alias(f"r{k}"), F.col(f"p{k}"))))
        before, left = left, sums(state, "rx * rx / d", "ry * ry / d")
        turn = [now / old if old > 0 else 0.0 for now, old in zip(left, before, strict=True)]
        state = state.select("tile_id", "d", *(c for k, b in zip("xy", turn, strict=True) for c in (F.col(k), F.col(f"r{k}"), (F.col(f"r{k}") / F.col("d") + b * F.col(f"p{k}")).alias(f"p{k}"))))
    raise ArithmeticError("the shifts' equations were not solved to the tolerance")


def residuals(edges: DataFrame, shifts: DataFrame) -> DataFrame:
    """(i, j, residual): how far an edge is from the tiles' shifts."""
    a, b = (shifts.select(F.col("tile_id").alias(k), F.col("dx").alias(f"{k}x"), F.col("dy").alias(f"{k}y")) for k in "ij")
    gap = F.sqrt(F.pow(F.col("jx") - F.col("ix") - F.col("matrix")[2], 2) + F.pow(F.col("jy") - F.col("iy") - F.col("matrix")[5], 2))
    return edges.join(a, "i").join(b, "j").select("i", "j", gap.alias("residual"))


def metric_summary(metrics: DataFrame, include_zero: bool = False) -> DataFrame:
    """(i, j, metric, value) of each pair and, with null i and j, their mean; zero qualities count only if asked."""
    rows = metrics.where("value IS NOT NULL AND NOT isnan(value)")
    if not include_zero:
        rows = rows.where("NOT (metric = 'quality' AND value = 0)")
    return rows.withColumn("pair", F.struct("i", "j")).rollup("metric", "pair").agg(F.avg("value").alias("value")).where("metric IS NOT NULL").select("pair.i", "pair.j", "metric", "value")


def metric_table(metrics: DataFrame, names: list[str]) -> DataFrame:
    """One row for each pair, one column for each metric."""
    return metrics.groupBy("i", "j").pivot("metric", names).agg(F.first("value"))
