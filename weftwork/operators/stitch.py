"""Stitching: tiles as rows of whole images, overlaps cropped by stage positions, one transform for each tile, resampled fusion.

An image row has tile_id, x, y, z (the position of its first pixel), px, py (pixel size) and image (rows of
doubles, NaN or null where there is no value). Positions and transforms (3x3, of x and y) are in stage units.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.functions import affine
from weftwork.operators import graph, kernels

IMAGE = "array<array<double>>"
#: Tiles that one solution may hold on the driver: about 200 MB with their edges.
SOLVE_TILES = 1_000_000


def images(tiles: DataFrame, pixels: DataFrame) -> DataFrame:
    """Image rows of ``tiles`` (tile_id, x, y, z, sx, sy) and their ``pixels`` (tile_id, y, x, value); a group is one tile."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = np.full((int(rows.y.max()) + 1, int(rows.x.max()) + 1), np.nan)
        out[rows.y.to_numpy(int), rows.x.to_numpy(int)] = rows.value.to_numpy(float)
        return pd.DataFrame({"tile_id": [key[0]], "image": [out.tolist()]})

    whole = pixels.select("tile_id", "y", "x", "value").groupBy("tile_id").applyInPandas(run, f"tile_id long, image {IMAGE}")
    rows = tiles.select("tile_id", "x", "y", "z", "sx", "sy").join(whole, "tile_id")
    return rows.select("tile_id", "x", "y", "z", (F.col("sx") / F.size(F.col("image")[0])).alias("px"), (F.col("sy") / F.size("image")).alias("py"), "image")


def boxes(image_rows: DataFrame) -> DataFrame:
    """Tiles (tile_id, x, y, z, sx, sy) of image rows, to be paired without moving pixels."""
    return image_rows.select("tile_id", "x", "y", "z", (F.size(F.col("image")[0]) * F.col("px")).alias("sx"), (F.size("image") * F.col("py")).alias("sy"))


def crops(image_rows: DataFrame, pairs: DataFrame, margin: int = 0) -> DataFrame:
    """(i, j, then for each side x, y, px, py, crop): what two tiles show of their common area, a margin of pixels more.

    Cropping is done where an image is; only crops are brought together. Pairs without a common area are left out.
    """
    flat = boxes(image_rows)
    sides = [flat.select(*(F.col(c).alias(f"{s}_{c}") for c in ("tile_id", "x", "y", "sx", "sy"))) for s in "ij"]
    common = pairs.select("i", "j").join(sides[0], F.col("i") == F.col("i_tile_id")).join(sides[1], F.col("j") == F.col("j_tile_id"))
    common = common.select("i", "j", *(F.greatest(f"i_{a}", f"j_{a}").alias(f"{a}0") for a in "xy"), *(F.least(F.col(f"i_{a}") + F.col(f"i_s{a}"), F.col(f"j_{a}") + F.col(f"j_s{a}")).alias(f"{a}1") for a in "xy")).where("x0 < x1 AND y0 < y1")

    def side(tile: str) -> DataFrame:
        rows = common.join(image_rows.select(F.col("tile_id").alias(tile), "x", "y", "px", "py", "image"), tile)

        def span(axis: str, size: Column) -> tuple[Column, Column]:
            a = F.floor((F.col(f"{axis}0") - F.col(axis)) / F.col(f"p{axis}") + 1e-6) - margin
            b = F.ceil((F.col(f"{axis}1") - F.col(axis)) / F.col(f"p{axis}") - 1e-6) + margin
            return F.greatest(a, F.lit(0)).cast("int"), F.least(b, size).cast("int")

        (r0, r1), (c0, c1) = span("y", F.size("image")), span("x", F.size(F.col("image")[0]))
        rows = rows.withColumns({"r0": r0, "r1": r1, "c0": c0, "c1": c1})
        cut = F.transform(F.slice("image", F.col("r0") + 1, F.col("r1") - F.col("r0")), lambda row: F.slice(row, F.col("c0") + 1, F.col("c1") - F.col("c0")))
        return rows.select("i", "j", (F.col("x") + F.col("c0") * F.col("px")).alias(f"{tile}_x"), (F.col("y") + F.col("r0") * F.col("py")).alias(f"{tile}_y"), F.col("px").alias(f"{tile}_px"), F.col("py").alias(f"{tile}_py"), cut.alias(f"{tile}_crop"))

    return side("i").join(side("j"), ["i", "j"])


def _array(rows: list) -> np.ndarray:
    out = np.array(rows, float)
    return np.where(np.isnan(out), np.nanmean(out) if not np.isnan(out).all() else 0.0, out)


def register(image_rows: DataFrame, pairs: DataFrame, method: str = "", margin: int = 0, **options) -> DataFrame:
    """(i, j, matrix, quality): the transform of positions that takes what tile j shows onto what tile i shows.

    The kernel sees crops of the overlap by stage positions, cut to a common shape, and answers in their pixels. A
    pair whose crops are empty, of unlike pixel sizes or all NaN has the identity and quality 0.
    """
    run = kernels.kernel(method)
    cropped = crops(image_rows, pairs, margin)

    @F.pandas_udf("matrix array<double>, quality double")
    def both(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for p, q in zip(a, b, strict=True):
            matrix, quality = np.eye(3), 0.0
            if len(p) and len(q) and len(p[0]) and len(q[0]):
                h, w = min(len(p), len(q)), min(len(p[0]), len(q[0]))
                p, q = (np.array([list(r)[:w] for r in list(x)[:h]], float) for x in (p, q))
                if not np.isnan(p).all() and not np.isnan(q).all():
                    matrix, quality = run(_array(p), _array(q), **options)
            out.append((matrix.ravel().tolist(), quality))
        return pd.DataFrame(out, columns=["matrix", "quality"])

    alike = (F.abs(F.col("i_px") - F.col("j_px")) < 1e-9) & (F.abs(F.col("i_py") - F.col("j_py")) < 1e-9)
    found = cropped.withColumn("found", both("i_crop", "j_crop"))
    grid = lambda s: F.struct(*(F.col(f"{s}_{c}").alias(c) for c in ("px", "py", "x", "y")))
    matrix = F.when(alike & (F.col("found.quality") != 0), affine.from_pixels(F.col("found.matrix"), grid("i"), grid("j"))).otherwise(affine.identity())
    return found.select("i", "j", matrix.alias("matrix"), F.when(alike, F.col("found.quality")).otherwise(0.0).alias("quality"))


def _least_squares(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, c: np.ndarray, t: np.ndarray, fixed: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Complex x with the least sum of w |x_j - c x_i - t|^2, those in ``fixed`` staying as they start; conjugate gradients."""
    free = np.ones(n, bool)
    free[fixed] = False

    def scattered(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.bincount(at, values.real, n) + 1j * np.bincount(at, values.imag, n)

    def back(r: np.ndarray) -> np.ndarray:
        return (scattered(w * r, j) - scattered(w * np.conj(c) * r, i)) * free

    x = start.astype(complex)
    scale = np.maximum(np.bincount(j, w, n) + np.bincount(i, w * np.abs(c) ** 2, n), 1e-300)
    left = t - (x[j] - c * x[i])
    g = back(left)
    p, now = g / scale, (np.conj(g) * g / scale).real.sum()
    first = now
    for _ in range(20 * n):
        if now <= 1e-26 * first or first == 0:
            break
        step = p[j] - c * p[i]
        size = now / (w * np.abs(step) ** 2).sum()
        x, left = x + size * p, left - size * step
        g = back(left)
        before, now = now, (np.conj(g) * g / scale).real.sum()
        p = g / scale + now / before * p
    return x


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest member of each part that edges connect."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return np.unique(label)
        label = new


def resolve(edges: DataFrame, tiles: DataFrame, kind: str = "translation") -> DataFrame:
    """(tile_id, matrix): transforms of positions that agree best with all edges, weighted by quality.

    ``kind`` is translation, rigid or similarity. For edges (i, j, matrix) with quality over 0 tile j's transform should be tile i's
    after the edge's: first turns (and scales), then shifts are the least squares over all edges. Each part's smallest tile stays where
    it is, as do tiles without edges. A system of up to ``SOLVE_TILES`` tiles is solved on the driver; larger
    ones only for translations, by :func:`graph.translations`.
    """
    spark, count = tiles.sparkSession, tiles.count()
    if count > SOLVE_TILES:
        if kind != "translation":
            raise ValueError(f"{kind} transforms are solved for at most {SOLVE_TILES} tiles")
        shifts = graph.translations(edges, tiles)
        return shifts.select("tile_id", affine.rotation(F.lit(0.0), F.col("dx"), F.col("dy")).alias("matrix"))
    ids = np.sort(tiles.select("tile_id").toArrow().column(0).to_numpy())
    m = F.col("matrix")
    known = edges.where("quality > 0").select("i", "j", "quality", *(m[k].alias(f"m{k}") for k in (0, 2, 3, 5))).toArrow()  # some edges for each tile
    e = {c: known.column(c).to_numpy() for c in known.column_names}
    i, j, w, n = np.searchsorted(ids, e["i"]), np.searchsorted(ids, e["j"]), e["quality"].astype(float), len(ids)
    turn = np.ones(n, complex)
    roots = _roots(n, i, j) if n else np.zeros(0, int)
    if kind != "translation" and len(i):
        each = e["m0"] + 1j * e["m3"]
        if kind == "rigid":
            each /= np.abs(each)
        turn = _least_squares(n, i, j, w, each, np.zeros(len(i)), roots, turn)
        if kind == "rigid":
            turn /= np.maximum(np.abs(turn), 1e-300)
    shift = _least_squares(n, i, j, w, np.ones(len(i)), turn[i] * (e["m2"] + 1j * e["m5"]), roots, np.zeros(n)) if len(i) else np.zeros(n, complex)
    flat = np.column_stack((turn.real, -turn.imag, shift.real, turn.imag, turn.real, shift.imag, np.zeros((n, 2)), np.ones(n)))
    rows = pa.table({"tile_id": pa.array(ids, pa.int64()), "matrix": pa.array(flat.tolist(), pa.list_(pa.float64()))})
    return spark.createDataFrame(rows)


def output_grid(image_rows: DataFrame, transforms: DataFrame, spacing: str | float = "mean") -> tuple[float, float, float, float, int, int]:
    """(x0, y0, sx, sy, nx, ny) of the grid that holds all transformed tiles; spacing is mean, min or max of the pixel sizes, or given."""
    flat = image_rows.select("tile_id", "x", "y", "px", "py", F.size(F.col("image")[0]).alias("nx"), F.size("image").alias("ny")).join(transforms, "tile_id")
    far = lambda a: F.col(a) + (F.col(f"n{a}") - 1) * F.col(f"p{a}")
    corner = F.explode(F.array(*(affine.applied(F.col("matrix"), x, y) for x in (F.col("x"), far("x")) for y in (F.col("y"), far("y")))))
    pick = {"mean": F.avg, "min": F.min, "max": F.max}
    sizes = [pick[spacing](c) if isinstance(spacing, str) else F.lit(float(spacing)) for c in ("px", "py")]
    rows = flat.select("px", "py", corner.alias("c"))
    r = rows.agg(F.min(F.col("c")[0]).alias("x0"), F.min(F.col("c")[1]).alias("y0"), F.max(F.col("c")[0]).alias("x1"), F.max(F.col("c")[1]).alias("y1"), sizes[0].alias("sx"), sizes[1].alias("sy")).first()
    if r.x0 is None:
        return 0.0, 0.0, 1.0, 1.0, 0, 0
    return r.x0, r.y0, r.sx, r.sy, *(int(np.ceil((b - a) / s - 1e-6)) + 1 for a, b, s in ((r.x0, r.x1, r.sx), (r.y0, r.y1, r.sy)))


def sampled(image: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Bilinear values at fractional places, NaN beyond the image."""
    h, w = image.shape
    near = 1e-6
    inside = (rows >= -near) & (rows <= h - 1 + near) & (cols >= -near) & (cols <= w - 1 + near)
    r, c = np.clip(rows, 0, h - 1), np.clip(cols, 0, w - 1)
    r0, c0 = np.minimum(np.floor(r + near).astype(int), max(h - 2, 0)), np.minimum(np.floor(c + near).astype(int), max(w - 2, 0))
    r1, c1, a, b = np.minimum(r0 + 1, h - 1), np.minimum(c0 + 1, w - 1), r - r0, c - c0
    a, b = np.where(np.abs(a) < near, 0.0, a), np.where(np.abs(b) < near, 0.0, b)
    parts = ((r0, c0, (1 - a) * (1 - b)), (r0, c1, (1 - a) * b), (r1, c0, a * (1 - b)), (r1, c1, a * b))
    out = sum(np.where(weight > 0, image[y, x] * weight, 0.0) for y, x, weight in parts)
    return np.where(inside, out, np.nan)


_VIEW = pa.schema([("z", pa.float64()), ("cy", pa.int32()), ("cx", pa.int32()), ("tile_id", pa.int64()), ("n_valid", pa.int64()), ("top", pa.int32()), ("left", pa.int32()), ("height", pa.int32()), ("width", pa.int32()), ("data", pa.binary())])
_VIEW_DDL = "z double, cy int, cx int, tile_id long, n_valid long, top int, left int, height int, width int, data binary"


def views(image_rows: DataFrame, transforms: DataFrame, grid: tuple, chunk: int = 256) -> DataFrame:
    """(z, cy, cx, tile_id, n_valid, top, left, height, width, data): each tile resampled into the chunks of the grid that it reaches.

    The tile's transform is undone for every place of the grid; values are bilinear. ``data`` are doubles of a part of the chunk.
    """
    return placed(image_rows.join(transforms, "tile_id"), grid, chunk)


def placed(rows: DataFrame, grid: tuple, chunk: int = 256) -> DataFrame:
    """The views of image rows that have their own ``matrix``; a tile may occur several times, with a z of its own."""
    x0, y0, sx, sy, nx, ny = grid

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.to_pylist():
                image = np.array([[np.nan if v is None else v for v in row] for row in t["image"]], float)
                m = np.array(t["matrix"]).reshape(3, 3)
                h, w = image.shape
                corners = m @ np.array([[t["x"] + c * t["px"], t["y"] + r * t["py"], 1.0] for r in (0, h - 1) for c in (0, w - 1)]).T
                (c0, r0), (c1, r1) = ([f((corners[k] - o) / s) for k, o, s in ((0, x0, sx), (1, y0, sy))] for f in (np.min, np.max))
                r0, c0, r1, c1 = max(0, int(np.ceil(r0 - 1e-6))), max(0, int(np.ceil(c0 - 1e-6))), min(ny - 1, int(np.floor(r1 + 1e-6))), min(nx - 1, int(np.floor(c1 + 1e-6)))
                back, n_valid = np.linalg.inv(m), int((~np.isnan(image)).sum())
                for cy in range(r0 // chunk, r1 // chunk + 1):
                    for cx in range(c0 // chunk, c1 // chunk + 1):
                        top, left = max(r0, cy * chunk), max(c0, cx * chunk)
                        bottom, right = min(r1 + 1, (cy + 1) * chunk), min(c1 + 1, (cx + 1) * chunk)
                        ys, xs = np.mgrid[top:bottom, left:right]
                        wx, wy = x0 + xs * sx, y0 + ys * sy
                        u, v = (back[k, 0] * wx + back[k, 1] * wy + back[k, 2] for k in range(2))
                        data = sampled(image, (v - t["y"]) / t["py"], (u - t["x"]) / t["px"])
                        yield pa.RecordBatch.from_pylist([{"z": t["z"], "cy": cy, "cx": cx, "tile_id": t["tile_id"], "n_valid": n_valid, "top": top - cy * chunk, "left": left - cx * chunk, "height": bottom - top, "width": right - left, "data": data.tobytes()}], schema=_VIEW)

    return rows.select("tile_id", "x", "y", "z", "px", "py", "image", "matrix").mapInArrow(run, _VIEW_DDL)


Fusion = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _quiet(f: Callable) -> Fusion:
    def run(stack: np.ndarray, _: np.ndarray) -> np.ndarray:
        some = ~np.isnan(stack).all(axis=0)
        out = np.full(stack.shape[1:], np.nan)
        out[some] = f(stack[:, some], axis=0)
        return out

    return run


def _exclusive(stack: np.ndarray, n_valid: np.ndarray) -> np.ndarray:
    out = np.full(stack.shape[1:], np.nan)
    for k in np.argsort(n_valid, kind="stable"):
        out = np.where(np.isnan(out), stack[k], out)
    return out


#: Fusion of the views (view, row, column; NaN beyond a tile) over a chunk, in the order of their tiles; more can be added by name.
FUSIONS: dict[str, Fusion] = {"mean": _quiet(np.nanmean), "sum": _quiet(np.nansum), "max": _quiet(np.nanmax), "exclusive": _exclusive}


def fusion(name: str) -> str:
    """A fusion's name from what a configuration says."""
    name = (name or "").lower()
    for part, known in (("exclus", "exclusive"), ("sum", "sum"), ("max", "max")):
        if part in name:
            return known
    return name if name in FUSIONS else "mean"


def fused(view_rows: DataFrame, grid: tuple, how: str = "mean", chunk: int = 256, most: float | None = None) -> DataFrame:
    """(z, cy, cx, height, width, data): chunks of the grid, their views fused; a group is the views over one chunk."""
    *_, nx, ny = grid
    combine = FUSIONS[fusion(how)]

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["tile_id"])
        cy, cx = rows[0]["cy"], rows[0]["cx"]
        h, w = min(chunk, ny - cy * chunk), min(chunk, nx - cx * chunk)
        stack = np.full((len(rows), h, w), np.nan)
        for k, r in enumerate(rows):
            stack[k, r["top"] : r["top"] + r["height"], r["left"] : r["left"] + r["width"]] = np.frombuffer(r["data"]).reshape(r["height"], r["width"])
        out = combine(stack, np.array([r["n_valid"] for r in rows]))
        if most is not None:
            out = np.minimum(out, most)
        return pa.table({"z": [rows[0]["z"]], "cy": pa.array([cy], pa.int32()), "cx": pa.array([cx], pa.int32()), "height": pa.array([h], pa.int32()), "width": pa.array([w], pa.int32()), "data": pa.array([out.tobytes()], pa.binary())})

    return view_rows.groupBy("z", "cy", "cx").applyInArrow(run, "z double, cy int, cx int, height int, width int, data binary")


def chunk_pixels(chunks: DataFrame, chunk: int = 256) -> DataFrame:
    """(z, y, x, value) of fused chunks, without places that no tile covers."""
    schema = pa.schema([("z", pa.float64()), ("y", pa.int64()), ("x", pa.int64()), ("value", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                block = np.frombuffer(r["data"]).reshape(r["height"], r["width"])
                y, x = np.nonzero(~np.isnan(block))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), np.nan if r["z"] is None else r["z"])), pa.array(y + r["cy"] * chunk), pa.array(x + r["cx"] * chunk), pa.array(block[y, x])], schema=schema)

    return chunks.mapInArrow(run, "z double, y long, x long, value double")


def pair_views(image_rows: DataFrame, pairs: DataFrame, transforms: DataFrame, grid: tuple, chunk: int = 256) -> DataFrame:
    """(i, j, y, x, a, b): both tiles' values at the grid's places that both cover, under given transforms, for pair metrics."""
    px = _view_pixels(views(image_rows, transforms, grid, chunk), chunk)
    a = px.select(F.col("tile_id").alias("i"), "y", "x", F.col("value").alias("a"))
    b = px.select(F.col("tile_id").alias("j"), "y", "x", F.col("value").alias("b"))
    return pairs.select("i", "j").join(a, "i").join(b, ["j", "y", "x"])


def _view_pixels(view_rows: DataFrame, chunk: int) -> DataFrame:
    schema = pa.schema([("tile_id", pa.int64()), ("y", pa.int64()), ("x", pa.int64()), ("value", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                block = np.frombuffer(r["data"]).reshape(r["height"], r["width"])
                y, x = np.nonzero(~np.isnan(block))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), r["tile_id"])), pa.array(y + r["cy"] * chunk + r["top"]), pa.array(x + r["cx"] * chunk + r["left"]), pa.array(block[y, x])], schema=schema)

    return view_rows.mapInArrow(run, "tile_id long, y long, x long, value double")
