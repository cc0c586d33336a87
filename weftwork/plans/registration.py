"""The staged job: scan, preprocess, pair, register pairs, solve, fuse; each stage a DataFrame, saved for a rerun."""

from __future__ import annotations

import hashlib
import json
import logging
import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from enum import IntEnum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.functions import affine
from weftwork.operators import graph, kernels, metrics, pixels, stitch, tiles
from weftwork.plans.timing import Timer
from weftwork.sources import files

log = logging.getLogger(__name__)
OFF = (None, False, "", "no", "none", "false", 1, 1.0)


class State(IntEnum):
    """How far a job is, by what is saved."""

    NEW, PAIRS, GLOBAL, FUSED = range(4)


@dataclass(frozen=True)
class Config:
    operation: str = "register"
    method: str = ""
    pairing: str = "orthogonal"
    transform_type: str = "translation"
    groupwise: str = "global_optimization"
    normalisation: str | None = None
    scale: float | None = None
    gaussian_sigma: float | None = None
    filter_foreground: bool = False
    flatfield_quantiles: tuple[float, ...] = ()
    quality_threshold: float = 0.0
    overlap_threshold: float = 0.5
    metrics: tuple[str, ...] = ("ncc", "mse")
    fusion: str = "mean"
    output_spacing: str = "mean"
    max_value: float | None = None
    chunk_size: int = 256

    @classmethod
    def of(cls, settings: dict) -> Config:
        """From an operation's mapping, whose sections may be nested; unknown keys are refused."""
        flat: dict = {}
        for key, value in settings.items():
            flat |= value if isinstance(value, dict) and key in ("registration", "preprocessing", "fusion_options") else {key: value}
        if "name" in flat:
            flat["method"] = flat.pop("name")
        if unknown := set(flat) - set(cls.__dataclass_fields__):
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in flat.items()})

    def digest(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:16]

    def preprocesses(self) -> bool:
        return bool(self.flatfield_quantiles) or self.filter_foreground or self.normalisation not in OFF or self.scale not in OFF or self.gaussian_sigma not in (None, 0, False)


@dataclass
class Job:
    """One fileset's run over tiles (tile_id, x, y, z, sx, sy) and pixels (tile_id, z, y, x, value).

    With ``output`` finished stages are tables under a hash of the settings and of the tiles and pixels, and are read again.
    """

    spark: SparkSession
    tile_rows: DataFrame
    pixel_rows: DataFrame
    config: Config = field(default_factory=Config)
    output: str | None = None
    _inputs: str | None = None

    def folder(self) -> str:
        """Where this run's stages are saved."""
        if self._inputs is None:
            parts = [df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first() for df in (self.tile_rows, self.pixel_rows)]
            self._inputs = hashlib.sha256(str([tuple(map(str, p)) for p in parts]).encode()).hexdigest()[:16]
        return f"{self.output}/{self.config.digest()}-{self._inputs}"

    def _saved(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if self.output is None:
            return make()
        path = f"{self.folder()}/{name}"
        if not files.exists(self.spark, f"{path}/_SUCCESS"):
            with Timer(name):
                make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def state(self) -> State:
        """The last stage that is saved."""
        if self.output is None:
            return State.NEW
        done = [s for s, name in ((State.PAIRS, "edges"), (State.GLOBAL, "transforms"), (State.FUSED, "fused")) if files.exists(self.spark, f"{self.folder()}/{name}/_SUCCESS")]
        return max(done, default=State.NEW)

    def is_initialised(self) -> bool:
        return self.tile_rows is not None and self.pixel_rows is not None

    def is_pairs_registered(self) -> bool:
        return self.state() >= State.PAIRS

    def is_global_registered(self) -> bool:
        return self.state() >= State.GLOBAL

    def is_fused(self) -> bool:
        return self.state() >= State.FUSED

    def reset(self) -> None:
        """Forgets what is saved for these settings and inputs."""
        if self.output is not None:
            files.removed(self.spark, self.folder())
        self._inputs = None

    def preprocess(self) -> DataFrame:
        """Pixels to register with; tiles that are no foreground are left out, the others keep their ids."""
        out, c = self.pixel_rows, self.config
        if not c.preprocesses():
            return out
        keep = pixels.foreground(out).where("is_foreground").select("tile_id") if c.filter_foreground else None
        if c.scale not in OFF:
            out = pixels.downsampled(out, round(c.scale)).select("tile_id", "z", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "value")
        if c.flatfield_quantiles:
            out = pixels.flatfield(out, min(c.flatfield_quantiles), max(c.flatfield_quantiles))
        if c.gaussian_sigma:
            out = kernels.blurred(out, c.gaussian_sigma)
        if c.normalisation not in OFF:
            out = pixels.normalised(out, "global" in str(c.normalisation))
        return out if keep is None else out.join(keep, "tile_id", "left_semi")

    def images(self) -> DataFrame:
        return stitch.images(self.tile_rows, self.pixel_rows)

    def pairs(self) -> DataFrame:
        """Consecutive tiles of a stack; else neighbours, over adjacent planes too where planes hold several tiles."""
        if "stack" in self.config.operation:
            return tiles.consecutive(self.tile_rows)
        found = tiles.overlaps(self.tile_rows).agg(F.avg(F.col("has_overlap").cast("int"))).first()[0]
        if found is not None and found < self.config.overlap_threshold:
            raise ValueError(f"only {found:.0%} of the tiles overlap")
        n, planes = self.tile_rows.agg(F.count("*"), F.count_distinct("z")).first()
        return tiles.pairs(self.tile_rows, "overla" in self.config.pairing, mixed_z=planes < n)

    def register_pairs(self) -> DataFrame:
        return self._saved("edges", lambda: stitch.register(stitch.images(self.tile_rows, self.preprocess()), self.pairs(), self.config.method))

    def register_global(self) -> DataFrame:
        """(tile_id, matrix) of all tiles; those without edges have the identity."""

        def make() -> DataFrame:
            edges = graph.filtered(self.register_pairs(), self.config.quality_threshold)
            if "shortest" in self.config.groupwise:
                found = graph.shortest_paths(edges.where("quality > 0"), self.tile_rows).select("tile_id", "matrix")
            else:
                found = stitch.resolve(edges, self.tile_rows, self.config.transform_type)
                if "two_pass" in self.config.groupwise:  # once more without edges that disagree with the first solution
                    gaps = graph.residuals(edges, found.select("tile_id", F.col("matrix")[2].alias("dx"), F.col("matrix")[5].alias("dy")))
                    limit = gaps.agg(F.percentile("residual", F.lit(0.5)).alias("r")).first().r or 0.0
                    found = stitch.resolve(edges.join(gaps.where(F.col("residual") <= 3 * limit + 1e-9), ["i", "j"], "left_semi"), self.tile_rows, self.config.transform_type)
            return graph.with_identity(self.tile_rows, found)

        return self._saved("transforms", make)

    def metrics(self) -> DataFrame:
        """(transform_key, i, j, metric, value) of the pairs, in the output grid, before and after registration, and their means."""
        edges, images, after = self.register_pairs(), self.images(), self.register_global()
        before = after.select("tile_id", affine.identity().alias("matrix"))
        views = {key: stitch.pair_views(images, edges, t, stitch.output_grid(images, t, self.config.output_spacing), self.config.chunk_size) for key, t in (("source_metadata", before), ("registered", after))}
        return metrics.by_key(views, list(self.config.metrics), qualities=edges.select(F.lit("registered").alias("transform_key"), "i", "j", "quality"))

    def grid(self, spacing: str | None = None) -> tuple:
        return stitch.output_grid(self.images(), self.register_global(), spacing or self.config.output_spacing)

    def fuse(self) -> DataFrame:
        """(z, cy, cx, height, width, data): chunks of the stitched image; see :func:`stitch.chunk_pixels`."""

        def make() -> DataFrame:
            images, transforms = self.images(), self.register_global()
            grid = stitch.output_grid(images, transforms, self.config.output_spacing)
            return stitch.fused(stitch.views(images, transforms, grid, self.config.chunk_size), grid, self.config.fusion, self.config.chunk_size, self.config.max_value)

        return self._saved("fused", make)

    def preview(self, scale: int = 16) -> DataFrame:
        """Pixels (z, y, x, value) of the stitched image from tiles made smaller, with the transforms of the whole ones."""
        small = pixels.downsampled(self.pixel_rows, scale).select("tile_id", "z", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "value")
        images, transforms = stitch.images(self.tile_rows, small), self.register_global()
        grid = stitch.output_grid(images, transforms, "max")
        return stitch.chunk_pixels(stitch.fused(stitch.views(images, transforms, grid), grid, self.config.fusion))

    def frames(self, n: int, start: float, end: float) -> DataFrame:
        """(frame, y, x, value): the stitched tiles drawn together frame by frame, values stretched by the 0.01 and 0.99 quantiles."""
        images = self.images()
        placed, spread = transition(self.tile_rows, n, start, end), stitch.boxes(images)
        moves = placed.select("frame", "tile_id", F.col("x").alias("nx"), F.col("y").alias("ny")).join(spread.select("tile_id", "x", "y"), "tile_id")
        moves = moves.select("frame", "tile_id", affine.rotation(F.lit(0.0), F.col("nx") - F.col("x"), F.col("ny") - F.col("y")).alias("matrix"))
        whole = stitch.output_grid(images, moves)
        rows = images.join(moves, "tile_id").withColumn("z", F.col("frame").cast("double"))
        found = stitch.chunk_pixels(stitch.fused(stitch.placed(rows, whole), whole, self.config.fusion))
        q = found.agg(F.percentile("value", F.array(F.lit(0.01), F.lit(0.99))).alias("q"))
        stretched = pixels.clip((F.col("value") - F.col("q")[0]) / F.nullif(F.col("q")[1] - F.col("q")[0], F.lit(0.0)))
        return found.crossJoin(F.broadcast(q)).select(F.col("z").cast("int").alias("frame"), "y", "x", stretched.alias("value"))  # one row

    def save(self, labels: DataFrame, pixel: float) -> None:
        """Writes the edges, transforms and metrics as JSON rows, and the transforms as CSV, beside the stages."""
        edges, transforms = self.register_pairs(), self.register_global()
        files.write_json(files.edge_json(edges, labels), f"{self.folder()}/pair_mappings")
        files.write_json(files.mapping_json(transforms, labels), f"{self.folder()}/mappings")
        files.write_json(files.metric_json(self.metrics(), labels), f"{self.folder()}/metrics")
        files.write_csv(files.mapping_rows(transforms.join(labels, "tile_id"), self.tile_rows, pixel), f"{self.folder()}/mappings_csv")


def run(jobs: dict[str, Job], break_on_error: bool = False, workers: int = 1) -> dict[str, str]:
    """Runs named jobs, some at a time; an error ends its own job, and those after it only if asked. Returns "done" or the error."""
    out: dict[str, str] = {}

    def one(name: str, job: Job) -> bool:
        try:
            with Timer(name):
                job.fuse().write.format("noop").mode("overwrite").save()
            out[name] = "done"
        except Exception as error:
            log.exception("job %s", name)
            out[name] = f"{type(error).__name__}: {error}"
        return out[name] == "done"

    if workers > 1:
        with ThreadPoolExecutor(workers) as pool:
            list(pool.map(one, jobs, jobs.values()))
        return out
    for name, job in jobs.items():
        if not one(name, job) and break_on_error:
            break
    return out


def transition(tile_rows: DataFrame, frames: int, start: float, end: float) -> DataFrame:
    """(frame, tile_id, x, y): tiles drawn together around their center, the spacing easing by a cosine."""
    spark, n = tile_rows.sparkSession, max(frames, 1)
    steps = [(1 - math.cos(2 * math.pi * k / (n - 1))) / 2 if n > 1 else 0.0 for k in range(n)]
    total, spacing = 0.0, []
    for k, c in enumerate(steps):
        total += c / (n / 2)
        spacing.append((k, start + (end - start) * total))
    table = F.broadcast(spark.createDataFrame(spacing, "frame int, spacing double"))  # one row for each frame
    middle = F.broadcast(tile_rows.agg(F.avg("x").alias("cx"), F.avg("y").alias("cy")))  # one row
    eased = tile_rows.crossJoin(table).crossJoin(middle)
    return eased.select("frame", "tile_id", *((F.col(f"c{a}") + (F.col(a) - F.col(f"c{a}")) * F.col("spacing")).alias(a) for a in "xy"))
