"""Operations of a settings file from image files to stitched stores: filesets by label, a job for each, outputs beside it."""

from __future__ import annotations

import logging
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftwork.functions import text
from weftwork.operators import geometry, labels, stitch, tiles
from weftwork.plans.registration import Config, Job
from weftwork.plans.settings import path_of
from weftwork.plans.timing import Timer
from weftwork.sources import chunks, crate, files, source, tiff

log = logging.getLogger(__name__)


def match_label(operation: str) -> tuple[bool, str | None]:
    """Whether an operation deals its files to filesets, and by which label ("register match S" by S)."""
    words = operation.split()
    if "match" not in words:
        return False, None
    at = words.index("match") + 1
    return True, words[at] if at < len(words) else None


def filesets(spark: SparkSession, operation: dict[str, Any]) -> DataFrame:
    """(fileset, file, path) of an operation's input files, in the order of the numbers in their paths."""
    given = path_of(operation["input"])["path"]
    paths = given if isinstance(given, list) else [given]
    found = spark.createDataFrame([(p,) for p in paths], "path string") if all("*" not in p for p in paths) else files.listed(spark, paths)
    deals, label = match_label(operation["operation"])
    dealt = files.filesets(found, label) if deals else found.select(F.lit(0).cast("long").alias("fileset"), "path")
    order = W.partitionBy("fileset").orderBy(text.numbers(F.col("path")), "path")  # one row for each file
    return dealt.select("fileset", (F.row_number().over(order) - 1).cast("long").alias("file"), "path")


def scanned(spark: SparkSession, fileset: DataFrame, metadata: dict[str, Any] | None = None, level: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tiles, pixels, labels) of one fileset (file, path): positions and sizes as settings and files have them, one level's pixels.

    ``metadata`` sets position, scale and rotation (see :func:`source.overridden`); ``is_center``, ``norm`` and
    ``invert`` as flags or words mean centers for corners, positions turned back, and x and y negated.
    """
    metadata = metadata or {}
    known = source.overridden(source.described(spark, fileset.select("path")), metadata).where(F.col("level") == level)
    known = known.join(fileset, "path")
    at = lambda c, d: F.coalesce(F.element_at(c, d), F.lit(0.0 if c == "position" else 1.0))
    rows = known.select(F.col("file").alias("tile_id"), "path", *(at("position", d).alias(d) for d in "xyz"), (F.col("width") * at("pixel", "x")).alias("sx"), (F.col("height") * at("pixel", "y")).alias("sy"), "rotation")
    if "invert" in metadata:
        rows = rows.withColumns({"x": -F.col("x"), "y": -F.col("y")})
    if "is_center" in metadata:
        rows = rows.withColumns({"x": F.col("x") - F.col("sx") / 2, "y": F.col("y") - F.col("sy") / 2})
    if "norm" in metadata:
        rows = geometry.unrotated(rows, tiles.pair_angles(rows))
    rows = rows.persist()
    own = rows.select("tile_id", "path")
    parts = []
    kinds = {r[0] for r in known.select("kind").distinct().collect()}  # two at most
    if "tiff" in kinds:
        found = tiff.pixels(tiff.segments(tiff.headers(known.where("kind = 'tiff'").select("path")), level)).where("page = 0 AND c = 0")
        parts.append(found.join(own, "path").select("tile_id", F.lit(0).alias("z"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "value"))
    if "zarr" in kinds:
        folders = [r[0] for r in known.where("kind = 'zarr'").select("path").distinct().collect()]  # one path for each image
        found = chunks.pixels(chunks.chunks(spark, folders, level)).where("t = 0 AND c = 0 AND z = 0")
        found = found.withColumn("path", F.regexp_replace("array", r"/[^/]+$", ""))
        parts.append(found.join(own, "path").select("tile_id", F.lit(0).alias("z"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "value"))
    pixels = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    named = labels.file_labels(fileset.select(F.lit(0).alias("fileset"), "file", "path")).select(F.col("file").alias("tile_id"), "label")
    return rows.drop("path"), pixels, named


def stored(spark: SparkSession, job: Job, path: str, levels: int = 1, dtype: str = "float32") -> None:
    """Writes a job's stitched image as an image store with smaller levels, its planes as z, and a description of it."""
    x0, y0, sx, sy, nx, ny = job.grid()
    planes = [r[0] for r in job.tile_rows.select("z").distinct().orderBy("z").collect()]  # one for each plane
    place = F.array_position(F.array(*map(F.lit, planes)), F.col("z")) - 1
    rows = stitch.chunk_pixels(job.fuse(), job.config.chunk_size).select(F.lit(path).alias("array"), place.cast("long").alias("z"), "y", "x", "value")
    side = job.config.chunk_size
    chunks.save_pyramid(spark, rows, [len(planes), ny, nx], [1, min(side, ny), min(side, nx)], dtype, levels, 2, {"x": sx, "y": sy}, {"x": x0, "y": y0})
    crate.write(spark, path, crate.store(path.rstrip("/").rpartition("/")[2].removesuffix(".ome.zarr")))


def run_fileset(spark: SparkSession, operation: dict[str, Any], fileset: DataFrame, name: str) -> Job:
    """Registers and stitches one fileset to ``<output>/<name>/``."""
    given = path_of(operation["input"])
    with Timer("scan"):
        tile_rows, pixel_rows, named = scanned(spark, fileset, given.get("source_metadata"))
    config = Config.of({"operation": operation["operation"], **operation.get("preprocessing", {}), **operation.get("registration", {}), **operation.get("fusion", {})})
    out = f"{path_of(operation['output'])['path'].rstrip('/')}/{name}"
    job = Job(spark, tile_rows, pixel_rows, config, f"{out}/stages")
    if operation.get("overwrite"):
        job.reset()
    with Timer("register"):
        job.register_global()
    pixel = tile_rows.join(pixel_rows.groupBy("tile_id").agg((F.max("x") + 1).alias("nx")), "tile_id").agg(F.avg(F.col("sx") / F.col("nx"))).first()[0] or 1.0
    job.save(named, pixel)
    with Timer("fuse image"):
        stored(spark, job, f"{out}/{operation['operation'].split()[0]}ed.ome.zarr")
    return job


def run(spark: SparkSession, settings: dict[str, Any], one: Callable[..., Any] = run_fileset) -> dict[str, str]:
    """Runs a settings file's operations, one after the other; an operation's filesets some at a time (``n_set_workers``).

    Returns "done" or the error of each ``operation/fileset``. An error ends its own fileset; with ``break_on_error`` all that follows.
    """
    general, out = settings.get("general", {}), {}
    for number, operation in enumerate(settings.get("operations", [])):
        dealt = filesets(spark, operation).persist()
        names = [r[0] for r in dealt.select("fileset").distinct().orderBy("fileset").collect()]  # one for each job
        if not names:
            log.warning("no files for %s", operation["operation"])

        def work(name: int, operation: dict[str, Any] = operation, dealt: DataFrame = dealt, number: int = number) -> bool:
            key = f"{number} {operation['operation']}/{name}"
            try:
                with Timer(key):
                    one(spark, operation, dealt.where(F.col("fileset") == name).drop("fileset"), str(name))
                out[key] = "done"
            except Exception as error:
                log.exception("%s", key)
                out[key] = f"{type(error).__name__}: {error}"
            return out[key] == "done"

        workers = operation.get("n_set_workers", 1)
        if workers > 1:
            with ThreadPoolExecutor(workers) as pool:
                fine = all(list(pool.map(work, names)))
        else:
            fine = all(work(name) or general.get("break_on_error") is not True for name in names)
        if not fine and general.get("break_on_error"):
            break
    return out
