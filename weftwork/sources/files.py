"""Files by pattern, and the small JSON and CSV tables that jobs exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.functions import affine, text


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, modified, length) below a folder, ordered by the numbers in the path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("modificationTime").alias("modified"), "length").orderBy(text.numbers(F.col("path")), "path")


def listed(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """(path) of files and image stores by patterns with * in any part, as URIs."""
    out = []
    for pattern in patterns:
        file, store = _path(spark, pattern)
        out += [status.getPath().toString() for status in store.globStatus(file) or ()]
    return spark.createDataFrame([(p,) for p in sorted(out)], "path string")


def filesets(files: DataFrame, label: str | None) -> DataFrame:
    """(fileset, path): files by the number after a label; those without it are left out, and all are set 0 where none has it."""
    keyed = files.select("path", text.target_number(F.col("path"), label).alias("fileset"))
    found = keyed.agg(F.count("fileset").alias("n"))
    return keyed.crossJoin(F.broadcast(found)).where("fileset IS NOT NULL OR n = 0").select(F.coalesce("fileset", F.lit(0)).cast("long").alias("fileset"), "path")  # one row


def _path(spark: SparkSession, path: str):
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    return file, file.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    file, store = _path(spark, path)
    return store.exists(file)


def removed(spark: SparkSession, path: str) -> None:
    file, store = _path(spark, path)
    store.delete(file, True)


def output_exists(spark: SparkSession, path: str, formats: str) -> bool:
    """Whether an output is there in each of some formats (".ome.zarr, .ome.tiff"); a zarr store by its metadata."""
    every = [f if f.startswith(".") else f".{f}" for f in (x.strip() for x in formats.split(",")) if f]
    return bool(every) and all(any(exists(spark, f"{path}{f}/{name}") for name in ("zarr.json", ".zattrs")) if "zar" in f else exists(spark, f"{path}{f}") for f in every)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows of JSON files: an object in each line, or one document of objects that may span lines."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.option("multiLine", "true").json(path) if path.endswith(".json") else reader.json(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", "true")
    return (reader.option("inferSchema", "true") if schema is None else reader.schema(schema)).csv(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", "true").csv(path)


def read_metadata(spark: SparkSession, content: str, fields: list[str] | None = None, beside: str | None = None) -> DataFrame:
    """A table of metadata in a CSV or JSON file, by a path that may be relative to an input's folder; some of its fields."""
    path = content if beside is None or "://" in content or content.startswith("/") else f"{beside.rpartition('/')[0]}/{content}"
    if not path.lower().endswith((".csv", ".json")):
        raise ValueError(f"neither CSV nor JSON: {path}")
    rows = read_csv(spark, path) if path.lower().endswith(".csv") else read_json(spark, path)
    return rows if fields is None else rows.select(*fields)


def with_metadata(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """``files`` (label, n, and any) with what is known of each by its label, else by its place n."""
    rest = [c for c in metadata.columns if c not in ("label", "n")]
    by_label = metadata.where("label IS NOT NULL").select("label", F.struct(*rest).alias("l"))
    by_place = metadata.where("label IS NULL").select("n", F.struct(*rest).alias("p"))
    found = files.join(by_label, "label", "left").join(by_place, "n", "left").withColumn("m", F.coalesce("l", "p"))
    return found.select(*files.columns, *(F.col(f"m.{c}").alias(c) for c in rest))


def _rows(matrix) -> Column:
    return F.array(*(F.slice(matrix, 3 * r + 1, 3) for r in range(3)))


def _pair(rows: DataFrame, labels: DataFrame) -> DataFrame:
    a, b = (labels.select(F.col("tile_id").alias(k), F.col("label").alias(f"{k}_label")) for k in "ij")
    return rows.join(a, "i").join(b, "j")


def edge_json(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(first, second, mapping, quality, bbox) of edges by both labels; bbox where edges have one."""
    more = ["bbox"] if "bbox" in edges.columns else []
    return _pair(edges, labels).select(F.col("i_label").alias("first"), F.col("j_label").alias("second"), _rows("matrix").alias("mapping"), "quality", *more)


def edges_from_json(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(i, j, matrix, quality) of what :func:`edge_json` gave, by the labels' tiles; unknown labels are left out."""
    a, b = (labels.select(F.col("tile_id").alias(k), F.col("label").alias(c)) for k, c in (("i", "first"), ("j", "second")))
    return rows.join(a, "first").join(b, "second").select("i", "j", F.flatten("mapping").alias("matrix"), "quality")


def mapping_json(transforms: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, mapping) of each tile's transform."""
    return transforms.join(labels, "tile_id").select("label", _rows("matrix").alias("mapping"))


def mappings_from_json(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels.select("tile_id", "label"), "label").select("tile_id", F.flatten("mapping").alias("matrix"))


def metric_json(metrics: DataFrame, labels: DataFrame, key: str = "registered") -> DataFrame:
    """(first, second, metrics) of pairs under a transform key: a map from each metric to its value."""
    rows = metrics.where((F.col("transform_key") == key) & F.col("i").isNotNull())
    held = rows.groupBy("i", "j").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("metrics"))
    return _pair(held, labels).select(F.col("i_label").alias("first"), F.col("j_label").alias("second"), "metrics")


def mapping_rows(transforms: DataFrame, tiles: DataFrame, pixel: float) -> DataFrame:
    """(id, x_pixels, y_pixels, z_pixels, x, y, z, rotation) of ``transforms`` (tile_id, label, matrix) added to the tiles' positions, for CSV."""
    moved = affine.mapping(F.struct("x", "y"), F.lit(0.0), F.col("matrix"))
    rows = transforms.join(tiles.select("tile_id", "x", "y", "z"), "tile_id").select("label", "z", moved.alias("m"))
    return rows.select(F.col("label").alias("id"), (F.col("m.x") / pixel).alias("x_pixels"), (F.col("m.y") / pixel).alias("y_pixels"), (F.col("z") / pixel).alias("z_pixels"), "m.x", "m.y", "z", "m.rotation")


def log_statistics(lines: DataFrame) -> DataFrame:
    """(keyword, n, mean, total) of ``Time keyword: 1.5 (..) seconds`` lines, in seconds."""
    unit = F.regexp_extract("value", r"(ms|milliseconds|seconds|minutes|hours)", 1)
    factor = F.when(unit.isin("ms", "milliseconds"), 0.001).when(unit == "minutes", 60.0).when(unit == "hours", 3600.0).otherwise(1.0)
    rows = lines.where(F.col("value").rlike(r"Time [^:]+: [0-9.]+")).select(F.regexp_extract("value", r"Time ([^:]+):", 1).alias("keyword"), (F.regexp_extract("value", r"Time [^:]+: ([0-9.]+)", 1).cast("double") * factor).alias("s"))
    return rows.groupBy("keyword").agg(F.count("*").alias("n"), F.avg("s").alias("mean"), F.sum("s").alias("total"))
