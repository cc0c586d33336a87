"""OME-NGFF metadata of image folders as a table, read with Spark from any store; and its writer."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.sources import store

#: The version of metadata that is written unless another is asked for.
VERSION = "0.5"
_META = "struct<attributes: struct<ome: struct<version: string, multiscales: array<struct<name: string, axes: array<struct<name: string, type: string, unit: string>>, datasets: array<struct<path: string, coordinateTransformations: array<struct<type: string, scale: array<double>, translation: array<double>>>>>>>>>>"


def levels(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, label, axis, level, scale, translation): one row for each axis and level of the images' zarr.json files."""
    files = spark.read.text(paths, wholetext=True, recursiveFileLookup=True, pathGlobFilter="zarr.json")
    files = files.select(F.regexp_replace(F.col("_metadata.file_path"), r"/zarr\.json$", "").alias("path"), F.from_json("value", _META).alias("m")).where("m.attributes.ome.multiscales IS NOT NULL")
    image = files.select("path", F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(\.ome)?\.zarr$", "").alias("label"), F.explode("m.attributes.ome.multiscales").alias("i"))
    level = image.select("path", "label", "i.axes", F.posexplode("i.datasets").alias("level", "d"))
    level = level.withColumn("scale", F.filter("d.coordinateTransformations", lambda t: t["type"] == "scale")[0]["scale"]).withColumn("translation", F.filter("d.coordinateTransformations", lambda t: t["type"] == "translation")[0]["translation"])
    axes = F.arrays_zip(F.col("axes.name").alias("axis"), "scale", "translation")
    return level.select("path", "label", "level", F.explode(axes).alias("a")).select("path", "label", F.col("a.axis").alias("axis"), "level", F.col("a.scale").alias("scale"), F.col("a.translation").alias("translation"))


_SETS = "array<struct<name: string, axes: array<struct<name: string, type: string, unit: string>>, datasets: array<struct<path: string, coordinateTransformations: array<struct<type: string, scale: array<double>, translation: array<double>>>>>>>"
_OMERO = "struct<channels: array<struct<label: string, color: string, window: struct<start: double, `end`: double, min: double, max: double>>>>"
_GROUP = f"struct<attributes: struct<ome: struct<version: string, multiscales: {_SETS}, omero: {_OMERO}>>>"
_GROUP_2 = f"struct<multiscales: array<struct<version: string, name: string, axes: array<struct<name: string, type: string, unit: string>>, datasets: array<struct<path: string, coordinateTransformations: array<struct<type: string, scale: array<double>, translation: array<double>>>>>>>, omero: {_OMERO}>"


def images(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, label, version, dims, levels, channels) of the images below some folders, of metadata in either format.

    levels are (path, scale, translation) and channels (label, color, window). An image that another program put
    under series ``0`` of a container is labelled by the container.
    """
    files = spark.read.text(paths, wholetext=True, recursiveFileLookup=True, pathGlobFilter="zarr.json")
    three = files.select(F.regexp_replace("_metadata.file_path", r"/zarr\.json$", "").alias("path"), F.from_json("value", _GROUP).alias("m")).select("path", "m.attributes.ome.version", F.col("m.attributes.ome.multiscales")[0].alias("s"), F.col("m.attributes.ome.omero.channels").alias("channels"))
    two = store.hidden(spark, paths, ".zattrs", ".zarray").select("path", F.from_json("value", _GROUP_2).alias("m")).select("path", F.col("m.multiscales")[0]["version"].alias("version"), F.col("m.multiscales")[0].dropFields("version").alias("s"), F.col("m.omero.channels").alias("channels"))
    rows = three.unionByName(two).where("s IS NOT NULL")
    folder = F.when(F.element_at(F.split("path", "/"), -1) == "0", F.element_at(F.split("path", "/"), -2)).otherwise(F.element_at(F.split("path", "/"), -1))
    part = lambda d, kind: F.get(F.filter(d["coordinateTransformations"], lambda t: t["type"] == kind), F.lit(0))[kind]
    every = F.transform("s.datasets", lambda d: F.struct(d["path"].alias("path"), part(d, "scale").alias("scale"), part(d, "translation").alias("translation")))
    return rows.select("path", F.regexp_replace(folder, r"(\.ome)?\.zarr$", "").alias("label"), "version", F.col("s.axes.name").alias("dims"), every.alias("levels"), "channels")


def zarr_format(version: str) -> int:
    """The format of arrays that goes with a version of the metadata."""
    return 2 if tuple(map(int, version.split(".")[:2])) < (0, 5) else 3


def positions(level_rows: DataFrame) -> DataFrame:
    """(label, x, y, z, px, py): position and pixel size of each image at its first level."""
    first = level_rows.where("level = 0")
    at = [F.max(F.when(F.col("axis") == a, F.col("translation"))).alias(a) for a in "xyz"]
    size = [F.max(F.when(F.col("axis") == a, F.col("scale"))).alias(f"p{a}") for a in "xy"]
    return first.groupBy("label").agg(*at, *size)


def axes(dims: str) -> list[dict]:
    kinds = {"t": ("time", "millisecond"), "c": ("channel", None)}
    return [{"name": d, "type": kinds.get(d, ("space", ""))[0]} | ({"unit": u} if (u := kinds.get(d, ("space", "micrometer"))[1]) else {}) for d in dims]


def transformations(dims: str, pixel: dict[str, float], factor: float, at: dict[str, float]) -> list[dict]:
    """Scale and translation of a level: x and y move by half a pixel's growth."""
    scale = [pixel.get(d, 1.0) * (factor if d in "xy" else 1) for d in dims]
    shift = [at.get(d, 0.0) + ((factor - 1) * pixel.get(d, 1.0) / 2 if d in "xy" else 0.0) for d in dims]
    return [{"type": "scale", "scale": scale}, {"type": "translation", "translation": shift}]


def omero(channels: list[dict], window: dict[str, float] | None = None) -> dict:
    """Channels (label, color, window) as viewers want them; three without labels are red, green and blue, others are white."""
    if len(channels) == 3 and not any(c.get("label") for c in channels):
        channels = [c | {"label": n, "color": v} for c, n, v in zip(channels, ("Red", "Green", "Blue"), ("FF0000", "00FF00", "0000FF"), strict=True)]
    return {"channels": [{"label": c.get("label", f"Channel {i}"), "color": c.get("color", "FFFFFF"), "active": True, "window": c.get("window") or window or {"start": 0, "end": 1, "min": 0, "max": 1}} for i, c in enumerate(channels)]}


def metadata(dims: str, pixel: dict[str, float], levels: int, factor: float, at: dict[str, float], channels: list[dict] | None = None, version: str = VERSION) -> str:
    sets = [{"path": str(k), "coordinateTransformations": transformations(dims, pixel, factor**k, at)} for k in range(levels)]
    shown = {"omero": omero(channels)} if channels else {}
    if zarr_format(version) == 2:
        return json.dumps({"multiscales": [{"version": version, "axes": axes(dims), "datasets": sets}], **shown}, indent=1)
    return json.dumps({"zarr_format": 3, "node_type": "group", "attributes": {"ome": {"version": version, "multiscales": [{"axes": axes(dims), "datasets": sets}], **shown}}}, indent=1)


def write_metadata(spark: SparkSession, path: str, text: str, name: str = "zarr.json") -> None:
    """One small file, in any store that Spark knows."""
    file = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    out = file.getFileSystem(spark._jsc.hadoopConfiguration()).create(file, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_group(spark: SparkSession, path: str, text: str, version: str = VERSION) -> None:
    """A group's metadata, in the files of its format."""
    if zarr_format(version) == 2:
        write_metadata(spark, path, json.dumps({"zarr_format": 2}), ".zgroup")
        write_metadata(spark, path, text, ".zattrs")
    else:
        write_metadata(spark, path, text)
