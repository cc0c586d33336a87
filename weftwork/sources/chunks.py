"""Zarr arrays of images, versions 2 and 3, sharded too: chunks as rows, decoded to pixels and encoded from them.

A chunk is a row with its bytes; what one task holds is a batch of chunks, never an image. Which chunks there are
follows from the metadata, so that only those that are asked for are opened, and one that is not stored is the fill value.
Codecs are ``bytes`` of either order, ``zstd``, ``gzip``, ``zlib``, ``blosc`` (of lz4, zlib or zstd, with shuffled bytes),
``crc32c``, which is checked, and ``sharding_indexed``; others raise. Axes are the last ones of t, c, z, y, x.
"""

from __future__ import annotations

import gzip
import json
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.sources import ngff, store

AXES = "tczyx"
_CODEC = "array<struct<name: string, configuration: struct<endian: string>>>"
_ARRAY = f"struct<node_type: string, shape: array<long>, data_type: string, fill_value: string, chunk_grid: struct<configuration: struct<chunk_shape: array<long>>>, chunk_key_encoding: struct<name: string, configuration: struct<separator: string>>, codecs: array<struct<name: string, configuration: struct<endian: string, chunk_shape: array<long>, codecs: {_CODEC}, index_location: string>>>>"
_ARRAY_2 = "struct<shape: array<long>, chunks: array<long>, dtype: string, fill_value: string, dimension_separator: string, order: string, compressor: struct<id: string>, filters: array<struct<id: string>>>"
_PIXELS = "array string, t long, c long, z long, y long, x long, value double"
#: What of an array's metadata goes with each of its chunks.
LAYOUT = ("shape", "chunk_shape", "dtype", "codecs", "fill", "keys", "shard_shape", "index_first")


def arrays(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(array, shape, chunk_shape, dtype, codecs, fill, keys, shard_shape, index_first) of the arrays below some folders.

    codecs are names, byte order after a colon; keys is how a chunk's name is made (a prefix and a separator); shard_shape is null
    where chunks are not in shards.
    """
    files = spark.read.text(paths, wholetext=True, recursiveFileLookup=True, pathGlobFilter="zarr.json")
    three = files.select(F.regexp_replace("_metadata.file_path", r"/zarr\.json$", "").alias("array"), F.from_json("value", _ARRAY).alias("m")).where("m.node_type = 'array'")
    named = lambda codecs: F.transform(codecs, lambda c: F.concat_ws(":", c["name"], c["configuration"]["endian"]))
    shard = F.get(F.filter("m.codecs", lambda c: c["name"] == "sharding_indexed"), F.lit(0))
    outer = F.col("m.chunk_grid.configuration.chunk_shape")
    plain = F.coalesce(F.col("m.chunk_key_encoding.name"), F.lit("default")) == "default"
    separator = F.coalesce(F.col("m.chunk_key_encoding.configuration.separator"), F.when(plain, "/").otherwise("."))
    three = three.select(
        "array", "m.shape", F.coalesce(shard["configuration"]["chunk_shape"], outer).alias("chunk_shape"), F.col("m.data_type").alias("dtype"),
        F.when(shard.isNotNull(), named(shard["configuration"]["codecs"])).otherwise(named(F.col("m.codecs"))).alias("codecs"), F.col("m.fill_value").alias("fill"),
        F.array(F.when(plain, F.concat(F.lit("c"), separator)).otherwise(""), separator).alias("keys"), F.when(shard.isNotNull(), outer).alias("shard_shape"), F.coalesce(shard["configuration"]["index_location"] == "start", F.lit(False)).alias("index_first"),
    )
    two = store.hidden(spark, paths, ".zarray", ".zarray").select(F.col("path").alias("array"), F.from_json("value", _ARRAY_2).alias("m"))
    order = F.when(F.startswith("m.dtype", F.lit(">")), "bytes:big").otherwise("bytes:little")
    sound = F.when(F.coalesce(F.col("m.order"), F.lit("C")) == "F", F.array(F.lit("order:F"))).otherwise(F.array().cast("array<string>"))
    two = two.select(
        "array", "m.shape", F.col("m.chunks").alias("chunk_shape"), F.regexp_replace("m.dtype", "^[<>|]", "").alias("dtype"),
        F.concat(sound, F.transform(F.coalesce("m.filters", F.array().cast("array<struct<id: string>>")), lambda f: F.concat(F.lit("filter:"), f["id"])), F.array(order), F.when(F.col("m.compressor.id").isNotNull(), F.array("m.compressor.id")).otherwise(F.array().cast("array<string>"))).alias("codecs"),
        F.col("m.fill_value").alias("fill"), F.array(F.lit(""), F.coalesce("m.dimension_separator", F.lit("."))).alias("keys"), F.lit(None).cast("array<long>").alias("shard_shape"), F.lit(False).alias("index_first"),
    )
    return three.unionByName(two)


def keys(spark: SparkSession, paths: str | list[str], level: int | None = None) -> DataFrame:
    """(array, chunk) and the arrays' layout: a row for each place of a chunk, of one level or of all. The level is the array's folder name."""
    known = arrays(spark, paths)
    if level is not None:
        known = known.where(F.element_at(F.split("array", "/"), -1) == str(level))
    counts = F.transform(F.arrays_zip("shape", "chunk_shape"), lambda s: F.ceil(s["shape"] / s["chunk_shape"]))
    known = known.withColumn("counts", counts).withColumn("n", F.aggregate("counts", F.lit(1).cast("long"), lambda a, b: a * b))
    each = known.where("n > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    after = lambda i: F.aggregate(F.slice("counts", i + 2, F.size("counts")), F.lit(1).cast("long"), lambda a, b: a * b)
    return each.withColumn("chunk", F.transform("counts", lambda c, i: F.floor(F.col("k") / after(i)).cast("long") % c)).select("array", "chunk", *LAYOUT)


def chunks(spark: SparkSession, paths: str | list[str], level: int | None = None) -> DataFrame:
    """(array, chunk, data) and the array's layout: a row for each chunk, of one level or of all; data is null where none is stored."""
    return read(keys(spark, paths, level))


def read(key_rows: DataFrame) -> DataFrame:
    """Chunk rows of :func:`keys`, which may be filtered: each chunk's bytes, or its part of a shard, read where its row is."""
    ddl = "array string, chunk array<long>, data binary"
    schema = pa.schema([("array", pa.string()), ("chunk", pa.list_(pa.int64())), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([{"array": row["array"], "chunk": row["chunk"], "data": _stored(row)}], schema=schema)

    known = key_rows.select("array", *LAYOUT).distinct()
    found = key_rows.select("array", "chunk", "chunk_shape", "keys", "shard_shape", "index_first").mapInArrow(run, ddl)
    return found.join(known, "array")


def _stored(row: dict) -> bytes | None:
    prefix, separator = row["keys"]
    place, inner = row["chunk"], None
    if row["shard_shape"]:
        per = [s // c for s, c in zip(row["shard_shape"], row["chunk_shape"], strict=True)]
        place, inner = [i // n for i, n in zip(place, per, strict=True)], [i % n for i, n in zip(place, per, strict=True)]
    try:
        with store.reading(f"{row['array']}/{prefix}{separator.join(map(str, place)) if place else '0'}") as file:
            if inner is None:
                return file.read()
            n = int(np.prod(per))
            size = 16 * n + 4
            file.seek(0 if row["index_first"] else file.size() - size)
            table = file.read(size)
            if crc32c(table[:-4]) != struct.unpack("<I", table[-4:])[0]:
                raise ValueError(f"a shard's checksum is wrong in {row['array']}")
            at = int(np.ravel_multi_index(inner, per))
            offset, length = struct.unpack_from("<QQ", table, 16 * at)
            if offset == length == (1 << 64) - 1:
                return None
            file.seek(offset)
            return file.read(length)
    except FileNotFoundError:
        return None


@lru_cache(maxsize=1)
def _crc_table() -> np.ndarray:
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, crc >> np.uint32(1) ^ np.uint32(0x82F63B78), crc >> np.uint32(1))
    return crc


def crc32c(data: bytes) -> int:
    """The Castagnoli checksum. Long data is cut into rows whose registers advance together and are then joined."""
    table, flat = _crc_table(), np.frombuffer(data, np.uint8)
    width = max(1, int(len(flat) ** 0.5) // 4 * 4 or len(flat))
    rows = len(flat) // width
    head, body = flat[: len(flat) - rows * width], flat[len(flat) - rows * width :].reshape(rows, width) if rows else flat[:0].reshape(0, 1)
    crc = 0xFFFFFFFF
    for byte in head.tolist():
        crc = crc >> 8 ^ int(table[(crc ^ byte) & 255])
    if rows:
        registers = np.zeros(rows, np.uint32)
        for column in body.T:
            registers = registers >> np.uint32(8) ^ table[(registers ^ column) & np.uint32(255)]
        bits = (np.uint32(1) << np.arange(32, dtype=np.uint32)).astype(np.uint32)
        for _ in range(width):  # what each bit of a register becomes when a row's bytes pass
            bits = bits >> np.uint32(8) ^ table[bits & np.uint32(255)]
        step = bits.tolist()
        for register in registers.tolist():
            out, k = 0, 0
            while crc:
                if crc & 1:
                    out ^= step[k]
                crc, k = crc >> 1, k + 1
            crc = out ^ register
    return crc ^ 0xFFFFFFFF


def unblosc(data: bytes) -> bytes:
    """The bytes of a blosc frame of lz4, zlib or zstd blocks, or plain ones, with or without shuffled bytes."""
    _, _, flags, size, total, block, _ = struct.unpack_from("<BBBBiii", data)
    if flags & 2:
        return data[16 : 16 + total]
    kind = flags >> 5
    unpack = {1: lambda b, n: pa.Codec("lz4_raw").decompress(b, n).to_pybytes(), 3: lambda b, n: zlib.decompress(b), 4: lambda b, n: zstandard.ZstdDecompressor().decompress(b, n)}.get(kind)
    if unpack is None or flags & 4:
        raise ValueError(f"unknown blosc format {flags}")
    out = []
    for k, start in enumerate(struct.unpack_from(f"<{-(-total // block)}i", data, 16)):
        n = min(block, total - k * block)
        parts = 1 if flags & 16 or n < block else size
        plain = b""
        for _ in range(parts):
            length = struct.unpack_from("<i", data, start)[0]
            piece = data[start + 4 : start + 4 + length]
            plain += piece if length == n // parts else unpack(piece, n // parts)
            start += 4 + length
        if flags & 1 and size > 1:
            whole = n // size * size
            plain = np.frombuffer(plain[:whole], np.uint8).reshape(size, -1).T.tobytes() + plain[whole:]
        out.append(plain)
    return b"".join(out)


def _decoded(data: bytes, codecs: list[str]) -> tuple[bytes, str]:
    order = "<"
    for codec in reversed(codecs):
        name, _, endian = codec.partition(":")
        if name == "zstd":
            data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
        elif name == "gzip":
            data = gzip.decompress(data)
        elif name == "zlib":
            data = zlib.decompress(data)
        elif name == "blosc":
            data = unblosc(data)
        elif name == "crc32c":
            data, sum_ = data[:-4], data[-4:]
            if crc32c(data) != struct.unpack("<I", sum_)[0]:
                raise ValueError("a chunk's checksum is wrong")
        elif name == "bytes":
            order = ">" if endian == "big" else "<"
        elif codec != "order:F":
            raise ValueError(f"unknown codec {name}")
    return data, order


def _fill(text: str | None) -> float:
    return {"NaN": np.nan, "Infinity": np.inf, "-Infinity": -np.inf, "true": 1.0, "false": 0.0}.get(text or "0", None) if (text or "0") in ("NaN", "Infinity", "-Infinity", "true", "false") else float(text or 0)


def pixels(chunk_rows: DataFrame) -> DataFrame:
    """(array, t, c, z, y, x, value) of chunks: places beyond the array's shape are left out, axes it lacks are 0; a chunk without data is the fill value."""
    schema = pa.schema([("array", pa.string()), *((a, pa.int64()) for a in AXES), ("value", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                size, shape = row["chunk_shape"], row["shape"]
                if row["data"] is None:
                    block = np.full(size, _fill(row["fill"]))
                else:
                    data, order = _decoded(row["data"], row["codecs"])
                    block = np.frombuffer(data, np.dtype(row["dtype"]).newbyteorder(order)).reshape(size, order="F" if "order:F" in row["codecs"] else "C")
                first = [i * n for i, n in zip(row["chunk"], size, strict=True)]
                block = block[tuple(slice(0, max(0, n - at)) for at, n in zip(first, shape, strict=True))]
                places = dict(zip(AXES[-len(shape) :], (at + i.ravel() for at, i in zip(first, np.indices(block.shape), strict=True)), strict=True))
                none = np.zeros(block.size, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([row["array"]] * block.size, pa.string()), *(pa.array(places.get(a, none)) for a in AXES), pa.array(block.ravel().astype(np.float64))], schema=schema)

    return chunk_rows.select("array", "chunk", "data", "shape", "chunk_shape", "dtype", "codecs", "fill").mapInArrow(run, _PIXELS)


def encoded(pixel_rows: DataFrame, shape: list[int], chunk_shape: list[int], dtype: str, codec: str = "zstd") -> DataFrame:
    """Chunk rows, as :func:`chunks` gives them, of pixels (array, the last axes of t, c, z, y, x, value).

    A group is one chunk, so its size is the chunk's. Null values and places without a row are 0; of repeated
    places the largest value counts; places outside the shape are left out, as are chunks without any pixel.
    """
    if codec not in ("zstd", "gzip", ""):
        raise ValueError(f"unknown codec {codec}")
    axes = AXES[-len(shape) :]
    codecs = ["bytes:little", *([codec] if codec else [])]
    kind = np.dtype(dtype).newbyteorder("<")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        block = np.zeros(chunk_shape, kind)
        rows = rows.dropna(subset=["value"]).sort_values("value", kind="stable")
        block[tuple(rows[a].to_numpy(np.int64) % n for a, n in zip(axes, chunk_shape, strict=True))] = rows.value.to_numpy(kind)
        data = block.tobytes()
        data = zstandard.ZstdCompressor().compress(data) if codec == "zstd" else gzip.compress(data, mtime=0) if codec == "gzip" else data
        return pd.DataFrame({"array": [key[0]], "chunk": [[int(k) for k in key[1:]]], "data": [data]})

    inside = pixel_rows.select("array", *axes, F.col("value").cast("double").alias("value"))
    for a, n in zip(axes, shape, strict=True):
        inside = inside.where(F.col(a).between(0, n - 1))
    keys = [F.floor(F.col(a) / n).alias(f"chunk_{a}") for a, n in zip(axes, chunk_shape, strict=True)]
    found = inside.groupBy("array", *keys).applyInPandas(run, "array string, chunk array<long>, data binary")
    fixed = {"shape": (shape, "array<long>"), "chunk_shape": (chunk_shape, "array<long>"), "codecs": (codecs, "array<string>")}
    return found.select("*", *(F.array(*map(F.lit, x)).cast(t).alias(c) for c, (x, t) in fixed.items()), F.lit(dtype).alias("dtype"), F.lit("0").alias("fill"))


def save(spark: SparkSession, chunk_rows: DataFrame, shape: list[int], chunk_shape: list[int], dtype: str, codec: str = "zstd", version: int = 3) -> None:
    """Stores encoded chunks below their arrays' paths, from the executors, then the arrays' metadata, in format 3 or 2.

    ``array`` holds a URI of a store that all executors see. A file is written under a task's own name and then
    renamed, so a task that runs again leaves whole files. Metadata comes last: an array without it is unfinished.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store.written("/".join([row["array"], *(["c"] if version == 3 else []), *map(str, row["chunk"])]), row["data"])
            yield batch.select(["array"])

    done = chunk_rows.select("array", "chunk", "data").mapInArrow(run, "array string").distinct()
    more = [{"name": codec, "configuration": {"level": 0, "checksum": False} if codec == "zstd" else {"level": 9}}] if codec else []
    text = json.dumps({"zarr_format": 3, "node_type": "array", "shape": shape, "data_type": dtype, "fill_value": 0, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": chunk_shape}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, *more], "attributes": {}})
    if version == 2:
        text = json.dumps({"zarr_format": 2, "shape": shape, "chunks": chunk_shape, "dtype": np.dtype(dtype).newbyteorder("<").str, "compressor": {"id": codec, "level": 1} if codec else None, "fill_value": 0, "order": "C", "filters": None, "dimension_separator": "/"})
    for row in done.toLocalIterator():  # a row for each array, one small file each
        ngff.write_metadata(spark, row.array, text, "zarr.json" if version == 3 else ".zarray")


def save_pyramid(spark: SparkSession, pixel_rows: DataFrame, shape: list[int], chunk_shape: list[int], dtype: str, levels: int = 1, factor: int = 2, pixel: dict[str, float] | None = None, at: dict[str, float] | None = None, channels: list[dict] | None = None, version: str = ngff.VERSION, codec: str = "zstd") -> None:
    """Images of ``pixel_rows`` (array, the last axes of t, c, z, y, x, value) of one shape with smaller levels, as NGFF groups at their paths.

    A level holds the means over squares of y and x of the level before. Chunks are written by the tasks that hold them.
    """
    axes, rows, sizes = AXES[-len(shape) :], pixel_rows, list(shape)
    for k in range(levels):
        if k:
            sizes = [max(1, n // factor) if a in "xy" else n for a, n in zip(axes, sizes, strict=True)]
            place = [(F.floor(F.col(a) / factor) if a in "xy" else F.col(a)).alias(a) for a in axes]
            rows = rows.groupBy("array", *place).agg(F.avg("value").alias("value"))
        named = rows.withColumn("array", F.concat("array", F.lit(f"/{k}"))).withColumn("value", F.round("value") if np.dtype(dtype).kind in "iu" else F.col("value"))
        save(spark, encoded(named, sizes, chunk_shape, dtype, codec), sizes, chunk_shape, dtype, codec, ngff.zarr_format(version))
    text = ngff.metadata(axes, pixel or {}, levels, factor, at or {}, channels, version)
    for row in pixel_rows.select("array").distinct().toLocalIterator():  # a row for each image
        ngff.write_group(spark, row.array, text, version)
