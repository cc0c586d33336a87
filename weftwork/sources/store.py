"""Files of a store that driver and executors see, opened where the work is: local paths or URIs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def opened(path: str):
    """(store, path in it) of a path or URI."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@contextmanager
def reading(path: str) -> Iterator[BinaryIO]:
    where, inner = opened(path)
    with where.open_input_file(inner) as file:
        yield file


def written(path: str, data: bytes) -> None:
    """A whole file: written under a name of its own, then renamed, so that work done twice leaves no part of one."""
    where, inner = opened(path)
    where.create_dir(inner.rpartition("/")[0], recursive=True)
    own = f"{inner}.{uuid.uuid4().hex}"
    with where.open_output_stream(own) as out:
        out.write(data)
    where.move(own, inner)


def hidden(spark: SparkSession, paths: str | list[str], name: str, leaf: str) -> DataFrame:
    """(path, value): the texts of files of a name that starts with a dot, which Spark's readers pass over, below some folders.

    The driver walks the folders, not into those that hold ``leaf``, so an array's chunks are never listed; the
    files are read where their rows are.
    """
    hadoop, found = spark._jvm.org.apache.hadoop.fs.Path, []
    todo = [hadoop(p) for p in ([paths] if isinstance(paths, str) else paths)]
    while todo:
        path = todo.pop()
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if files.exists(hadoop(path, name)):
            found.append(files.makeQualified(path).toString())
        if files.exists(path) and not files.exists(hadoop(path, leaf)) and not files.exists(hadoop(path, "zarr.json")):
            todo += [status.getPath() for status in files.listStatus(path) if status.isDirectory()]
    schema = pa.schema([("path", pa.string()), ("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with reading(f"{path}/{name}") as file:
                    yield pa.RecordBatch.from_pylist([{"path": path, "value": file.read().decode("utf-8")}], schema=schema)

    return spark.createDataFrame([(p,) for p in found], "path string").mapInArrow(run, "path string, value string")
