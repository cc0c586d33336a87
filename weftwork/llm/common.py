"""Helpers shared by the training-data operators.

Words are ``[^\\x20\\x09-\\x0D]+``: ``bytes.split()`` on UTF-8 splits at exactly
these six bytes, so every operator cuts whole texts through :func:`word_hashes`
or :func:`words` and never through ``str.split`` (which knows more spaces).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Characters of text that one numpy pass takes together; bounds a worker's memory.
CHUNK_CHARS = 1_500_000

MIX_1, MIX_2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
SHIFT = np.uint64(33)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the session's checkpoint folder.

    Only a local session, whose executors are the driver, gets a new folder of its own where both are unset.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weftwork-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the DataFrame doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Scratch:
    """Intermediate tables in the shared folder; writing one cuts the lineage and survives lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Frees a table that no later plan reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def hashes_of(parts: list[bytes]) -> np.ndarray:
    """A 64-bit hash for each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every input bit reaches every output bit."""
    x = x ^ (x >> SHIFT)
    x = x * MIX_1
    x ^= x >> SHIFT
    x *= MIX_2
    x ^= x >> SHIFT
    return x


def chunks(texts: Iterable[str | None] | pa.Array, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of about ``limit`` characters, each with the index of its first text. A longer text is a run alone."""
    first, run, chars = 0, [], 0
    for i, text in enumerate(texts):
        if isinstance(text, pa.Scalar):
            text = text.as_py()
        size = len(text) if text else 0
        if run and chars + size > limit:
            yield first, run
            first, run, chars = i, [], 0
        run.append(text)
        chars += size
    if run:
        yield first, run


def binary_array(parts: list[bytes | memoryview | None]) -> pa.Array:
    return pa.array(parts, pa.binary())


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


#: A Bloom filter takes at most this many bits (8 MB), whatever its input: the proven bound of what is broadcast.
BLOOM_MAX_BITS = 1 << 26
#: Bits of a slab: a key's probes lie in one slab, so that a filter is built slab by slab, in parallel.
SLAB_BITS = 1 << 20


def _probes(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    for i in range(4):
        yield ((low + np.uint64(i) * high) & np.uint64(bits - 1)).astype(np.int64)


class Bloom:
    """A broadcast set of 64-bit keys that may say yes wrongly and never no wrongly.

    Only a filter ahead of an exact step: beyond ``BLOOM_MAX_BITS`` it fills up and lets
    more rows through, so results stay the same and only the saving shrinks.
    """

    def __init__(self, spark: SparkSession, keys: DataFrame, count: int):
        bits = 1 << 13
        while bits < min(16 * count, BLOOM_MAX_BITS):
            bits *= 2
        slab = min(bits, SLAB_BITS)

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filled: dict[int, np.ndarray] = {}
            for batch in batches:
                hashes = mixed(batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
                at = batch.column(0).to_numpy(zero_copy_only=False)
                for i in np.unique(at).tolist():
                    own = filled.setdefault(i, np.zeros(slab, bool))
                    for p in _probes(hashes[at == i], slab):
                        own[p] = True
            for i, own in filled.items():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([np.packbits(own).tobytes()])], ["slab", "bits"])

        self.bits, self.slab = bits, slab
        dealt = keys.mapInArrow(self._slabs, "slab long, key long").repartition(min(bits // slab, shuffle_partitions(spark)), "slab")
        merged = np.zeros((bits // slab, slab // 8), np.uint8)
        for row in dealt.mapInArrow(build, "slab long, bits binary").collect():  # a row for each slab, 8 MB in all
            merged[row[0]] |= np.frombuffer(row[1], np.uint8)
        self.shared = spark.sparkContext.broadcast(merged.tobytes())

    def _slabs(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            at = (mixed(keys.view(np.uint64)) >> np.uint64(40)) % np.uint64(self.bits // self.slab)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(keys)], ["slab", "key"])

    def test(self, keys: np.ndarray) -> np.ndarray:
        table, found, hashes = np.frombuffer(self.shared.value, np.uint8), np.ones(len(keys), bool), mixed(keys.astype(np.uint64))
        first = ((hashes >> np.uint64(40)) % np.uint64(self.bits // self.slab)).astype(np.int64) * self.slab
        for p in _probes(hashes, self.slab):
            p = first + p
            found &= (table[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 == 1
        return found
