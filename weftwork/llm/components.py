"""Connected components by alternating large-star and small-star rounds; nothing is gathered on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.llm.common import Scratch, batch_of

#: Edges that a task joins to stars at a time, and parts that a node's edges are dealt to in joins.
RUN_EDGES, SALTS = 1_000_000, 8
_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _sign(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of some edges, but the smallest of its part, with that."""
    ids, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b, label = at[: len(u)], at[len(u) :], np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    other = np.flatnonzero(label != np.arange(len(ids)))
    return ids[other], ids[label[other]]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) as the stars of a run of them: as connected as before, and fewer."""
    held, rows = [], 0

    def found() -> pa.RecordBatch:
        return batch_of(_EDGES, *stars(*(np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(2))))

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= RUN_EDGES:
            yield found()
            held, rows = [], 0
    if rows:
        yield found()


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges with the m of their u; a u of many edges is met in several tasks."""
    each = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(each, ["u", "salt"]).drop("salt")


def components(scratch: Scratch, edges: DataFrame, a: str, b: str, name: str = "components") -> DataFrame:
    """(node, component) for every node of an edge, the component being its smallest node.

    Tasks first join the edges that they hold to stars. Each round then needs two aggregations to a minimum, combined
    map-side, and two joins of edges with one row per node and part; a node's neighbours are never brought together.
    """
    pair = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now, n = scratch.write(pair.mapInArrow(_joined, "u long, v long").distinct(), f"{name}-0"), 0
    sign = _sign(now)
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _with_least(both.where("v > u"), low).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_least(large, low).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        step = scratch.write(small.where("u != v").distinct(), f"{name}-{n + 1}")
        scratch.drop(f"{name}-{n}")
        n, now, before, sign = n + 1, step, sign, _sign(step)
        if sign == before:
            roots = now.select(F.col("v").alias("node")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
