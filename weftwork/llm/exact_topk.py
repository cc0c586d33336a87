"""Exact top-k inner products with a KD-tree for each shard of the vectors.

Vectors are dealt to shards of about ``SHARD`` rows by their id. In each shard median splits along the
widest side make a tree whose nodes keep tight bounding boxes; trees are built once and kept as rows. A query visits
nodes best-first by the largest inner product that their box allows and stops where that is under its kth score.
Shards are visited in waves: a seed shard for each query, some others, the rest. The kth score found so far goes on
with the query, and a shard whose root box can't reach it isn't visited at all. A group in one task is a tree and at
most ``PART`` queries on average, whatever the number of vectors or queries.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftwork.llm.common import Scratch

SHARD, LEAF, PART = 8192, 64, 4096
#: Root boxes that are broadcast, in bytes; beyond that every shard of a wave is visited.
BOXES = 64_000_000
EXACT = float(1 << 53)


class Tree:
    """Points sorted by leaf; of each node its box, its children or its range of points."""

    def __init__(self, points: np.ndarray):
        self.order, self.nodes, low, high = np.arange(len(points)), [], [], []
        todo = [(0, len(points), -1)]
        while todo:
            a, b, parent = todo.pop()
            own = points[self.order[a:b]]
            low.append(own.min(axis=0))
            high.append(own.max(axis=0))
            at = len(self.nodes)
            self.nodes.append([a, b, []])
            if parent >= 0:
                self.nodes[parent][2].append(at)
            if b - a > LEAF:
                side = int(np.argmax(high[-1] - low[-1])) if points.shape[1] else 0
                middle = (b - a) // 2
                if points.shape[1] and high[-1][side] > low[-1][side]:  # equal points need no split
                    self.order[a:b] = self.order[a:b][np.argpartition(own[:, side], middle)]
                    todo += [(a, a + middle, at), (a + middle, b, at)]
        self.points, self.low, self.high = points[self.order], np.array(low), np.array(high)

    def packed(self) -> bytes:
        return pickle.dumps((self.order.astype(np.int32), self.nodes, self.points, self.low, self.high))

    @classmethod
    def unpacked(cls, data: bytes) -> Tree:
        tree = cls.__new__(cls)
        tree.order, tree.nodes, tree.points, tree.low, tree.high = pickle.loads(data)
        return tree

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product of each query with anything in each node's box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T


def search(tree: Tree, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, known: np.ndarray) -> list[tuple[int, int, int]]:
    """(query, id, score) of a shard's best k rows for each query, leaving out what is under its known kth score."""
    out, bounds = [], tree.bounds(queries)
    for q, (query, bound) in enumerate(zip(queries, bounds, strict=True)):
        best: list[tuple[float, int]] = []  # a heap of (score, -id): its first is the worst
        kth, heap = known[q], [(-bound[0], 0)]
        while heap:
            most, at = heapq.heappop(heap)
            if -most < kth:
                break
            a, b, below = tree.nodes[at]
            if below:
                for c in below:
                    if bound[c] >= kth:
                        heapq.heappush(heap, (-bound[c], c))
                continue
            scores = tree.points[a:b] @ query
            for i in np.flatnonzero(scores >= kth).tolist():
                vec = int(ids[tree.order[a + i]])
                if vec == query_ids[q]:
                    continue
                item = (scores[i], -vec)
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if len(best) == k:
                kth = max(kth, best[0][0])
        out += [(int(query_ids[q]), -vec, int(score)) for score, vec in best]
    return out


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.floor(flat.astype(np.float64) * 1024).reshape(-1, dims) if dims else np.zeros((len(column), 0))


def _built(table: pa.Table) -> pa.Table:
    """A shard's tree as one row, with its ids in the tree's terms and the box of its root."""
    dims = table.column("dims")[0].as_py()
    tree = Tree(_matrix(table.column("vector"), dims))
    box = [pa.array([x[0].astype(float).tolist()], pa.list_(pa.float64())) for x in (tree.low, tree.high)]
    return pa.table({"dims": pa.array([dims], pa.int32()), "shard": pa.array([table.column("shard")[0].as_py()], pa.int64()), "ids": pa.array([table.column("vec_id").to_numpy().tobytes()], pa.binary()), "tree": pa.array([tree.packed()], pa.binary()), "low": box[0], "high": box[1]})


def _shard(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(key: tuple, rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not rows.num_rows or not asked.num_rows:
            return schema.empty_table()
        dims, ids = int(key[0].as_py()), np.frombuffer(rows.column("ids")[0].as_py(), np.int64)
        tree, queries = Tree.unpacked(rows.column("tree")[0].as_py()), _matrix(asked.column("vector"), dims)
        if dims and np.abs(tree.points).max() * np.abs(queries).max() * dims >= EXACT:  # beyond exact doubles: Python's integers
            whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
            tree.points, tree.low, tree.high, queries = whole(tree.points), whole(tree.low), whole(tree.high), whole(queries)
        known = np.array([-np.inf if x is None else x for x in asked.column("kth").to_pylist()], object if queries.dtype == object else np.float64)
        found = search(tree, ids, queries, asked.column("vec_id").to_numpy(), k, known)
        return pa.table(list(zip(*found, strict=True)) if found else [[], [], []], schema=schema)

    return run


def _within_reach(boxes, shards: int, waves: list[int], wave: int):
    """For each query of a batch the shards of a wave, after its seed, whose root box may hold more than its kth score.

    ``boxes`` broadcasts (low, high) by (dims, shard), or None. A little is added to a bound, as it is of doubles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = boxes.value if boxes is not None else None
        for batch in batches:
            at = []
            for dims, seed, kth, vector in zip(*(batch.column(c).to_pylist() for c in ("dims", "seed", "kth", "vector")), strict=True):
                own = [(seed + n) % shards for n in range(waves[wave], waves[wave + 1])]
                if table is not None:
                    own = [s for s in own if (dims, s) in table]
                    if kth is not None and dims and own:
                        q = np.floor(np.array(vector) * 1024)
                        low, high = (np.array([table[dims, s][i] for s in own]) for i in range(2))
                        bound = high @ np.maximum(q, 0) + low @ np.minimum(q, 0)
                        own = [s for s, b in zip(own, bound + 1e-9 * np.abs(bound) + 1, strict=True) if b >= kth]
                at.append(own)
            yield batch.append_column("shards", pa.array(at, pa.list_(pa.int64())))

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k highest inner products of each query with every row of another id: query_id, rank (from 1), vec_id, score.

    ``vectors`` and ``queries`` have vec_id and embedding; components count as floor(1024 * x). Ties go to
    the smaller vec_id, and a query gets all rows where there are fewer than k. Rows with a null id or
    vector, or with null or non-finite components, take no part; a query meets only vectors of its own
    length. Equal rows count once; different vectors of one id are each compared, and as queries share one
    ranking. Scores must fit in 64 bits. Other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "exact-topk")

    def valid(df: DataFrame) -> DataFrame:
        whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        df = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
        return df.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.coalesce(whole, F.lit(False))).withColumn("dims", F.size("vector")).distinct()

    rows, asked = scratch.write(valid(vectors), "vectors"), scratch.write(valid(queries), "queries")
    count, n_queries, widest = rows.count(), asked.count(), rows.agg(F.max("dims")).first()[0] or 0
    shards, parts = max(1, -(-count // SHARD)), max(1, -(-n_queries // PART))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)))
    trees = scratch.write(dealt.select("dims", "shard", "vec_id", "vector").groupBy("dims", "shard").applyInArrow(_built, "dims int, shard long, ids binary, tree binary, low array<double>, high array<double>"), "trees")
    boxes = None
    if shards * widest * 16 <= BOXES:
        boxes = spark.sparkContext.broadcast({(r.dims, r.shard): (r.low, r.high) for r in trees.select("dims", "shard", "low", "high").collect()})  # BOXES at most
    asked = asked.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(parts))).withColumn("seed", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(shards)))
    out, keys = "query_id long, vec_id long, score long", ("dims", "shard", "part")
    waves = [0, *sorted({min(n, shards) for n in (1, 1 + (shards - 1) // 8, shards)} - {0})]

    def visit(asked: DataFrame, wave: int) -> DataFrame:
        reached = asked.select("vec_id", "vector", "dims", "part", "seed", "kth").mapInArrow(_within_reach(boxes, shards, waves, wave), "vec_id long, vector array<double>, dims int, part long, seed long, kth long, shards array<long>")
        reached = scratch.write(reached.select("vec_id", "vector", "dims", "part", "kth", F.explode("shards").alias("shard")), f"reached-{wave}")
        own = reached.select(*(F.col(c).alias(f"t_{c}") for c in keys)).distinct()
        needed = own.join(trees.select(F.col("dims").alias("t_dims"), F.col("shard").alias("t_shard"), "ids", "tree"), ["t_dims", "t_shard"])
        return needed.groupBy(*(f"t_{c}" for c in keys)).cogroup(reached.groupBy(*keys)).applyInArrow(_shard(k), out)

    def best(found: DataFrame) -> DataFrame:
        order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    found = None
    for wave in range(len(waves) - 1):
        if found is None:
            now = asked.withColumn("kth", F.lit(None).cast("long"))
        else:
            kth = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth"))
            now = asked.join(kth, "vec_id", "left")
        more = visit(now, wave)
        found = scratch.write(best(more if found is None else found.drop("rank").unionByName(more)), f"found-{wave}")
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
