"""MinHash near-duplicate detection with sequential Bayesian verification.

1. One pass makes each document's set of word shingles, a 128-bit key of the set and the keys of its
   signature's bands. Equal sets form a class, kept as its smallest doc_id: copies meet in a partial
   aggregation and go no further.
2. Bands that two or more classes share give candidates. Nothing is emitted for all pairs of a band:
   its smallest member is compared with the others first. Classes thereby joined need no more
   comparing. In a second round small bands that still hold several components list their pairs of
   different components; large ones are joined to clusters and compare, in pairs of small blocks, a
   cluster's documents outside its largest component with all others. A pair of blocks returns only
   links that connect components.
3. In both rounds a candidate pair's signatures are compared in batches of ``BATCH`` hashes. After each batch the
   pair is dropped when the posterior probability that its similarity reaches the threshold (uniform
   prior, binomial matches) is under ``miss``. Survivors are confirmed on the full sets.
4. Confirmed links feed the components; every document gets its class's component.

With 32 bands of 5 hashes a pair of similarity 0.8 shares no band with probability 3e-6.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.llm.common import BLOOM_MAX_BITS, Bloom, Scratch, batch_of, binary_array, chunks, hashes_of, mixed, unused
from weftwork.llm.components import components

BANDS, ROWS, BATCH = 32, 5, 32
#: In the second round: documents of a band of which pairs are listed; documents of a block, of which a task compares two.
FEW, BLOCK = 16, 64
#: Documents with candidates that a Bloom filter is made for, at least 4 bits each; more are told by a join.
MOST_MEMBERS = BLOOM_MAX_BITS // 4
STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles of ``size`` words (A-Z lower-cased); a shorter text is one shingle."""
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes.lower() changes A-Z alone
    if not parts:
        return np.empty(0, np.uint64)
    h, k = hashes_of(parts), min(size, len(parts))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = mixed(out * STEP + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240611)
    n = BANDS * ROWS
    return r.integers(0, 1 << 32, n, np.uint32) | np.uint32(1), r.integers(0, 1 << 32, n, np.uint32)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """uint32 MinHash signatures, one row for each set; none may be empty."""
    a, b = _coefficients()
    out = np.empty((len(a), len(sets)), np.uint32)
    first = 0
    while first < len(sets):  # runs of sets that fit in the cache
        last, size = first + 1, len(sets[first])
        while last < len(sets) and size + len(sets[last]) <= 40_000:
            size += len(sets[last])
            last += 1
        flat = (np.concatenate(sets[first:last]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *(len(s) for s in sets[first : last - 1])])
        for i in range(len(a)):
            out[i, first:last] = np.minimum.reduceat(flat * a[i] + b[i], starts)
        first = last
    return out.T


def band_keys(signature: np.ndarray) -> np.ndarray:
    parts = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    key = np.tile(np.arange(BANDS, dtype=np.uint64), (len(signature), 1))
    for i in range(ROWS):
        key = mixed(key * STEP + parts[:, :, i])
    return key


def least_matches(threshold: float, miss: float) -> list[int]:
    """For each count of compared hashes, the least matches at which P(similarity >= threshold) is not under ``miss``."""
    out = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        tail, m = 0.0, 0
        while m <= n:  # P(s >= t | m of n) with a uniform prior is P(Binomial(n + 1, t) <= m)
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append(m)
    return out


def _sketch(size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, texts in chunks(batch.column(1)):
                sets = [shingle_set(t, size) for t in texts]
                full = [i for i, s in enumerate(sets) if len(s)]
                bands = [None] * len(sets)
                if full:
                    keys = band_keys(signatures([sets[i] for i in full]))
                    for i, row in zip(full, keys, strict=True):
                        bands[i] = row.tobytes()
                yield batch_of(schema, ids.slice(first, len(texts)), [len(s) for s in sets], binary_array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]), binary_array(bands))

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("band", pa.int64()), ("doc", pa.int64())])
    for batch in batches:
        if batch.num_rows:
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
            yield batch_of(schema, keys, np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS))


def _payload(size: int, wanted: Bloom | None):
    schema = pa.schema([("doc", pa.int64()), ("signature", pa.binary()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if wanted is not None:
                batch = batch.filter(pa.array(wanted.test(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))))
            for first, texts in chunks(batch.column(1)):
                sets = [(i, s) for i, t in enumerate(texts, first) if len(s := shingle_set(t, size))]
                if sets:
                    signed = signatures([s for _, s in sets])
                    yield batch_of(schema, batch.column(0).take(pa.array([i for i, _ in sets])), binary_array([s.tobytes() for s in signed]), binary_array([s.tobytes() for _, s in sets]))

    return run


def _verify(percent: int, miss: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    least = least_matches(percent / 100, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for c in ("x_signature", "y_signature"))
            alive, matches = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for k, need in enumerate(least):
                part = slice(k * BATCH, (k + 1) * BATCH)
                matches[alive] += (x[alive, part] == y[alive, part]).sum(axis=1)
                alive = alive[matches[alive] >= need]
            links, xs, ys = [], batch.column("x_shingles"), batch.column("y_shingles")
            for i in alive.tolist():
                s, t = np.frombuffer(xs[i].as_py(), np.uint64), np.frombuffer(ys[i].as_py(), np.uint64)
                if min(len(s), len(t)) * 100 < percent * max(len(s), len(t)):
                    continue
                both = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * both >= percent * (len(s) + len(t) - both):
                    links.append(i)
            if links:
                yield batch_of(schema, *(batch.column(c).take(pa.array(links)) for c in ("a", "b")))

    return run


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * |intersection| >= percent * |union| of their shingle sets;
    component_id is the smallest doc_id that links lead to, and kept marks that document.
    A null or wordless text has an empty set, is linked with nothing and is kept. Rows that repeat a
    doc_id are one document, linked by any of their texts. A row without doc_id can't be named in a
    link: component_id is null and it is kept. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = scratch.write(texts.mapInArrow(_sketch(shingle_words), "doc_id long, n_shingles long, set_key binary, bands binary"), "sketch")
    named = sketch.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = scratch.write(named.groupBy("set_key").agg(F.min("doc_id").alias("doc"), F.first("bands").alias("bands")), "classes")

    bands = classes.select("doc", "bands").mapInArrow(_bands, "band long, doc long")
    shared = bands.groupBy("band").agg(F.min("doc").alias("pivot"), F.max("doc").alias("last")).where("pivot < last").drop("last")
    shared = scratch.write(shared, "shared")
    active = scratch.write(bands.join(shared, "band").where("doc != pivot"), "active-0")
    members = scratch.write(active.select("doc").union(active.select("pivot")).distinct(), "members")
    held = members.count()
    found = classes.select("doc").where("false").select("doc", F.col("doc").alias("component"))
    if held:
        held_texts = texts.where("doc_id IS NOT NULL AND text IS NOT NULL")
        if held <= MOST_MEMBERS:
            wanted = Bloom(spark, members, held)
        else:  # more than a filter tells apart
            wanted, held_texts = None, held_texts.join(members.select(F.col("doc").alias("doc_id")), "doc_id", "left_semi")
        payload = held_texts.mapInArrow(_payload(shingle_words, wanted), "doc long, signature binary, shingles binary")
        payload = scratch.write(payload, "payload")
        found = _link(scratch, active, payload, percent, miss)
    ties = _ties(scratch, named, classes)
    if ties is not None:
        found = _merged(scratch, found, ties, 2)

    of_class = classes.select("set_key", "doc").join(found, "doc", "left").select("set_key", F.coalesce("component", "doc").alias("component_id"))
    of_class = scratch.write(of_class, "of-class")
    linked = named.select("doc_id", "n_shingles", "set_key").join(of_class, "set_key").select("doc_id", "n_shingles", "component_id")
    alone = sketch.where("doc_id IS NULL OR n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _ties(scratch: Scratch, named: DataFrame, classes: DataFrame) -> DataFrame | None:
    """(a, b): the smallest documents of classes that a doc_id with different texts belongs to."""
    many = named.groupBy("doc_id").agg(F.min("set_key").alias("x"), F.max("set_key").alias("y")).where("x < y").select("doc_id")
    many = scratch.write(many, "many")
    if many.isEmpty():
        return None
    ends = named.join(many, "doc_id").select("doc_id", "set_key").distinct().join(classes.select("set_key", F.col("doc").alias("b")), "set_key")
    ends = scratch.write(ends.select("doc_id", "b").distinct(), "ends")
    return ends.join(ends.groupBy("doc_id").agg(F.min("b").alias("a")), "doc_id").where("a < b").select("a", "b").distinct()


def _link(scratch: Scratch, active: DataFrame, payload: DataFrame, percent: int, miss: float) -> DataFrame:
    """(doc, component) of the documents that have a confirmed link. ``active``: band, doc, pivot (its smallest)."""
    verify = _verify(percent, miss)

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        x, y = (payload.select(F.col("doc").alias(c), F.col("signature").alias(f"{s}_signature"), F.col("shingles").alias(f"{s}_shingles")) for c, s in (("a", "x"), ("b", "y")))
        return scratch.write(pairs.join(y, "b").join(x, "a").mapInArrow(verify, "a long, b long"), name)

    pairs = scratch.write(active.select(F.col("pivot").alias("a"), F.col("doc").alias("b")).distinct(), "pairs-0")
    links = confirmed(pairs, "links-0")
    found = scratch.write(components(scratch, links, "a", "b", "round-0").select(F.col("node").alias("doc"), "component"), "found-0")
    rest = _rest(scratch, active, found)
    if rest is None:
        return found
    cold, blocks = rest
    links = confirmed(cold, "links-1")
    if blocks is not None:
        links = links.union(scratch.write(blocks.join(payload, "doc").groupBy("cluster", "pair").applyInArrow(_block_pair(percent, miss), "a long, b long"), "links-2"))
    return _merged(scratch, found, links, 1)


def _merged(scratch: Scratch, found: DataFrame, links: DataFrame, n: int) -> DataFrame:
    """``found`` (doc, component) after further links (a, b)."""
    named = found.select(F.col("doc").alias("k"), F.col("component").alias("c"))
    ends = links.join(named.select(F.col("k").alias("a"), F.col("c").alias("ac")), "a", "left").join(named.select(F.col("k").alias("b"), F.col("c").alias("bc")), "b", "left")
    ends = ends.select(F.coalesce("ac", "a").alias("a"), F.coalesce("bc", "b").alias("b"))
    merged = components(scratch, ends, "a", "b", f"round-{n}").select(F.col("node").alias("component"), F.col("component").alias("root"))
    grown = found.join(merged, "component", "left").select("doc", F.coalesce("root", "component").alias("component"))
    fresh = merged.select(F.col("component").alias("doc"), F.col("root").alias("component")).join(found.select("doc"), "doc", "left_anti")
    return scratch.write(grown.union(fresh), f"found-{n}")


def _rest(scratch: Scratch, active: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame | None] | None:
    """What is still to be compared: pairs (a, b), and (cluster, pair, doc, component) dealt to pairs of blocks.

    Only bands that still hold several components count. Of those of up to ``FEW`` documents, pairs from
    different components are listed. Larger ones, joined where they share a document, make clusters, in which
    the largest component needs no comparing within itself: its blocks meet only those of the cluster's other
    documents, which also meet each other.
    """
    whole = active.select("band", "doc").union(active.select("band", F.col("pivot").alias("doc")).distinct())
    labelled = scratch.write(whole.join(found, "doc", "left").select("band", "doc", F.coalesce("component", "doc").alias("component")), "labelled")
    bands = labelled.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min("doc").alias("pivot"), F.count("*").alias("n"))
    bands = scratch.write(bands.where("x < y").select("band", "pivot", "n"), "mixed")
    if bands.isEmpty():
        return None
    few = scratch.write(labelled.join(bands.where(F.col("n") <= FEW), "band").select("band", "doc", "component"), "few")
    other = few.select("band", F.col("doc").alias("b"), F.col("component").alias("b_component"))
    cold = scratch.write(few.join(other, "band").where("doc < b AND component != b_component").select(F.col("doc").alias("a"), "b").distinct(), "pairs-1")
    held = scratch.write(labelled.join(bands.where(F.col("n") > FEW), "band").select("doc", "component", "pivot").distinct(), "held")
    if held.isEmpty():
        return cold, None
    clusters = components(scratch, held, "doc", "pivot", "clusters").select(F.col("node").alias("doc"), F.col("component").alias("cluster"))
    docs = scratch.write(held.select("doc", "component").distinct().join(clusters, "doc"), "clustered")
    sizes = docs.groupBy("cluster", "component").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("component", F.struct("n", "component")).alias("main"))
    docs = docs.join(scratch.write(sizes.where("most < n"), "sizes"), "cluster")
    docs = docs.withColumn("own", F.when(F.col("component") == F.col("main"), "m").otherwise("s"))
    mains, others = (F.ceil(c / BLOCK) for c in (F.col("most"), F.col("n") - F.col("most")))
    docs = docs.withColumn("i", F.pmod(F.xxhash64("doc", F.lit(1)), F.when(F.col("own") == "m", mains).otherwise(others)))
    with_other = F.transform(F.sequence(F.lit(0), others - 1), lambda j: F.when(F.col("own") == "m", F.concat(F.lit("m"), "i", F.lit("-"), j)).otherwise(F.concat(F.lit("s"), F.least("i", j), F.lit("-"), F.greatest("i", j))))
    with_main = F.when(F.col("own") == "s", F.transform(F.sequence(F.lit(0), mains - 1), lambda j: F.concat(F.lit("m"), j, F.lit("-"), "i"))).otherwise(F.array().cast("array<string>"))
    return cold, docs.select("cluster", F.explode(F.concat(with_other, with_main)).alias("pair"), "doc", "component")


def _block_pair(percent: int, miss: float):
    """Links between documents of different components in one pair of blocks, enough to connect what they connect."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    least = least_matches(percent / 100, miss)

    def run(table: pa.Table) -> pa.Table:
        docs, parts = table.column("doc").to_numpy(), table.column("component").to_numpy()
        signed = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(len(docs), -1)
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        sizes = np.array([len(x) for x in sets])
        x, y = np.triu_indices(len(docs), 1)
        alive = (parts[x] != parts[y]) & (100 * np.minimum(sizes[x], sizes[y]) >= percent * np.maximum(sizes[x], sizes[y]))
        x, y = x[alive], y[alive]
        matches = np.zeros(len(x), np.int64)
        for k, need in enumerate(least):
            part = slice(k * BATCH, (k + 1) * BATCH)
            matches += (signed[x, part] == signed[y, part]).sum(axis=1)
            keep = matches >= need
            x, y, matches = x[keep], y[keep], matches[keep]
        if not len(x):
            return schema.empty_table()
        used = np.unique(np.concatenate((x, y)))
        row = np.zeros(len(docs), np.int64)
        row[used] = np.arange(len(used))
        _, column = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True)
        member = np.repeat(np.arange(len(used)), sizes[used])
        both = np.zeros((len(used), len(used)), np.float64)
        for first in range(0, int(column.max()) + 1, 1 << 14):
            inside = (column >= first) & (column < first + (1 << 14))
            holds = np.zeros((len(used), 1 << 14), np.float32)
            holds[member[inside], column[inside] - first] = 1
            both += holds @ holds.T
        shared = both[row[x], row[y]]
        linked = 100 * shared >= percent * (sizes[x] + sizes[y] - shared)
        root = {c: c for c in parts.tolist()}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        out = []
        for i, j in zip(x[linked].tolist(), y[linked].tolist(), strict=True):
            p, q = find(int(parts[i])), find(int(parts[j]))
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((int(docs[i]), int(docs[j])))
        return pa.table(list(zip(*out, strict=True)) if out else [[], []], schema=schema)

    return run


def deduplicated(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each near-duplicate group, with all columns.

    Rows that share a kept doc_id all stay, as do rows without doc_id and null or empty texts. Columns may have
    any names.
    """
    gone = unused(docs, "gone")
    marks = near_duplicates(docs, shingle_words, percent).where("NOT kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(marks, docs["doc_id"].cast("long") == marks[gone], "left_anti")
