"""Masked pseudo-likelihood of documents under a bidirectional window network, trained in numpy.

The network sees two words on either side of a masked word and predicts the word by the decisions on its
way down a Huffman tree, so that its probabilities over all leaves add up to one. The ``HEAD`` most frequent words
are leaves of their own; each of the others is under one of ``TAIL`` leaves, told by its last two bytes, and there
has the probability that corpus counts give it, all unseen words of a leaf together that of half a word. A
document's score is the sum of log P(word | both sides) over all its words.

Counting, training and scoring each read every document. Every distinct word is counted, by its 64-bit hash,
in a table that grows with the corpus. Scoring joins it; only the counts of the most frequent words, at most
``FREQUENT``, are broadcast instead. Texts are dealt by their hash to shards of about ``SHARD_WORDS`` words, and shards to rounds, of
which there are more the more text there is. In a round each shard trains on the network of the round before,
its texts in the order of their hashes; then the shards' steps are averaged, each parameter's by how often a
shard used it, in a tree of sums. So a network doesn't depend on how the documents are laid out in
partitions, and what the driver receives doesn't grow. Training predicts a fourth of all words, masked by chance from a fixed seed; scoring predicts all.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.llm.common import Scratch, batch_of, chunks, mixed, shuffle_partitions

HEAD, TAIL, SIDE, WIDTH, HIDDEN = 12_287, 512, 2, 16, 32
CLASSES = 1 + HEAD + TAIL  # class 0 lies beyond a document's ends
NODES = CLASSES - 2
#: Words whose counts are broadcast, at most (3 MB); and the fixed point of sums, so that their order doesn't matter.
FREQUENT, POINT = 1 << 17, 1 << 28
#: Words of a shard; one of MASKED words is predicted in training; words of a step; and the steps' size.
SHARD_WORDS, MASKED, BATCH, RATE = 1_000_000, 4, 1024, 0.1
RUN_CHARS = 6_000_000
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def word_codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word of some texts, in order: its text, a 64-bit hash and its tail class, by its last two bytes."""
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    flat = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    space = _SPACE[flat]
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    ends = np.flatnonzero(space[1:] & ~space[:-1]) + 1 if len(flat) else starts
    powers = np.full(len(flat), _BASE, np.uint64)
    powers[:1] = 1
    np.cumprod(powers, out=powers)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * powers)))
    back = np.full(len(flat), _BACK, np.uint64)
    back[:1] = 1
    np.cumprod(back, out=back)
    hashes = mixed((sums[ends] - sums[starts]) * back[starts])
    last = flat[ends - 1].astype(np.uint64) << np.uint64(8) | np.where(ends - 2 >= starts, flat[np.maximum(ends - 2, 0)], 0).astype(np.uint64)
    docs = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), starts, side="right")
    return docs, hashes, (mixed(last + np.uint64(7)) % np.uint64(TAIL)).astype(np.int64)


def _find(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where keys are in an ascending array, and whether they are."""
    at = np.searchsorted(known, keys)
    at[at == len(known)] = 0
    return at, known[at] == keys if len(known) else np.zeros(len(keys), bool)


class Tree(NamedTuple):
    """For each class the inner nodes on its way from the root, and 1 or -1 for the side that it is on."""

    offsets: np.ndarray
    nodes: np.ndarray
    signs: np.ndarray

    def ways(self, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of some classes' ways, one after the other: lengths, starts, nodes and sides."""
        n = self.offsets[classes + 1] - self.offsets[classes]
        starts = np.cumsum(n) - n
        at = np.arange(n.sum()) + np.repeat(self.offsets[classes] - starts, n)
        return n, starts, self.nodes[at], self.signs[at]


def huffman(counts: np.ndarray) -> tuple[Tree, np.ndarray]:
    """The tree over classes 1 and on, and for each inner node the log odds of its first side."""
    heap = [(int(n) + 1, c) for c, n in enumerate(counts) if c]
    heapq.heapify(heap)
    parent, side, odds = np.zeros(2 * len(counts), np.int64), np.zeros(2 * len(counts), np.float32), np.zeros(len(counts) - 2)
    for node in range(len(counts) - 2):
        (n, a), (m, b) = heapq.heappop(heap), heapq.heappop(heap)
        parent[[a, b]], side[[a, b]], odds[node] = node, (1, -1), math.log(n / m)
        heapq.heappush(heap, (n + m, len(counts) + node))
    root, ways = len(counts) - 3, [[]]
    for c in range(1, len(counts)):
        way, at = [], c
        while at != len(counts) + root:
            way.append((parent[at], side[at]))
            at = len(counts) + parent[at]
        ways.append(way[::-1])
    flat = [step for way in ways for step in way]
    return Tree(np.concatenate(([0], np.cumsum([len(w) for w in ways]))), np.array([n for n, _ in flat], np.int32), np.array([x for _, x in flat], np.float32)), odds


def _find(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where keys are in an ascending array, and whether they are."""
    at = np.searchsorted(known, keys)
    at[at == len(known)] = 0
    return at, known[at] == keys if len(known) else np.zeros(len(keys), bool)


class Vocabulary(NamedTuple):
    #: Hashes of the most frequent words, ascending; the class of those that have one (else 0); log P(word | class).
    known: np.ndarray
    known_class: np.ndarray
    known_log: np.ndarray
    #: For each tail class the logarithm of its words' smoothed counts together, unseen ones counting as one word.
    total: np.ndarray
    tree: Tree

    def classes(self, hashes: np.ndarray, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Classes of words, log P(word | class) of each, and which of them still lack the logarithm of their count."""
        at, found = _find(self.known, hashes)
        out, within = 1 + HEAD + tails, -self.total[tails]
        if len(self.known):
            own = found & (self.known_class[at] > 0)
            out = np.where(own, self.known_class[at], out)
            within = np.where(found, self.known_log[at], within)
        return out, within, ~found


class Network(NamedTuple):
    """Parameters, and of each the sum of squared steps that sets its rate."""

    word: np.ndarray
    word_rate: np.ndarray
    node: np.ndarray
    odds: np.ndarray
    node_rate: np.ndarray
    inner: np.ndarray
    bias: np.ndarray
    inner_rate: np.ndarray


#: Which count weighs a parameter's mean: uses of its word, uses of its node, or all predictions.
_BY = (0, 0, 1, 1, 1, 2, 2, 2)


def initial(odds: np.ndarray) -> Network:
    """The start: the words' frequencies whatever the sides are."""
    r = np.random.default_rng(11)
    word = (r.standard_normal((CLASSES, WIDTH)) * 0.5).astype(np.float32)
    inner = (r.standard_normal((2 * SIDE * WIDTH, HIDDEN)) / np.sqrt(2 * SIDE * WIDTH)).astype(np.float32)
    ones = lambda *shape: np.full(shape, 1.0, np.float32)
    return Network(word, ones(CLASSES), np.zeros((NODES, HIDDEN), np.float32), odds.astype(np.float32), ones(NODES), inner, np.zeros(HIDDEN, np.float32), ones(2 * SIDE * WIDTH, HIDDEN))


def windows(docs: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The classes of the words on both sides of each word, 0 beyond its document."""
    out = np.zeros((len(classes), 2 * SIDE), np.int64)
    for column, step in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        a, b = max(0, -step), len(classes) - max(0, step)
        if a < b:
            near = slice(a + step, b + step)
            out[a:b, column] = np.where(docs[near] == docs[a:b], classes[near], 0)
    return out


def _decisions(net: Network, tree: Tree, sides: np.ndarray, classes: np.ndarray) -> tuple:
    seen = net.word[sides].reshape(len(sides), -1)
    hidden = np.tanh(seen @ net.inner + net.bias)
    n, starts, nodes, signs = tree.ways(classes)
    vectors, spread = net.node[nodes], np.repeat(hidden, n, axis=0)
    margin = np.clip((np.einsum("ij,ij->i", spread, vectors) + net.odds[nodes]) * signs, -30, 30)
    return seen, hidden, starts, nodes, signs, vectors, spread, np.exp(-margin)


def log_probabilities(net: Network, tree: Tree, sides: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """log P(class | classes on both sides)."""
    out = np.empty(len(classes))
    for a in range(0, len(classes), 4096):
        part = slice(a, a + 4096)
        _, _, starts, *_, against = _decisions(net, tree, sides[part], classes[part])
        out[part] = -np.add.reduceat(np.log1p(against), starts)
    return out


def _rows(index: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct indices and the sums of the values at each."""
    order = np.argsort(index, kind="stable")
    new = np.flatnonzero(np.diff(index[order], prepend=-1))
    return index[order][new], np.add.reduceat(values[order], new)


def descend(net: Network, tree: Tree, sides: np.ndarray, classes: np.ndarray, uses: tuple[np.ndarray, np.ndarray]) -> None:
    """One pass of mini-batch steps on masked words, each parameter at a rate that falls with its own steps; in place."""
    for a in range(0, len(classes), BATCH):
        x, y = sides[a : a + BATCH], classes[a : a + BATCH]
        seen, hidden, starts, nodes, signs, vectors, spread, against = _decisions(net, tree, x, y)
        slope = (signs * against / (1 + against)).astype(np.float32)
        back = np.add.reduceat(slope[:, None] * vectors, starts) * (1 - hidden * hidden)
        at, step = _rows(nodes, np.column_stack((slope[:, None] * spread, slope)))
        net.node_rate[at] += (step * step).mean(axis=1)
        step *= (RATE / np.sqrt(net.node_rate[at]))[:, None]
        net.node[at] += step[:, :-1]
        net.odds[at] += step[:, -1]
        uses[1][at] += 1
        inner = seen.T @ back
        at, step = _rows(x.reshape(-1), (back @ net.inner.T).reshape(-1, WIDTH))
        net.word_rate[at] += (step * step).mean(axis=1)
        net.word[at] += step * (RATE / np.sqrt(net.word_rate[at]))[:, None]
        uses[0][at] += 1
        net.inner_rate[...] += inner * inner
        net.inner[...] += RATE * inner / np.sqrt(net.inner_rate)
        net.bias[...] += RATE * back.sum(axis=0) / np.sqrt(net.inner_rate.mean(axis=0))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, tail, n): each distinct word of all texts by its hash, its tail class and how often it occurs."""
    schema = pa.schema([("word", pa.int64()), ("tail", pa.int32()), ("n", pa.int64())])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in chunks(batch.column(0), RUN_CHARS):
                _, hashes, tails = word_codes(texts)
                found, first, n = np.unique(hashes, return_index=True, return_counts=True)
                yield batch_of(schema, found.view(np.int64), tails[first].astype(np.int32), n.astype(np.int64))

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(local, "word long, tail int, n long")
    return Scratch(docs.sparkSession, "pseudo-likelihood").write(rows.groupBy("word").agg(F.min("tail").alias("tail"), F.sum("n").alias("n")), "words")


def vocabulary(words: DataFrame) -> tuple[Vocabulary, np.ndarray, int]:
    """What is broadcast of the counts: words that occur often, sums of the tail's classes, the tree; its odds; and all words' number."""
    head = words.orderBy(F.desc("n"), "word").limit(HEAD).collect()
    frequency, n, distinct = np.zeros(CLASSES), np.zeros(TAIL), np.zeros(TAIL)
    for r in words.groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():  # TAIL at most
        n[r.tail], distinct[r.tail] = r.n, r.words
    whole = int(n.sum())
    for i, r in enumerate(head, 1):
        frequency[i] = r.n
        n[r.tail] -= r.n
        distinct[r.tail] -= 1
    frequency[HEAD + 1 :] = n
    total = np.log(n + 0.5 * (distinct + 1))
    sizes = {r.size: r.words for r in words.groupBy(F.floor(F.log2("n")).cast("int").alias("size")).agg(F.count("*").alias("words")).collect()}  # 63 at most
    least, held = max(sizes, default=0) + 1, 0
    while least > 0 and held + sizes.get(least - 1, 0) <= FREQUENT - HEAD:
        least -= 1
        held += sizes.get(least, 0)
    often = words.where(F.floor(F.log2("n")) >= least).select("word", "tail", "n").toArrow()  # FREQUENT at most
    hashes, counts, tails = (often.column(c).to_numpy() for c in ("word", "n", "tail"))
    own = np.array([r.word for r in head], np.int64)
    rest = ~np.isin(hashes, own)
    known = np.concatenate((own, hashes[rest])).view(np.uint64)
    classes = np.concatenate((np.arange(1, len(own) + 1), np.zeros(rest.sum(), np.int64)))
    logs = np.concatenate((np.zeros(len(own)), np.log(counts[rest] + 0.5) - total[tails[rest]]))
    order = np.argsort(known)
    tree, odds = huffman(frequency)
    return Vocabulary(known[order], classes[order], logs[order], total, tree), odds, whole


class Model(NamedTuple):
    vocabulary: Vocabulary
    network: Network
    #: The counts of all words, as of :func:`word_counts`.
    words: DataFrame


def rounds_of(shards: int) -> int:
    return 1 if shards < 2 else min(shards, 2 + int(math.log2(shards)))


def train(docs: DataFrame) -> Model:
    """A model from all rows of ``docs`` (doc_id, text); null and wordless texts teach nothing, repeated rows count each time.

    The rows' order and partitions make no difference. Rows that are equal in doc_id and text are in one shard.
    """
    spark = docs.sparkSession
    counts = word_counts(docs)
    words, odds, whole = vocabulary(counts)
    net, shards = initial(odds), max(1, round(whole / SHARD_WORDS))
    rounds = rounds_of(shards)
    shared = spark.sparkContext.broadcast(words)  # about 3 MB, whatever the corpus
    schema = pa.schema([("key", pa.int64()), ("classes", pa.binary())])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in chunks(batch.column(1)):
                doc, hashes, tails = word_codes(texts)
                classes = shared.value.classes(hashes, tails)[0].astype("<u2")
                cuts = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(texts))))) * 2
                yield batch_of(schema, batch.column(0).slice(first, len(texts)), pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(classes.tobytes())]))

    texts = docs.where("text IS NOT NULL").select(F.xxhash64("doc_id", "text").alias("key"), F.col("text").cast("string").alias("text"))
    scratch = Scratch(spark, "pseudo-likelihood")
    rows = scratch.write(texts.mapInArrow(coded, "key long, classes binary").where("length(classes) > 0").withColumn("shard", F.pmod("key", F.lit(shards)).cast("int")), "classes")
    for n in range(rounds if whole else 0):
        held = len(range(n, shards, rounds))
        parts = min(held, max(shuffle_partitions(spark), held // 4))
        own = rows.where(F.col("shard") % rounds == n).repartition(parts, "shard").sortWithinPartitions("shard", "key", "classes")
        net = _averaged(net, own.select("shard", "classes").mapInArrow(_steps(spark.sparkContext.broadcast((words.tree, net))), "total binary"), parts)
    return Model(words, net, counts)


def _steps(shared):
    """For each task one row: its shards' steps, weighted by uses, and these uses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, start = shared.value
        total = [np.zeros(x.shape) for x in start]
        used = [np.zeros(CLASSES), np.zeros(NODES), np.zeros(1)]
        shard, buffer, held = None, [], 0

        def learn() -> None:
            nonlocal held
            if held:
                classes = np.concatenate(buffer).astype(np.int64)
                sides = windows(np.repeat(np.arange(len(buffer)), [len(b) for b in buffer]), classes)
                picked = np.flatnonzero(chance.integers(0, MASKED, len(classes)) == 0)
                descend(net, tree, sides[picked], classes[picked], uses)
                uses[2][0] += len(picked)
            buffer.clear()
            held = 0

        def close() -> None:
            learn()
            if shard is not None:
                for t, x, old, by in zip(total, net, start, _BY, strict=True):
                    t += (x - old) * uses[by].reshape(-1, *[1] * (x.ndim - 1))
                for t, u in zip(used, uses, strict=True):
                    t += u

        for batch in batches:
            for at, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if at != shard:
                    close()
                    shard, net, chance = at, Network(*(x.copy() for x in start)), np.random.default_rng(at)
                    uses = [np.zeros(CLASSES), np.zeros(NODES), np.zeros(1)]
                buffer.append(np.frombuffer(blob, "<u2"))
                held += len(buffer[-1])
                if held >= 200_000:
                    learn()
        close()
        if shard is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([x.ravel() for x in (*total, *used)]).astype(np.float32).tobytes()], pa.binary())], ["total"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for value in batch.column(0):
            own = np.frombuffer(value.as_py(), np.float32).astype(np.float64)
            total = own if total is None else total + own
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["total"])


def _averaged(net: Network, steps: DataFrame, parts: int) -> Network:
    """The network moved by the mean of its shards' steps; sums go through a tree, at most 16 rows to the driver at a time."""
    while parts > 16:
        parts = -(-parts // 16)
        steps = steps.repartition(parts).mapInArrow(_added, "total binary")
    total = np.zeros(sum(x.size for x in net) + CLASSES + NODES + 1)
    for row in steps.collect():
        total += np.frombuffer(row[0], np.float32)
    cuts = np.cumsum([*(x.size for x in net), CLASSES, NODES])
    *moved, words, nodes, all_ = np.split(total, cuts)
    uses = [np.maximum(x, 1.0) for x in (words, nodes, all_)]
    return Network(*((x + m.reshape(x.shape) / uses[by].reshape(-1, *[1] * (x.ndim - 1))).astype(np.float32) for x, m, by in zip(net, moved, _BY, strict=True)))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_words, log_likelihood, per_word for each row of ``docs`` (doc_id, text).

    log_likelihood is the sum of log P(word | words on both sides) over the whole text, per_word its mean.
    A null or wordless text has 0 words, log_likelihood 0 and per_word null. Equal rows score alike; other
    columns are ignored. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.vocabulary, model.network))  # about 6 MB
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("known", pa.float64()), ("rare", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, net = shared.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, texts in chunks(batch.column(1)):
                doc, hashes, tails = word_codes(texts)
                classes, within, rare = vocabulary.classes(hashes, tails)
                value = log_probabilities(net, vocabulary.tree, windows(doc, classes), classes) + within
                n, total = np.bincount(doc, minlength=len(texts)), np.bincount(doc, value, len(texts))
                cuts = np.concatenate(([0], np.cumsum(np.bincount(doc[rare], minlength=len(texts))))).astype(np.int32)
                yield batch_of(schema, np.arange(row, row + len(texts)), batch.column(0).slice(first, len(texts)), n, total, pa.ListArray.from_arrays(cuts, hashes[rare].view(np.int64)))
                row += len(texts)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = Scratch(docs.sparkSession, "pseudo-likelihood").write(texts.mapInArrow(run, "row long, doc_id long, n_words long, known double, rare array<long>"), "rows")
    logs = F.round(F.log(F.coalesce("n", F.lit(0)) + 0.5) * POINT).cast("long")
    rare = found.select("row", F.explode("rare").alias("word")).join(model.words.select("word", "n"), "word", "left").groupBy("row").agg((F.sum(logs) / POINT).alias("logs"))
    total = F.col("known") + F.coalesce("logs", F.lit(0.0))
    return found.join(rare, "row", "left").select("doc_id", "n_words", total.alias("log_likelihood"), F.when(F.col("n_words") > 0, total / F.col("n_words")).alias("per_word"))
