"""Removal of word windows that already start earlier, by prefix-partitioned suffix trees.

A suffix is the words from a place on. Only its first ``WINDOW`` words matter, as a longer repeat shows as
repeats of consecutive windows. As in suffix tree construction on disk, suffixes are split by prefixes of
variable length into groups that fit in memory, and each group makes its own subtrees:

1. *Sparse suffixes.* Of a window's suffixes the one whose first ``ANCHOR`` words have the smallest hash stands
   for it, so that equal windows are held by suffixes of equal prefixes (about one for each eight words).
   Counting these prefixes over the whole corpus tells which windows can have an equal at all; those whose
   prefix occurs once are pruned before any text is moved.
2. *Variable-length prefixes.* Windows go to the group of their suffix's ``ANCHOR`` words. Where that prefix is
   found ``FREQUENT`` times or more it is lengthened to the window's own ``WINDOW`` words, and equal windows
   are first brought together by salted parts of a group, each of which hands on only its earliest. So no prefix
   brings more than a bounded number of windows to a group, however often it occurs. The words themselves are sent.
3. *Subtrees.* A group sorts its suffixes by their words, with ranks that double their length (1, 2, 4, 8, 16
   and ``WINDOW`` words); ranks are of words, not of hashes, so equal ones are equal strings. Suffixes of one
   rank are the leaves below an inner node of depth ``WINDOW`` or more; all but a node's earliest leaf are
   repeats, and maximal repeats are runs of consecutive ones.
4. Each document's repeats are joined to its text and the covered words removed.

Which prefixes occur more than once, or often, is told by Bloom filters of bounded size: a wrong yes moves
windows for nothing, or lengthens a prefix everywhere, and changes no result. Where prefixes are too many for
them, a join of places with the counts tells it instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.llm.common import BLOOM_MAX_BITS, Bloom, Scratch, batch_of, binary_array, chunks, hashes_of, mixed, shuffle_partitions, words

WINDOW, ANCHOR = 20, 6
#: Windows that one group may hold on average: about 30 bytes each.
GROUP_WINDOWS = 400_000
#: A prefix found this often is lengthened; parts that a long prefix is dealt to at first.
FREQUENT, SALTS = 5_000, 64
#: Prefixes that Bloom filters are made for, at least 4 bits each.
MOST_PREFIXES = BLOOM_MAX_BITS // 4
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
LOW = np.uint64(0xFFFFFFFF)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _places(parts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each window of some texts' words: text, start in it, window hash, index of its anchor; and the anchor hashes by index."""
    hashed = [hashes_of(p) for p in parts]
    sizes = np.array([len(h) for h in hashed], np.int64)
    flat = np.concatenate(hashed) if hashed else np.empty(0, np.uint64)
    n = len(flat)
    if n < WINDOW:
        return *(np.empty(0, np.int64),) * 2, np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(flat * _powers(BASE, n), out=sums[1:])
    back = _powers(BASE_INVERSE, n)

    def strings(k: int) -> np.ndarray:
        return mixed((sums[k:] - sums[:-k]) * back[: n - k + 1])

    anchors = strings(ANCHOR)
    low = (anchors & ~LOW) | np.arange(len(anchors), dtype=np.uint64)  # the leftmost of the smallest
    for step in (1, 2, 4):
        low = np.minimum(low[:-step], low[step:])
    low = np.minimum(low[: n - WINDOW + 1], low[WINDOW - ANCHOR - 7 :][: n - WINDOW + 1])
    text = np.repeat(np.arange(len(parts)), sizes)
    begins = np.repeat(np.cumsum(sizes) - sizes, sizes)
    inside = np.flatnonzero(text[: n - WINDOW + 1] == text[WINDOW - 1 :])
    return text[inside], inside - begins[inside], strings(WINDOW)[inside], (low[inside] & LOW).astype(np.int64), anchors


def _ordered(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, list[list[bytes]], np.ndarray]]:
    """A batch's texts by (doc_id, version), in runs: ids, versions, words, and which rows they are."""
    ids, versions = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
    order = np.lexsort((versions, ids))
    texts = batch.column(2).take(pa.array(order))
    for first, run in chunks(texts):
        at = order[first : first + len(run)]
        yield ids[at], versions[at], [words(t) if t else [] for t in run], at


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("anchor", pa.int64()), ("n", pa.int64())])
    for batch in batches:
        for _, _, parts, _ in _ordered(batch):
            *_, at, anchors = _places(parts)
            if len(at):
                keys, n = np.unique(anchors[np.unique(at)].view(np.int64), return_counts=True)
                yield batch_of(schema, keys, n)


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, version, anchor): each text's distinct prefixes."""
    schema = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("anchor", pa.int64())])
    for batch in batches:
        for ids, versions, parts, _ in _ordered(batch):
            text, _, _, at, anchors = _places(parts)
            found = np.unique(np.column_stack((text.view(np.uint64), anchors[at])), axis=0)
            own = found[:, 0].astype(np.int64)
            yield batch_of(schema, ids[own], versions[own], found[:, 1].copy().view(np.int64))


def _runs(text: np.ndarray, start: np.ndarray, *same: np.ndarray) -> np.ndarray:
    """Where a new run of consecutive starts begins."""
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1] + 1)
    for x in same:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


_SUFFIXES = pa.schema([("part", pa.int64()), ("long", pa.bool_()), ("doc_id", pa.int64()), ("version", pa.int64()), ("first", pa.int32()), ("n", pa.int32()), ("words", pa.binary())])
_COLUMNS = "part long, long boolean, doc_id long, version long, first int, n int, words binary"


def _unlike(run: list[tuple[list[bytes], int, list[bytes], int]]) -> list[bool]:
    """For each of some pairs of windows whether their words differ."""
    return [a[s : s + WINDOW] != b[t : t + WINDOW] for a, s, b, t in run]


def _suffixes(repeated: Bloom | None, frequent: Bloom | None, groups: int):
    """Windows that may have an equal, as runs of consecutive ones of a group with their words; -1 marks found repeats."""

    def told(batch: pa.RecordBatch, at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if repeated is not None:
            return repeated.test(keys), frequent.test(keys)
        lists = batch.column(3).take(pa.array(at)).flatten()
        known, often = lists.field("anchor").to_numpy(), lists.field("often").to_numpy(zero_copy_only=False)
        return np.isin(keys, known), np.isin(keys, known[often])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, versions, parts, rows in _ordered(batch):
                text, start, window, at, anchors = _places(parts)
                if not len(at):
                    continue
                used = np.unique(at)
                known, often = np.zeros(len(anchors), bool), np.zeros(len(anchors), bool)
                known[used], often[used] = told(batch, rows, anchors[used].view(np.int64))
                keep = known[at]
                text, start, window, at = text[keep], start[keep], window[keep], at[keep]
                if not len(at):
                    continue
                order = np.argsort(window, kind="stable")
                leaf = window[order]
                new = np.ones(len(leaf), bool)
                new[1:] = leaf[1:] != leaf[:-1]
                first = np.empty(len(leaf), np.int64)
                first[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]  # the earliest equal window of each
                own = first == np.arange(len(leaf))
                other = np.flatnonzero(~own)
                if len(other):  # hashes told them equal; words decide
                    pairs = [(parts[a], s, parts[b], t) for a, s, b, t in zip(text[other].tolist(), start[other].tolist(), text[first[other]].tolist(), start[first[other]].tolist(), strict=True)]
                    unlike = other[_unlike(pairs)]
                    first[unlike], own[unlike] = unlike, True
                twin = (ids[text] == ids[text[first]]) & (versions[text] == versions[text[first]]) & (start == start[first])
                gone = np.flatnonzero(~own & ~twin)
                if len(gone):
                    t, s = text[gone], start[gone]
                    runs = _runs(t, s)
                    sizes = np.diff(np.append(runs, len(gone)))
                    none = pa.nulls(len(runs), pa.binary())
                    yield batch_of(_SUFFIXES, np.full(len(runs), -1), np.zeros(len(runs), bool), ids[t[runs]], versions[t[runs]], s[runs].astype(np.int32), sizes.astype(np.int32), none)
                t, s, w, a = text[own], start[own], window[own], at[own]
                long = often[a]
                part = np.where(long, mixed(w ^ np.uint64(BASE)), anchors[a]) % np.uint64(groups)
                runs = _runs(t, s, part, long)
                sizes = np.diff(np.append(runs, len(t)))
                said = [b" ".join(parts[i][b : b + n + WINDOW - 1]) for i, b, n in zip(t[runs].tolist(), s[runs].tolist(), sizes.tolist(), strict=True)]
                yield batch_of(_SUFFIXES, part[runs].astype(np.int64), long[runs], ids[t[runs]], versions[t[runs]], s[runs].astype(np.int32), sizes.astype(np.int32), binary_array(said))

    return run


def _ranks(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Ranks of pairs of ranks, from 1."""
    return np.unique(left * (right.max(initial=0) + 1) + right, return_inverse=True)[1] + 1


def sorted_suffixes(flat: list[bytes], ends: np.ndarray) -> np.ndarray:
    """For each word the rank of the (at most) ``WINDOW`` words from it on, in the order of the words; ``ends`` of its row."""
    coded = pa.array(flat, pa.binary()).dictionary_encode()
    order = np.empty(len(coded.dictionary), np.int64)
    order[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(order))
    at = np.arange(len(flat))

    def further(ranks: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(len(flat), np.int64)  # 0 beyond the row's end comes before all words
        inside = at + n < ends
        out[inside] = ranks[at[inside] + n]
        return out

    rank = {1: order[coded.indices.to_numpy()] + 1}
    size = 1
    while 2 * size <= WINDOW:
        rank[2 * size] = _ranks(rank[size], further(rank[size], size))
        size *= 2
    done, out = size, rank[size]
    for size in sorted(rank, reverse=True):
        if size <= WINDOW - done:
            out, done = _ranks(out, further(rank[size], done)), done + size
    return out


def _leaves(table: pa.Table) -> tuple[np.ndarray, ...]:
    """A group's windows: row, document, version, start and rank, sorted by rank and then by place; and each rank's first."""
    n = table.column("n").to_numpy().astype(np.int64)
    sizes = n + WINDOW - 1
    flat = b" ".join(table.column("words").to_pylist()).split()
    begins = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(n)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    doc, version = (table.column(c).to_numpy()[row] for c in ("doc_id", "version"))
    start = table.column("first").to_numpy()[row] + offset
    leaf = sorted_suffixes(flat, np.repeat(begins + sizes, sizes))[begins[row] + offset]
    order = np.lexsort((start, version, doc, leaf))
    row, doc, version, start, leaf, offset = (x[order] for x in (row, doc, version, start, leaf, offset))
    new = np.ones(len(leaf), bool)
    new[1:] = leaf[1:] != leaf[:-1]
    return row, offset, doc, version, start, np.flatnonzero(new)[np.cumsum(new) - 1]


def _subtree(table: pa.Table) -> pa.Table:
    """The repeats of one group: leaves below a node of full depth, without the earliest."""
    _, _, doc, version, start, first = _leaves(table)
    gone = (doc != doc[first]) | (version != version[first]) | (start != start[first])
    return _repeats(doc[gone], version[gone], start[gone])


def _repeats(doc: np.ndarray, version: np.ndarray, start: np.ndarray) -> pa.Table:
    order = np.lexsort((start, version, doc))
    doc, version, start = doc[order], version[order], start[order]
    runs = _runs(doc, start, version)
    sizes = np.diff(np.append(runs, len(doc)))
    return pa.table({"doc_id": doc[runs], "version": version[runs], "first": start[runs].astype(np.int32), "n": sizes.astype(np.int32)})


def _earliest(table: pa.Table) -> pa.Table:
    """Of a part of a group the earliest of equal windows, to be handed on, and the others as repeats."""
    row, offset, doc, version, start, first = _leaves(table)
    gone = (doc != doc[first]) | (version != version[first]) | (start != start[first])
    found = _repeats(doc[gone], version[gone], start[gone])
    none = pa.nulls(found.num_rows, pa.binary())
    lost = pa.table([pa.array(np.full(found.num_rows, -1)), pa.array(np.zeros(found.num_rows, bool)), *found.columns, none], schema=_SUFFIXES)
    said = [w.split() for w in table.column("words").to_pylist()]
    own = np.flatnonzero(first == np.arange(len(first)))
    kept = [b" ".join(said[r][a : a + WINDOW]) for r, a in zip(row[own].tolist(), offset[own].tolist(), strict=True)]
    part = table.column("part").to_numpy()[row[own]]
    left = pa.table([pa.array(part), pa.array(np.ones(len(own), bool)), pa.array(doc[own]), pa.array(version[own]), pa.array(start[own].astype(np.int32)), pa.array(np.ones(len(own), np.int32)), binary_array(kept)], schema=_SUFFIXES)
    return pa.concat_tables([lost, left])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])
    for batch in batches:
        ids, texts, repeats = batch.column("doc_id"), batch.column("text"), batch.column("repeats")
        for first, run in chunks(texts):
            total, removed, kept = [], [], []
            for text, spans in zip(run, repeats.slice(first, len(run)).to_pylist(), strict=True):
                parts = words(text) if text else []
                total.append(len(parts))
                if spans:
                    stay = np.ones(len(parts), bool)
                    for s in spans:
                        stay[s["first"] : s["first"] + s["n"] + WINDOW - 1] = False
                    parts = [parts[i] for i in np.flatnonzero(stay).tolist()]
                removed.append(total[-1] - len(parts))
                kept.append(b" ".join(parts).decode("utf-8", "surrogatepass"))
            yield batch_of(schema, ids.slice(first, len(run)), total, removed, kept)


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, version, first, n): runs of ``n`` windows, from word ``first``, that also start earlier.

    ``docs`` has doc_id, version (a hash of the text) and text; rows without doc_id or text take no part.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring-dedup")
    docs = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "version", "text")
    counts = docs.mapInArrow(_count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")
    counts = scratch.write(counts, "prefixes")
    often = F.col("n") >= FREQUENT
    kinds, places, hot = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(often, 1))).first()
    groups = max(4 * shuffle_partitions(spark), places * (WINDOW - ANCHOR + 2) // 2 // GROUP_WINDOWS)
    if kinds <= MOST_PREFIXES:
        filters = Bloom(spark, counts.select("anchor"), kinds), Bloom(spark, counts.where(often).select("anchor"), hot)
    else:
        filters = None, None
        own = docs.mapInArrow(_prefixes, "doc_id long, version long, anchor long").distinct().join(counts.select("anchor", often.alias("often")), "anchor")
        lists = own.groupBy("doc_id", "version").agg(F.collect_list(F.struct("anchor", "often")).alias("prefixes"))
        docs = docs.join(lists, ["doc_id", "version"])
    found = scratch.write(docs.mapInArrow(_suffixes(*filters, groups), _COLUMNS), "suffixes")
    short = found.where("NOT long")
    if hot:
        salted = found.where("long").withColumn("salt", F.pmod(F.xxhash64("doc_id", "version", "first"), F.lit(SALTS)))
        salted = scratch.write(salted.groupBy("part", "salt").applyInArrow(lambda t: _earliest(t.drop_columns(["salt"])), _COLUMNS), "long")
        short = short.union(salted)
    else:
        short = short.union(found.where("long"))  # windows whose prefix a filter took for a frequent one
    trees = short.where("part >= 0").groupBy("part").applyInArrow(_subtree, "doc_id long, version long, first int, n int")
    return short.where("part < 0").select("doc_id", "version", "first", "n").union(trees)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_text (kept words joined by one space).

    A word goes when a window of 20 words covers it whose words also start earlier: in a document of
    smaller doc_id, or further ahead in the same one. A null or empty text has no words and an empty
    kept_text. A row without doc_id is kept whole and makes no other window a repeat. Equal rows are one
    document: each returns the same. Different texts under one doc_id count as documents of their own,
    ordered by a hash of their text. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("version", F.xxhash64("text"))
    spans = repeats(docs).groupBy("doc_id", "version").agg(F.collect_list(F.struct("first", "n")).alias("repeats"))
    return docs.join(spans, ["doc_id", "version"], "left").select("doc_id", "text", "repeats").mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_text string")
