"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared as UTF-8 bytes after lower-casing, with runs of spaces, ASCII signs and control
characters as one space. A test item may occur with ``budget`` edits: it is cut in budget + 1 pieces, one of
which must then occur unchanged. One Aho-Corasick automaton finds the pieces of a block of items in whole
texts; the text around a hit is verified with Myers' bit-parallel distance, a machine word as wide as the
item. Short items are searched for with a space on either side, so as whole words. Items are taken in blocks of at most ``BLOCK_CHARS`` characters, so neither an automaton nor what is
sent to the executors grows with the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.llm.common import Scratch, batch_of

#: Edits allowed for each hundred bytes of an item; items shorter than ``SHORTEST`` are searched for as whole words.
EDITS_PERCENT, SHORTEST, BLOCK_CHARS = 8, 25, 1_000_000
#: Blocks (16 MB in all) that one pass over the documents takes; more are further passes over a written table.
BLOCKS = 16
#: Characters of texts that are taken together where there are several blocks, so that automata are made once for each so many.
BUFFER_CHARS = 32_000_000
_SIGNS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def normalised(text: str) -> str:
    """Words joined by one space, one character for each byte."""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_SIGNS).split()).decode("latin-1")


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): budget + 1 pieces of nearly equal length that make up the item."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def distance(item: str, text: str, most: int, masks: dict[str, int] | None = None) -> int | None:
    """The least edit distance between the item and any part of the text, None if over ``most`` (Myers, 1999)."""
    if not item:
        return 0
    masks = peq(item) if masks is None else masks
    ones, last = (1 << len(item)) - 1, 1 << (len(item) - 1)
    up, down, now, best = ones, 0, len(item), len(item)  # vertical steps of +1 and -1; the distance in the last row
    for c in text:
        eq = masks.get(c, 0)
        across = (((eq & up) + up) ^ up) | eq
        plus, minus = down | ~(across | up), up & across
        if plus & last:
            now += 1
        elif minus & last:
            now -= 1
            if now < best:
                best = now
        plus, minus, eq = plus << 1, minus << 1, eq | down
        up, down = (minus | ~(eq | plus)) & ones, plus & eq & ones
    return best if best <= most else None


class Items:
    """A block of normalised test items, ready for matching."""

    def __init__(self, items: list[tuple[int, str]], percent: int):
        self.items = {i: (text if len(text) >= SHORTEST else f" {text} ", len(text) * percent // 100, peq(text if len(text) >= SHORTEST else f" {text} ")) for i, text in items if text}
        #: Short items of one word: a text that holds one is a copy only if it is nothing else.
        self.words = {i: text for i, text in items if text and len(text) < SHORTEST and " " not in text}
        found: dict[str, list[tuple[int, int]]] = {}
        for i, (text, budget, _) in self.items.items():
            for offset, piece in pieces(text, budget):
                found.setdefault(piece, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        if found:
            self.automaton.make_automaton()
        self.verify = lru_cache(maxsize=20_000)(self._verify)

    def _verify(self, item: int, part: str) -> int | None:
        text, budget, masks = self.items[item]
        return distance(text, part, budget, masks)

    def matches(self, text: str) -> dict[int, int]:
        """The items that a normalised text holds, with their least distance."""
        out: dict[int, int] = {}
        if not len(self.automaton):
            return out
        text = f" {text} "
        spans: dict[int, list[list[int]]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for item, offset in places:
                whole, budget, _ = self.items[item]
                if not budget:
                    out[item] = 0
                    continue
                a = end + 1 - size - offset
                a, b = max(0, a - budget), a + len(whole) + budget
                runs = spans.setdefault(item, [])
                if runs and a <= runs[-1][1] and max(b, runs[-1][1]) - runs[-1][0] <= 4 * len(whole):
                    runs[-1][0], runs[-1][1] = min(a, runs[-1][0]), max(b, runs[-1][1])
                else:
                    runs.append([a, b])
        for item, runs in spans.items():
            found = [d for a, b in runs if (d := self.verify(item, text[a:b])) is not None]
            if found:
                out[item] = min(found)
        return out

    def copied(self, item: int, text: str) -> bool:
        """Whether an item that a normalised text holds makes the text contaminated."""
        return self.words.get(item, text) == text


def peq(item: str) -> dict[str, int]:
    """For each character the bits of its places in the item."""
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The normalised items, at most ``BLOCK_CHARS`` characters (or one item) at a time."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    block, chars = [], 0
    for row in rows.orderBy("i").toLocalIterator():
        text = normalised(row.t)
        if block and chars + len(text) > BLOCK_CHARS:
            yield block
            block, chars = [], 0
        block.append((row.i, text))
        chars += len(text)
    if block:
        yield block


def _buffers(batches: Iterator[pa.RecordBatch], text: int, chars: int) -> Iterator[pa.Table]:
    """Batches, several together up to a number of characters (or one)."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(text).nbytes
        if size >= chars:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


class _Blocks:
    """Blocks of items whose automata are made one at a time; a single one is kept."""

    def __init__(self, blocks: list, percent: int):
        self.blocks, self.percent, self.only = blocks, percent, None

    def __iter__(self) -> Iterator[Items]:
        for block in self.blocks:
            items = self.only or Items(block.value, self.percent)
            if len(self.blocks) == 1:
                self.only = items
            yield items

    @property
    def chars(self) -> int:
        return BUFFER_CHARS if len(self.blocks) > 1 else 0


def _pass(rows: DataFrame, blocks: list[list[tuple[int, str]]], percent: int) -> DataFrame:
    """``rows`` (doc_id, text, held) with the matches of some blocks added to held."""
    shared = [rows.sparkSession.sparkContext.broadcast(b) for b in blocks]  # BLOCKS * BLOCK_CHARS at most
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("held", pa.list_(pa.struct([("item", pa.int64()), ("distance", pa.int32()), ("copied", pa.bool_())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = _Blocks(shared, percent)
        for table in _buffers(batches, 1, every.chars):
            held: list[dict[int, tuple[int, bool]]] = [{h["item"]: (h["distance"], h["copied"]) for h in old or ()} for old in table.column(2).to_pylist()]
            for items in every:
                for own, text in zip(held, table.column(1), strict=True):
                    if text.is_valid:
                        plain = normalised(text.as_py())
                        for item, d in items.matches(plain).items():
                            before, copied = own.get(item, (d, False))
                            own[item] = min(d, before), copied or items.copied(item, plain)
            found = [[{"item": i, "distance": d, "copied": c} for i, (d, c) in sorted(own.items())] for own in held]
            at = 0
            for batch in table.to_batches():
                yield batch_of(schema, batch.column(0), batch.column(1), found[at : at + batch.num_rows])
                at += batch.num_rows

    return rows.mapInArrow(run, "doc_id long, text string, held array<struct<item: long, distance: int, copied: boolean>>")


def contamination(docs: DataFrame, benchmark: DataFrame, percent: int = EDITS_PERCENT) -> DataFrame:
    """doc_id, contaminated, item_ids, distances for each row of ``docs`` (doc_id, text).

    item_ids are the items of ``benchmark`` (item_id, text) of which the text holds a copy with at most
    percent edits for each hundred bytes, ascending, and distances their least edit distances. Null and empty
    texts hold nothing; items without id or words are held by nothing. Items under ``SHORTEST`` bytes are held as
    whole words; those of one word are listed wherever they occur, but as any text may use a word they make a
    document contaminated only if it consists of them. Equal rows give equal results; other columns are ignored.
    """
    scratch, blocks, n = Scratch(docs.sparkSession, "decontamination"), [], 0
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("held", F.lit(None).cast("array<struct<item: long, distance: int, copied: boolean>>"))
    for block in _blocks(benchmark):
        if len(blocks) == BLOCKS:
            rows, blocks, n = scratch.write(_pass(rows, blocks, percent), f"pass-{n}"), [], n + 1
        blocks.append(block)
    rows = _pass(rows, blocks, percent) if blocks else rows.withColumn("held", F.array().cast("array<struct<item: long, distance: int, copied: boolean>>"))
    return rows.select("doc_id", F.exists("held", lambda h: h.copied).alias("contaminated"), F.col("held.item").alias("item_ids"), F.col("held.distance").alias("distances"))


def uncontaminated(docs: DataFrame, benchmark: DataFrame, percent: int = EDITS_PERCENT) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns; one pass for each ``BLOCKS`` blocks.

    Null and empty texts stay. The text column must hold strings.
    """
    blocks = []
    for block in _blocks(benchmark):
        if len(blocks) == BLOCKS:
            docs, blocks = _clean(docs, blocks, percent), []
        blocks.append(block)
    return _clean(docs, blocks, percent) if blocks else docs


def _clean(docs: DataFrame, blocks: list[list[tuple[int, str]]], percent: int) -> DataFrame:
    shared = [docs.sparkSession.sparkContext.broadcast(b) for b in blocks]  # BLOCKS * BLOCK_CHARS at most
    at = [c.lower() for c in docs.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = _Blocks(shared, percent)
        for table in _buffers(batches, at, every.chars):
            clean = [True] * table.num_rows
            for items in every:
                for i, t in enumerate(table.column(at)):
                    if clean[i] and t.is_valid:
                        plain = normalised(t.as_py())
                        clean[i] = not any(items.copied(item, plain) for item in items.matches(plain))
            yield from table.filter(pa.array(clean, pa.bool_())).to_batches()

    return docs.mapInArrow(run, docs.schema)
