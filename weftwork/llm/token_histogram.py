"""Exact token counts for every context limit from one histogram of encoded lengths.

Documents are encoded where they are read and only (length, documents) pairs are shuffled, combined
in each batch and again map-side. Suffix sums run in two levels, within blocks of ``BLOCK`` lengths and
over the blocks' totals, so no task sees more than one block or one row for each block.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftwork.llm.common import Scratch, batch_of

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenisation pattern that this byte-level vocabulary was made with.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK = 1024
#: Runs of white space of this length are encoded by themselves: the pattern's look-ahead takes a stack frame for each character.
LONG = 10_000
_SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{100,}")


@lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
    return tiktoken.Encoding("weftwork", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(encoding_: tiktoken.Encoding, text: str) -> list[int]:
    """The tokens of a text, however long its runs of white space are.

    The pattern cuts such a run before its last character, which belongs to what follows, or at the text's
    end; cutting there first leaves all tokens as they were.
    """
    if len(text) < LONG:
        return encoding_.encode_ordinary(text)
    out, at = [], 0
    for m in _SPACES.finditer(text):
        a, b = m.span()
        if b - a >= LONG:
            end = b if b == len(text) else b - 1
            out += encoding_.encode_ordinary(text[at:a])
            out += encoding_._encode_single_piece(text[a:end])
            at = end
    return out + encoding_.encode_ordinary(text[at:])


def length_histogram(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(n_tokens, n_docs): documents by encoded length of their whole text. A null text has no tokens, as an empty one.

    Each row counts, repeated ones too; other columns than text are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, tokens = pa.schema([("n_tokens", pa.int64()), ("n_docs", pa.int64())]), encoding(tokenizer)
        for batch in batches:
            if batch.num_rows:
                lengths = [len(encoded(tokens, t)) if t else 0 for t in (x.as_py() for x in batch.column(0))]
                yield batch_of(schema, *np.unique(np.array(lengths, np.int64), return_counts=True))

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "n_tokens long, n_docs long")
    return counted.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row for each encoded length n_tokens that occurs, from which every context limit can be answered.

    n_docs; docs_shorter and docs_longer (strictly); tokens_up_to (tokens of documents of at most this
    length); truncated_total (tokens left when every document is cut at this length); docs_total;
    tokens_total. An empty table gives no rows. See :func:`at_limits` and :func:`quantiles`.
    """
    scratch = Scratch(docs.sparkSession, "token-counts")  # written, so that texts are encoded once
    return suffix_sums(scratch.write(length_histogram(docs, tokenizer), "histogram"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    h = histogram.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    later = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    blocks = blocks.select("block", *(F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_later") for c in "dt"), *(F.sum(c).over(W.partitionBy(F.lit(0))).alias(f"{c}_all") for c in "dt"))
    within = W.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, -1)

    def longer(c: str, total: str) -> Column:
        return F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"{total}_later")

    h = h.join(blocks, "block").withColumn("docs_longer", longer("n_docs", "d")).withColumn("tokens_longer", longer("tokens", "t"))
    kept = F.col("t_all") - F.col("tokens_longer")
    return h.select(
        "n_tokens", "n_docs",
        (F.col("d_all") - F.col("docs_longer") - F.col("n_docs")).alias("docs_shorter"), "docs_longer",
        kept.alias("tokens_up_to"), (kept + F.col("n_tokens") * F.col("docs_longer")).alias("truncated_total"),
        F.col("d_all").alias("docs_total"), F.col("t_all").alias("tokens_total"),
    )


def at_limits(counts: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, docs_over, truncated_total) for any context limits, from the result of :func:`token_counts`."""
    over = F.when(F.col("n_tokens") > F.col("limit"), F.col("n_docs")).otherwise(0)
    cut = F.least("n_tokens", "limit") * F.col("n_docs")
    each = F.explode(F.array(*(F.lit(int(x)).cast("long") for x in limits)).cast("array<long>"))
    return counts.select("n_tokens", "n_docs", each.alias("limit")).groupBy("limit").agg(F.sum(over).alias("docs_over"), F.sum(cut).alias("truncated_total"))


def quantiles(counts: DataFrame, fractions: list[float]) -> DataFrame:
    """(fraction, n_tokens): the least length that at least this part of the documents doesn't exceed."""
    reached = F.col("docs_shorter") + F.col("n_docs") >= F.col("fraction") * F.col("docs_total")
    return counts.select("*", F.explode(F.array(*(F.lit(float(x)) for x in fractions))).alias("fraction")).where(reached).groupBy("fraction").agg(F.min("n_tokens").alias("n_tokens"))
