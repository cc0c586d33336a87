"""Toxicity from a weighted lexicon that is matched by Aho-Corasick on folded text.

Folding undoes compatibility forms, removes zero-width characters, lower-cases, maps Cyrillic, Greek and
Latin look-alikes to Latin letters and digits and signs to the letters they stand for. Terms are whole
words, word beginnings, or phrases; an exception phrase cancels the terms inside it. A text's density is
the weight of its terms for each word, and its score a fixed function of that density.

Besides a short fixed list the lexicon is learned: from at most ``SAMPLE`` labelled texts of each class
(the only bounded sample here; near copies in it count once) come the word beginnings that toxic texts
hold far more often than chance allows, their weights and the density at which the score is 0.7.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.llm.common import Scratch, batch_of, hashes_of, shuffle_partitions

SAMPLE, THRESHOLD = 6_000, 0.7
# Words and phrases that the lexicon holds before anything is learned, all of weight 1.
WORDS = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
EXCEPTIONS = ("class clown", "clown fish", "clownfish", "idiot light", "idiot proof", "idiot-proof", "loser bracket", "pond scum", "trash bag", "trash bin", "trash can", "trash collection", "worthless check")
# Look-alikes of Latin letters (Cyrillic, Greek, Latin), then digits and signs; l, i and 1 fold together.
ALIKE = {
    "a": "аα4@", "b": "вβ8", "c": "сϲ", "d": "ԁ", "e": "еεё3", "g": "ɡ9", "h": "һ", "i": "іιıӏl1|!", "j": "ј", "k": "кκ", "m": "м", "n": "пո",
    "o": "оοօ0", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ5$", "t": "тτ7", "u": "υս", "v": "ν", "w": "ԝѡ", "x": "хχ", "y": "уγ",
}
ZERO_WIDTH = dict.fromkeys(map(ord, "­​‌‍⁠﻿"))
FOLD = {ord(c): letter for letter, alike in ALIKE.items() for c in alike}
#: Word beginnings of these lengths are candidates; chance that one is as one-sided as seen must be below ``CHANCE``.
BEGINNINGS, CHANCE = range(3, 13), 1e-6
FLOOR = 1e-4


class Lexicon(NamedTuple):
    #: (term, whole word, weight)
    terms: tuple[tuple[str, bool, float], ...]
    exceptions: tuple[str, ...]
    #: The density whose score is ``THRESHOLD``.
    middle: float


DEFAULT = Lexicon(tuple((w, True, 1.0) for w in WORDS), EXCEPTIONS, 0.004)


def cleaned(text: str) -> str:
    """Lower-cased, compatibility forms and zero-width characters undone."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(ZERO_WIDTH)
    return text.lower()


class Matcher:
    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.automaton = lexicon, ahocorasick.Automaton()
        entries: dict[str, tuple[int, bool, float]] = {}
        for term, whole, weight in lexicon.terms:
            entries[term.translate(FOLD)] = (len(term), whole, weight)
        for phrase in lexicon.exceptions:
            entries[phrase.translate(FOLD)] = (len(phrase), True, 0.0)
        for key, value in entries.items():
            self.automaton.add_word(key, value)
        if entries:
            self.automaton.make_automaton()

    def density(self, text: str | None) -> float:
        if not text or not len(self.automaton):
            return 0.0
        plain = cleaned(text)
        folded = plain.translate(FOLD)
        found, free = [], []
        for end, (size, whole, weight) in self.automaton.iter(folded):
            a, b = end + 1 - size, end + 1
            if a and plain[a - 1].isalnum() or whole and b < len(plain) and plain[b].isalnum():
                continue
            (found if weight else free).append((a, b, weight))
        if not found:
            return 0.0
        total = sum(w for a, b, w in found if not any(x <= a and b <= y for x, y, _ in free))
        return total / max(1, len(text.encode("utf-8", "surrogatepass").split()))

    def score(self, density: float) -> float:
        """THRESHOLD at the middle density, 0 without terms, rising to 1."""
        return 1 / (1 + (1 / THRESHOLD - 1) * (self.lexicon.middle / density) ** 2) if density else 0.0


def _tail(k: int, n: int, p: float) -> float:
    """The log10 of the chance of k or more of n draws (upper bound by relative entropy)."""
    if k <= n * p:
        return 0.0
    q = k / n
    return -n * (q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0)) / math.log(10)


def _words_of(text: str | None) -> list[str]:
    """A text's distinct words that are long enough to teach."""
    return sorted({w for w in _letters(cleaned(text or "")) if len(w) >= BEGINNINGS[0]})


#: A near copy shares one of KEYS keys of HASHES minima; other texts of a language don't.
KEYS, HASHES = 4, 6


def _signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, toxic, sign) of texts with words; a sign is KEYS hashes of eight bytes."""
    factors = np.random.default_rng(7).integers(0, 1 << 63, KEYS * HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
    schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("sign", pa.binary())])
    for batch in batches:
        out: list[list] = [[], [], []]
        for doc, text, toxic in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "toxic")), strict=True):
            if parts := _words_of(text):
                hashes = hashes_of([w.encode() for w in parts])
                least = np.array([(hashes * a).min() for a in factors]).reshape(KEYS, HASHES)
                for column, value in zip(out, (doc, toxic, hashes_of([row.tobytes() for row in least]).tobytes()), strict=True):
                    column.append(value)
        yield batch_of(schema, *out)


def _beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, bad, clean, exact): toxic and other texts of a batch that hold a word beginning, and toxic ones that hold it as a word."""
    schema = pa.schema([("term", pa.string()), *((c, pa.int64()) for c in ("bad", "clean", "exact"))])
    for batch in batches:
        count = {0: Counter(), 1: Counter()}
        exact: Counter = Counter()
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            parts = _words_of(text)
            count[toxic].update({w[:n] for w in parts for n in BEGINNINGS if len(w) >= n})
            if toxic:
                exact.update(w for w in parts if len(w) in BEGINNINGS)
        terms = [*(count[0].keys() | count[1].keys())]
        yield batch_of(schema, terms, *([c[t] for t in terms] for c in (count[1], count[0], exact)))


def _without_copies(signs: list[tuple[int, int, bytes]]) -> list[tuple[int, int]]:
    """(doc_id, toxic) of texts that no text of a smaller id is a near copy of."""
    seen, kept = set(), []
    for doc, toxic, sign in sorted(signs):
        own = {(k, sign[8 * k : 8 * k + 8]) for k in range(KEYS)}
        if not own & seen:
            kept.append((doc, toxic))
        seen |= own
    return kept


def _terms(counts: dict[str, tuple[int, int, int]], totals: Counter) -> dict[str, tuple[bool, float]]:
    """(whole word, weight) of the terms that one-sided beginnings (toxic, other, exact) make."""
    share = totals[1] / (totals[0] + totals[1])
    good = {t for t, (k, other, _) in counts.items() if _tail(k, k + other, share) < math.log10(CHANCE)}
    longer: dict[str, list[str]] = {}
    for t in good:
        longer.setdefault(t[:-1], []).append(t)
    terms: dict[str, tuple[bool, float]] = {w: (True, 1.0) for w in WORDS}
    for t in sorted(good):
        if len(t) > BEGINNINGS[0] and t[:-1] in good:
            continue
        while rest := [c for c in longer.get(t, ()) if counts[c][0] >= 0.9 * counts[t][0]]:
            t = max(rest, key=lambda c: (counts[c][0], c))
        bad, clean, exact = counts[t]
        weight = math.log((bad + 0.5) / (totals[1] + 1)) - math.log((clean + 0.5) / (totals[0] + 1))
        terms.setdefault(t, (exact >= 0.9 * bad, max(0.25, min(1.0, weight / 5))))
    return terms


def _densities(lexicon: Lexicon):
    schema = pa.schema([("toxic", pa.int32()), ("density", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            yield batch_of(schema, batch.column("toxic"), [matcher.density(t) for t in batch.column("text").to_pylist()])

    return run


def _letters(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text).split()


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Lexicon:
    """Learns from labelled documents whose crc32(doc_id as text) mod 3 is not 1: at most ``sample`` of each class.

    Rows with a null id, text or label teach nothing; a document labelled twice counts as toxic when any
    label says so, and of texts that share an id the first in order teaches. Without both classes the fixed
    lexicon is returned. Texts stay on the executors: the driver receives a short sign for each text of the
    sample, one-sided beginnings with their counts, and one density for each text.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~is_held_out(F.col("doc_id")))
    marks = [marks.where(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in ("toxic = 1", "toxic = 0")]
    marks = F.broadcast(marks[0].union(marks[1]))  # 2 * sample ids
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    chosen = texts.join(marks, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    chosen = scratch.write(chosen.repartition(shuffle_partitions(spark), "doc_id"), "sample")
    signs = chosen.mapInArrow(_signs, "doc_id long, toxic int, sign binary").collect()  # 2 * sample
    kept = _without_copies([(r.doc_id, r.toxic, bytes(r.sign)) for r in signs])
    totals = Counter(toxic for _, toxic in kept)
    if not totals[1] or not totals[0]:
        return DEFAULT
    kept = chosen.join(F.broadcast(spark.createDataFrame([(d,) for d, _ in kept], "doc_id long")), "doc_id", "left_semi")  # 2 * sample ids
    kept = scratch.write(kept, "kept")
    counts = kept.mapInArrow(_beginnings, "term string, bad long, clean long, exact long").groupBy("term").agg(*(F.sum(c).alias(c) for c in ("bad", "clean", "exact")))
    sided = counts.where((F.col("bad") >= 4) & (F.col("bad") >= 0.01 * totals[1]) & (F.col("bad") >= 0.95 * (F.col("bad") + F.col("clean"))))
    terms = _terms({r.term: (r.bad, r.clean, r.exact) for r in sided.collect()}, totals)  # each is in a hundredth of the toxic texts
    lexicon = Lexicon(tuple((t, *v) for t, v in sorted(terms.items())), EXCEPTIONS, DEFAULT.middle)
    density: dict[int, list[float]] = {0: [], 1: []}
    for toxic, value in kept.mapInArrow(_densities(lexicon), "toxic int, density double").collect():  # 2 * sample
        density[toxic].append(value)
    clean, toxic = sorted(density[0]), sorted(density[1])
    low = clean[int(0.995 * (len(clean) - 1))]
    if hits := [d for d in toxic if d > low]:
        high = hits[int(0.05 * (len(hits) - 1))]
        lexicon = lexicon._replace(middle=max(math.sqrt(max(low, FLOOR) * high), high / 4))
    scratch.drop("sample")
    scratch.drop("kept")
    return lexicon


def is_held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def scored(docs: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs`` (doc_id, text).

    score is from 0 to 1 and 0 for a null or empty text, predicted 1 where it is 0.7 or more; held_out marks
    ids that :func:`fit` never learns from (a null id is one). Equal rows score alike; other columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            yield batch_of(schema, batch.column(0), [matcher.score(matcher.density(t.as_py())) for t in batch.column(1)])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns; null and empty texts stay."""
    ready: list[Matcher] = []

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        if not ready:
            ready.append(Matcher(lexicon))
        return pa.array([ready[0].score(ready[0].density(t.as_py())) for t in texts], pa.float64())

    return docs.where(score(F.col("text").cast("string")) < THRESHOLD)
