"""SentencePiece segmentations of whole texts, sampled without replacement by Gumbel top-k.

A text's lattice has an edge for each vocabulary piece that fits; a segmentation's probability is the
product of its pieces', over the lattice's total. A BPE model's scores are merge ranks, so a piece of rank r
counts as Zipf's law has it: log P = -log(r + 2) - log(sum over the vocabulary).

The k segmentations are the k with the largest Gumbel-perturbed log-probabilities, found by a perturbed
A-star search: a node is a set of segmentations with a common prefix, its priority the exact maximum of the
perturbed values below it, which backward sums over the lattice make known. The root's maximum is drawn
first; following it down draws one segmentation; every step leaves a branch of the other pieces there, whose
maximum is drawn below its parent's (truncated Gumbel); the largest branch gives the next segmentation. No
two are equal. With kappa the largest priority left, a segmentation's inclusion probability is
1 - exp(-exp(log P - kappa)), as in stochastic beam search (Kool et al., 2019).

No piece has a space inside a word, so the lattice falls apart at words: backward sums are made for each
distinct word of a run of texts, in numpy, and steps of all words are drawn together. Every draw is a hash
of the row key, the sample's number and the place in the text: results don't depend on partitioning.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.llm.common import batch_of, chunks, mixed

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"  # the model's space
RUN_CHARS = 800_000
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_SLOTS, _FACTOR = 20, np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The vocabulary as a trie in arrays: steps by a hash of (state, letter), and each state's piece."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        ranks = np.minimum(-np.array([model.get_score(i) for i in range(n)]), n)
        total = np.log((1 / (ranks + 2)).sum())
        self.log_p = -np.log(ranks + 2) - total
        self.byte_log_p = float(-np.log(n + 2) - total)
        names = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) for i in range(n)]
        self.byte_ids = {int(names[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.ascii_ids = np.array([self.byte_ids.get(b, 0) for b in range(0x80)], np.int32)
        self.bytes = [bytes([int(x[3:5], 16)]) if model.is_byte(i) else b"" if special[i] else x.replace(SPACE, " ").encode() for i, x in enumerate(names)]
        #: All pieces' bytes in a row, with each piece's first and count.
        self.flat, self.widths = np.frombuffer(b"".join(self.bytes), np.uint8), np.array([*map(len, self.bytes)], np.int64)
        self.firsts = np.cumsum(self.widths) - self.widths
        text = [(x, i) for i, x in enumerate(names) if not special[i] and not model.is_byte(i) and x]
        if any(re.search(f"[^{SPACE}]{SPACE}", x) for x, _ in text):
            raise ValueError("a piece spans words: words can't be segmented one by one")
        alphabet = sorted({c for x, _ in text for c in x})
        self.letter = np.zeros(0x110000, np.int32)  # 0: in no piece
        self.letter[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.letters = len(alphabet) + 1
        # a state is a prefix of a piece; those of one letter come first, numbered as the letter is
        states: dict[str, int] = {"": 0} | {c: i for i, c in enumerate(alphabet, 1)}
        steps: dict[int, int] = {}
        for x, _ in text:
            for end in range(2, len(x) + 1):
                if x[:end] not in states:
                    states[x[:end]] = len(states)
                    steps[states[x[: end - 1]] * self.letters + int(self.letter[ord(x[end - 1])])] = states[x[:end]]
        self.piece = np.full(len(states), -1, np.int32)
        self.piece[[states[x] for x, _ in text]] = [i for _, i in text]
        known = {x for x, _ in text}
        #: The most pieces that can start at one place, one for bytes included.
        self.options = 1 + max(sum(x[:end] in known for end in range(1, len(x) + 1)) for x in known)
        keys, targets = np.array([*steps], np.int64), np.array([*steps.values()], np.int32)
        self.tables, left, self.shared = [], np.arange(len(keys)), np.zeros(1 << _SLOTS, bool)
        while len(left):  # what finds its slot taken goes to a further table
            slots = self._slot(keys[left], len(self.tables))
            _, first = np.unique(slots, return_index=True)
            key, target = np.full(1 << _SLOTS, -1, np.int64), np.zeros(1 << _SLOTS, np.int32)
            key[slots[first]], target[slots[first]] = keys[left[first]], targets[left[first]]
            self.tables.append((key, target))
            left = np.delete(left, first)
            if len(self.tables) == 1:
                self.shared[self._slot(keys[left], 0)] = True

    def joined(self, ids: np.ndarray) -> bytes:
        """The bytes that piece ids stand for."""
        widths = self.widths[ids]
        ends = np.cumsum(widths)
        places = np.repeat(self.firsts[ids] - ends + widths, widths)
        places += np.arange(len(places))
        return self.flat[places].tobytes()

    @staticmethod
    def _slot(keys: np.ndarray, table: int) -> np.ndarray:
        return ((keys.view(np.uint64) * (_FACTOR + np.uint64(2 * table))) >> np.uint64(64 - _SLOTS)).view(np.int64)

    def step(self, states: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The states that the letters lead to, 0 where no piece goes on so."""
        keys = states.astype(np.int64) * self.letters + letters
        key, target = self.tables[0]
        slots = self._slot(keys, 0)
        out = np.where(key[slots] == keys, target[slots], 0)
        if len(self.tables) > 1:
            rest = np.flatnonzero((out == 0) & self.shared[slots])
            for n, (key, target) in enumerate(self.tables[1:], 1):
                slots = self._slot(keys[rest], n)
                hit = key[slots] == keys[rest]
                out[rest[hit]] = target[slots[hit]]
        return out


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


class Lattices:
    """Backward sums of distinct words.

    A row is a place in a word. Rows come by their distance to the word's end, then by word, the longest
    word first, so the sums of all places at one distance are made together. A row's edges, by length, are
    the pieces that start there: none leads nowhere, as each single character has a piece or its bytes.
    """

    def __init__(self, vocabulary: Pieces, words: list[str]):
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-self.lengths, kind="stable")
        self.rank = np.empty_like(order)
        self.rank[order] = np.arange(len(order))
        sizes = self.lengths[order]
        at_distance = len(words) - np.cumsum(np.bincount(sizes, minlength=1))[:-1]  # words of at least 1, 2, ... characters
        #: The first row of each distance, from 1 on.
        self.below = np.concatenate(([0, 0], np.cumsum(at_distance)))
        n_rows = int(self.below[-1])
        # places in the order of the text, with a character of no piece after each word
        codes = np.frombuffer("\0".join([*(words[i] for i in order), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = vocabulary.letter[codes]
        ends = np.cumsum(sizes + 1) - 1
        inside = np.ones(len(codes), bool)
        inside[ends] = False
        q = np.flatnonzero(inside)
        word = np.repeat(np.arange(len(words)), sizes)
        distance = ends[word] - q
        row = self.below[distance] + word
        found, state, at, length = [], letters[q], q, 1
        del word, distance
        while True:
            piece = vocabulary.piece[state]
            if length == 1:  # a character outside the vocabulary is its bytes
                bare = np.flatnonzero((piece < 0) | (state == 0))
                piece[bare] = -2 - codes[q[bare]].astype(np.int64)
                found.append((row, piece))
            else:
                hit = piece >= 0
                found.append((row[hit], piece[hit]))
            following = letters[at + length]
            go = np.flatnonzero((state > 0) & (following > 0))
            state = vocabulary.step(state[go], following[go])
            live = np.flatnonzero(state)
            state, at, row, length = state[live], at[go[live]], row[go[live]], length + 1
            if not len(live):
                break
        self.count = np.zeros(n_rows, np.int8)
        for own, _ in found:
            self.count[own] += 1
        self.start = np.cumsum(self.count, dtype=np.int64) - self.count
        n_edges = int(self.count.sum(dtype=np.int64))
        self.size, self.piece = np.zeros(n_edges, np.int8), np.zeros(n_edges, np.int32)
        free = self.start.copy()
        for length, (own, piece) in enumerate(found, 1):
            self.size[free[own]], self.piece[free[own]] = length, piece
            free[own] += 1
        del found, free
        self._sum(vocabulary, n_rows, len(words))

    def _sum(self, vocabulary: Pieces, n_rows: int, n_words: int) -> None:
        count = self.count.astype(np.int64)
        value = vocabulary.log_p[np.maximum(self.piece, 0)]
        code = -2 - self.piece[bare := np.flatnonzero(self.piece < 0)].astype(np.int64)
        value[bare] = vocabulary.byte_log_p * (1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))
        self.piece[bare[code < 0x80]] = vocabulary.ascii_ids[code[code < 0x80]]  # one byte each; longer ones stay as codes
        # where an edge leads, in an array with the words' ends ahead of the rows
        per_distance = np.diff(self.below[1:])
        distance = np.repeat(np.arange(1, len(per_distance) + 1), per_distance)
        word = np.arange(n_rows) - self.below[distance]
        left = np.repeat(distance, count) - self.size
        target = np.where(left > 0, self.below[left] + n_words, 0) + np.repeat(word, count)
        del left, word, distance
        ahead, total, weights = np.zeros(n_words + n_rows), 0.0, np.empty(len(value))
        for d in range(1, len(self.below) - 1):
            a, b = self.below[d], self.below[d + 1]
            first = self.start[a]
            last = self.start[b] if b < n_rows else len(value)
            starts, counts = self.start[a:b] - first, count[a:b]
            own = value[first:last]
            own += ahead[target[first:last]]
            most = np.maximum.reduceat(own, starts)
            weight = np.exp(own - np.repeat(most, counts))
            total = np.add.reduceat(weight, starts)
            weights[first:last] = weight / np.repeat(total, counts)
            ahead[n_words + a : n_words + b] = sums = most + np.log(total)
            own -= np.repeat(sums, counts)
        #: Logarithms of an edge's probability and of all others' of its row.
        self.log_p = np.empty((len(value), 2), np.float32)
        self.log_p[:, 0] = value
        with np.errstate(divide="ignore"):
            self.log_p[:, 1] = np.log(np.maximum(-np.expm1(np.minimum(value, 0)), 0))
        self.log_p[self.start[count == 1], 1] = -np.inf
        # cumulative probabilities within rows, as a table of a column for each option
        sums = np.cumsum(weights)
        sums -= np.repeat(sums[self.start] - weights[self.start], count)
        cells = np.arange(len(value)) + np.repeat(np.arange(n_rows) * vocabulary.options - self.start, count)
        self.reach = np.full(n_rows * vocabulary.options, 2, np.float32)
        self.reach[cells] = sums
        self.reach = self.reach.reshape(n_rows, vocabulary.options)

    def edges_of(self, edge: int) -> tuple[int, int]:
        """The first edge of an edge's row, and their number."""
        row = int(np.searchsorted(self.start, edge, side="right")) - 1
        return int(self.start[row]), int(self.count[row])


def _uniform(seed: np.ndarray | np.uint64, sample: int, place: np.ndarray, use: int) -> np.ndarray:
    """Numbers in (0, 1): a function of the row's seed, the sample, the place in the text and the use."""
    word = mixed(seed ^ mixed(place.astype(np.uint64) * np.uint64(8) + np.uint64((sample << 48) + use)))
    return ((word >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


class Path:
    """One segmentation of one text: edges of the lattice, and the branches left beside them.

    A branch's order is kept as log(noise) - phi, of which its priority is a falling function.
    """

    def __init__(self, edges: np.ndarray, place: np.ndarray, lattice: Lattices, value: float, seed: np.uint64, sample: int, first: int, barred: list[int]):
        self.edges, self.place, self.value, self.first, self.barred = edges, place, value, first, barred
        logs = lattice.log_p[edges]
        sums = np.cumsum(logs[:, 0], dtype=np.float64)
        self.total = float(sums[-1]) if len(sums) else 0.0
        # branches from ``first`` on: everything with this prefix and another piece here
        phi = logs[first:, 1].astype(np.float64)
        if len(phi) and barred:
            weights = np.exp(lattice.log_p[[edges[first], *barred], 0].astype(np.float64))
            options = lattice.edges_of(edges[first])[1] - len(barred)
            phi[0] = np.log(rest) if options > 1 and (rest := 1 - weights.sum()) > 0 else -np.inf
        phi[1:] += sums[first:-1]
        if first:
            phi[:1] += sums[first - 1]
        self.branch = np.log(-np.log(_uniform(seed, sample, place[first:], 1))) - phi

    def best(self) -> tuple[float, int]:
        if not len(self.branch):
            return -np.inf, 0
        at = int(np.argmin(self.branch))
        return float(-np.logaddexp(-self.value, self.branch[at])), at + self.first


def _drawn(lattice: Lattices, kinds: np.ndarray, start: np.ndarray, begin: np.ndarray, seed: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Steps through words from ``begin`` (a place in each) on: how many of each word; edges and places, in order."""
    active = np.flatnonzero(begin < lattice.lengths[kinds])
    left, rank, place, seed = lattice.lengths[kinds[active]] - begin[active], lattice.rank[kinds[active]], start[active] + begin[active], seed[active]
    steps, counts = [], np.zeros(len(kinds), np.int64)
    while len(active):
        rows = lattice.below[left] + rank
        u = _uniform(seed, sample, place, 0).astype(np.float32)
        column = np.minimum((lattice.reach[rows] <= u[:, None]).sum(axis=1, dtype=np.int8), lattice.count[rows] - 1)
        edges = lattice.start[rows] + column
        steps.append((active, edges, place))
        counts[active] += 1
        size = lattice.size[edges]
        more = np.flatnonzero(left > size)
        size = size[more]
        active, left, rank, place, seed = active[more], left[more] - size, rank[more], place[more] + size, seed[more]
    offsets = np.cumsum(counts) - counts
    out = [np.empty(int(counts.sum()), np.int64) for _ in range(2)]
    for n, (active, *values) in enumerate(steps):
        to = offsets[active] + n
        for x, value in zip(out, values, strict=True):
            x[to] = value
    return counts, *out


def _run(vocabulary: Pieces, texts: list[str | None], seeds: np.ndarray, k: int) -> Iterator[tuple[int, int, np.ndarray, float, float]]:
    """(text, sample, piece ids, log P, log inclusion) of some texts' samples."""
    literal = SPACE  # what stands for the model's space where a text itself has that character
    if any(SPACE in text for text in texts if text):
        present = set().union(*(text for text in texts if text))
        literal = next(c for c in map(chr, range(0xE000, 0x110000)) if c not in present and not vocabulary.letter[ord(c)])
    known: defaultdict[str, int] = defaultdict()  # words without the space that each begins with
    known.default_factory = known.__len__
    kinds, sizes = [], []
    for text in texts:
        if text and literal != SPACE:
            text = text.replace(SPACE, literal)
        if not text:
            found = []
        elif "  " in text or text[0] == " " or text[-1] == " ":
            found = [w[1:] for w in _WORD.findall(SPACE + text.replace(" ", SPACE))]
        else:
            found = text.split(" ")
        kinds.extend(map(known.__getitem__, found))
        sizes.append(len(found))
    lattice = Lattices(vocabulary, [SPACE + w for w in known])
    del known
    if literal != SPACE:
        lattice.piece[lattice.piece == -2 - ord(literal)] = -2 - ord(SPACE)
    kind, size = np.array(kinds, np.int64), np.array(sizes, np.int64)
    del kinds
    cuts = np.concatenate(([0], np.cumsum(size)))
    doc = np.repeat(np.arange(len(texts)), size)
    ends = np.concatenate(([0], np.cumsum(lattice.lengths[kind])))
    start = ends[:-1] - ends[cuts[:-1]][doc]
    counts, edges, place = _drawn(lattice, kind, start, np.zeros(len(kind), np.int64), seeds[doc], 0)
    step = np.concatenate(([0], np.cumsum(counts)))[cuts]
    paths: list[list[Path]] = []
    for d in range(len(texts)):
        part = slice(step[d], step[d + 1])
        value = float(-np.log(-np.log(_uniform(seeds[d], 0, np.zeros(1), 2)[0])))
        paths.append([Path(edges[part], place[part], lattice, value, seeds[d], 0, 0, [])])
    for sample in range(1, k):
        todo = []
        begin = lattice.lengths[kind]  # words that are not drawn again
        for d, own in enumerate(paths):
            (value, at), parent = max(((p.best(), i) for i, p in enumerate(own)), key=lambda x: (x[0][0], -x[1]))
            if value == -np.inf:
                continue
            p = own[parent]
            barred = [int(p.edges[at]), *(p.barred if at == p.first else [])]
            first, options = lattice.edges_of(p.edges[at])
            weights = np.exp(lattice.log_p[first : first + options, 0].astype(np.float64))
            weights[[x - first for x in barred]] = 0
            below = np.cumsum(weights / weights.sum())
            new = first + min(int(np.searchsorted(below, _uniform(seeds[d], sample, p.place[at : at + 1], 3)[0], side="right")), int(np.flatnonzero(weights)[-1]))
            p.branch[at - p.first] = np.inf
            words = slice(cuts[d], cuts[d + 1])
            word = int(np.searchsorted(start[words], p.place[at], side="right")) - 1 + cuts[d]
            begin[word] = p.place[at] - start[word] + int(lattice.size[new])
            begin[word + 1 : cuts[d + 1]] = 0
            todo.append((d, p, at, new, value, barred))
        counts, edges, place = _drawn(lattice, kind, start, begin, seeds[doc], sample)
        step = np.concatenate(([0], np.cumsum(counts)))[cuts]
        for d, p, at, new, value, barred in todo:
            part = slice(step[d], step[d + 1])
            paths[d].append(Path(np.concatenate((p.edges[:at], [new], edges[part])), np.concatenate((p.place[: at + 1], place[part])), lattice, value, seeds[d], sample, at, barred))
    for d, own in enumerate(paths):
        kappa = max(p.best()[0] for p in own)
        for sample, p in enumerate(own):
            ids = lattice.piece[p.edges]
            if len(ids) and ids.min() < 0:
                at = np.flatnonzero(ids < 0)
                many = [[vocabulary.byte_ids[b] for b in chr(-2 - i).encode("utf-8", "surrogatepass")] for i in ids[at].tolist()]
                repeats = np.ones(len(ids), np.int64)
                repeats[at] = [*map(len, many)]
                ids = np.repeat(ids, repeats)
                ids[ids < 0] = [b for own in many for b in own]
            gap = p.total - kappa
            inclusion = 0.0 if kappa == -np.inf else gap if gap < -30 else float(np.log(-np.expm1(-np.exp(min(gap, 50.0)))))
            yield d, sample, ids, p.total, inclusion


def decode(ids: list[int] | np.ndarray, tokenizer: str = TOKENIZER) -> str:
    """The text that piece ids stand for."""
    text = pieces(tokenizer).joined(np.asarray(ids, np.int64)).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def sampled(docs: DataFrame, k: int = 2, tokenizer: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """Up to k distinct segmentations of each row's whole text (doc_id, text), in the order they were drawn.

    doc_id, sample (from 0), n_pieces, log_prob, inclusion (log of the inclusion probability; 0 when all
    segmentations are out), ids_sha256 (of the ids as little-endian int32), exact (whether decoding gives the
    text again), and with ``with_ids`` ids. A text with fewer segmentations gives them all; a null or empty
    text gives one without pieces. The seed is doc_id, so equal rows give equal samples; a null doc_id counts
    as a seed of its own. Other columns are ignored.
    """
    fields = [("doc_id", pa.int64()), ("sample", pa.int32()), ("n_pieces", pa.int64()), ("log_prob", pa.float64()), ("inclusion", pa.float64()), ("ids_sha256", pa.string()), ("exact", pa.bool_())]
    schema = pa.schema([*fields, ("ids", pa.list_(pa.int32()))] if with_ids else fields)
    ddl = "doc_id long, sample int, n_pieces long, log_prob double, inclusion double, ids_sha256 string, exact boolean" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(tokenizer)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for first, texts in chunks(batch.column(1), RUN_CHARS):
                own = keys[first : first + len(texts)]
                seeds = mixed(np.array([(x if x is not None else -(1 << 62)) & (1 << 64) - 1 for x in own], np.uint64) + np.uint64(0x5851F42D4C957F2D))
                out: list[list] = [[] for _ in fields]
                ids = []
                for d, sample, found, log_p, inclusion in _run(vocabulary, texts, seeds, k):
                    row = (own[d], sample, len(found), log_p, inclusion, hashlib.sha256(found.tobytes()).hexdigest(), decode(found, tokenizer) == (texts[d] or ""))
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
                    ids.append(found)
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in ids]))), pa.int32()), pa.array(np.concatenate(ids)))] if with_ids else []
                yield batch_of(schema, *out, *lists)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ddl)
