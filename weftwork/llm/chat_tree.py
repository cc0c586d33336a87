"""Chat formatting as a prefix tree: turns that conversations share from the start are emitted once.

A node is a turn after a given list of earlier turns; its id is a hash chained along them. Nodes are the
distinct ids, found by a partial aggregation, so a first turn that a third of all conversations share is
one row. A chain is a run of nodes without a branch between them. A node's path is the chains that lead to
it, each by the id of its first node and how far along it the path goes, so that paths grow with the branches of a tree
and not with the length of a conversation. The order of paths is depth-first, so a range partitioning lays the
tree out: each range sums its tokens and names the chains still open at its end, the driver adds up one short row
for each range, and a second pass gives every node its place in the packed sequence, its position ids and
the intervals of its ancestors, which are all that its tokens may attend to besides their own node.

Template: ``<|turn|>`` role ``<|text|>`` text ``<|end|>`` for each turn. Inside roles and texts a
backslash is doubled and ``\\-`` put after the first character of each control string, which can be undone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.llm.common import Scratch, batch_of, shuffle_partitions
from weftwork.llm.token_histogram import TOKENIZER, encoded, encoding

# Strings that mean something to this template or to other common chat templates.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Bytes of a node's id and of a path's step: a chain's first node and a place on the chain.
ID, STEP = 16, 20
#: Bytes of formatted text and tokens that one range holds on average; parts that a join with a common turn is dealt to.
RANGE_BYTES, SALTS = 32_000_000, 16


def escaped(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for control in CONTROL:
        text = text.replace(control, f"{control[0]}\\-{control[1:]}")
    return text


def unescaped(text: str) -> str:
    return re.sub(r"\\([\\-])", lambda m: "\\" if m[1] == "\\" else "", text)


def parsed(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) of each turn of a formatted conversation."""
    shape = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.DOTALL)
    return [(unescaped(m[1]), unescaped(m[2])) for m in shape.finditer(formatted)]


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, row, depth, node, parent, role, text) of each turn of conversations (conv_id, row, turns)."""
    schema = pa.schema([("conv_id", pa.int64()), ("row", pa.int64()), ("depth", pa.int32()), ("node", pa.binary()), ("parent", pa.binary()), ("role", pa.string()), ("text", pa.string())])
    for batch in batches:
        out: list[list] = [[] for _ in schema]
        for conv, row, turns in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            node = b""
            for depth, turn in enumerate(turns):
                role, text, parent = turn["role"] or "", turn["text"] or "", node
                node = hashlib.blake2b(b"%s%d:%s%s" % (node, len(role.encode()), role.encode(), text.encode()), digest_size=ID).digest()
                for column, value in zip(out, (conv, row, depth, node, parent, role, text), strict=True):
                    column.append(value)
            if len(out[0]) >= 2000:
                yield batch_of(schema, *out)
                out = [[] for _ in schema]
        yield batch_of(schema, *out)


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, path) of each turn of conversations (steps: depth, node, and whether a chain starts there)."""
    schema = pa.schema([("node", pa.binary()), ("path", pa.binary())])
    for batch in batches:
        out: list[list] = [[], []]
        for steps in batch.column(0).to_pylist():
            path, along = b"", 0
            for step in steps:
                if step["starts"]:
                    path, along = path + step["node"] + (0).to_bytes(4), 0
                else:
                    along += 1
                    path = path[:-4] + along.to_bytes(4)
                out[0].append(step["node"])
                out[1].append(path)
            if len(out[0]) >= 2000:
                yield batch_of(schema, *out)
                out = [[], []]
        yield batch_of(schema, *out)


def _encode(tokenizer: str):
    schema = pa.schema([("node", pa.binary()), ("depth", pa.int32()), ("role", pa.string()), ("segment", pa.string()), ("loss_start", pa.int32()), ("loss_end", pa.int32()), ("token_ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoding(tokenizer)
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for node, depth, role, text in zip(*(batch.column(c).to_pylist() for c in ("node", "depth", "role", "text")), strict=True):
                head, body = TURN + escaped(role) + TEXT, escaped(text)
                parts = [encoded(tokens, x) for x in (head, body, END) if x]
                masked = (len(head), len(head) + len(body)) if role == "assistant" else (0, 0)
                for column, value in zip(out, (node, depth, role, head + body + END, *masked, sum(parts, [])), strict=True):
                    column.append(value)
            yield batch_of(schema, *out)

    return run


_SUMMARY = "part int, total long, last binary, opened array<long>, sizes array<long>"


def _chain(path: bytes, i: int) -> bytes:
    """The i-th chain of a path, told by the way to it and its first node."""
    return path[: i * STEP + ID]


def _summary(table: pa.Table) -> pa.Table:
    """Tokens of one range, the path at its end, and of each chain of that path where in the range it starts (-1: earlier) and its tokens here."""
    rows = sorted(zip(table.column("path").to_pylist(), table.column("n_tokens").to_pylist(), strict=True))
    last = rows[-1][0]
    chains = {_chain(last, i): [-1, 0] for i in range(len(last) // STEP)}
    at = 0
    for path, n in rows:
        if (own := chains.get(path[:-4])) is not None:
            if path[-4:] == b"\0\0\0\0":
                own[0] = at
            own[1] += n
        at += n
    opened, sizes = zip(*chains.values(), strict=True)
    return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "total": pa.array([at]), "last": pa.array([last], pa.binary()), "opened": pa.array([opened], pa.list_(pa.int64())), "sizes": pa.array([sizes], pa.list_(pa.int64()))})


def _layout(before):
    """``before`` broadcasts for each range where it starts and the chains that are open there, with their places."""

    def run(table: pa.Table) -> pa.Table:
        at, known = before.value[table.column("part")[0].as_py()]
        rows = sorted((path, i) for i, path in enumerate(table.column("path").to_pylist()))
        sizes = table.column("n_tokens").to_pylist()
        stack: list[list] = []  # of the chains that lead to a node: name, start, end, position of its first token
        starts, positions, spans = [0] * len(rows), [0] * len(rows), [None] * len(rows)
        for path, i in rows:
            while stack and not path.startswith(stack[-1][0]):
                stack.pop()
            for d in range(len(stack), len(path) // STEP):  # chains that an earlier range began, and a new one
                name = _chain(path, d)
                a, b = known.get(name, (at, at))
                stack.append([name, a, b, stack[-1][3] + stack[-1][2] - stack[-1][1] if stack else 0])
            merged: list[list[int]] = []
            for _, a, b, _ in stack:
                if merged and merged[-1][1] == a:
                    merged[-1][1] = b
                elif b > a:
                    merged.append([a, b])
            own = stack[-1]
            starts[i], positions[i], spans[i] = at, own[3] + own[2] - own[1], [{"start": a, "end": b} for a, b in merged]
            at += sizes[i]
            own[2] = at
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        table = table.drop_columns(["part", "path"]).append_column("start", pa.array(starts, pa.int64()))
        return table.append_column("position", pa.array(positions, pa.int64())).append_column("ancestors", pa.array(spans, kind))

    return run


def pack(conversations: DataFrame, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(nodes, turns) of ``conversations`` (conv_id, turn, role, text).

    nodes, one row for each distinct turn after the same earlier turns: node, depth, role, segment
    (formatted text), loss_start and loss_end (characters of the segment under the loss mask), token_ids,
    n_tokens, start (of its tokens in the packed depth-first sequence), position (id of its first token;
    they count up from there), ancestors (array of [start, end) intervals it may attend to).
    turns: conv_id, row, depth, node, so that a conversation is its nodes' segments by depth.

    Turns are ordered by turn, then role and text; a null text or role counts as empty and a null turn
    comes first. Equal rows are turns of their own. A row without conv_id is a conversation of its own, of
    null id; ``row`` tells these apart. A conversation is one task's row, whatever its length. Other columns are ignored.
    """
    spark = conversations.sparkSession
    scratch = Scratch(spark, "chat-tree")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    named = rows.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")).select("conv_id", F.lit(0).cast("long").alias("row"), "turns")
    alone = rows.where("conv_id IS NULL").select("conv_id", (F.monotonically_increasing_id() + 1).alias("row"), F.array("t").alias("turns"))
    turns = scratch.write(named.unionByName(alone).mapInArrow(_chained, "conv_id long, row long, depth int, node binary, parent binary, role string, text string"), "turns")
    distinct = turns.groupBy("node").agg(*(F.first(c).alias(c) for c in ("depth", "parent", "role", "text")))
    distinct = scratch.write(distinct, "distinct")
    nodes = distinct.select("node", "depth", "role", "text").mapInArrow(_encode(tokenizer), "node binary, depth int, role string, segment string, loss_start int, loss_end int, token_ids array<int>").withColumn("n_tokens", F.size("token_ids"))
    nodes = scratch.write(nodes, "nodes")

    branching = distinct.where("depth > 0").groupBy("parent").agg(F.count("*").alias("n")).where("n > 1").select("parent", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("branches"))
    steps = turns.select("conv_id", "row", "depth", "node", "parent", F.pmod(F.xxhash64("conv_id", "row"), F.lit(SALTS)).cast("int").alias("salt")).join(branching, ["parent", "salt"], "left")
    steps = steps.select("conv_id", "row", F.struct("depth", "node", (F.coalesce("branches", F.lit(False)) | (F.col("depth") == 0)).alias("starts")).alias("step"))
    paths = steps.groupBy("conv_id", "row").agg(F.sort_array(F.collect_list("step")).alias("steps")).select("steps").mapInArrow(_paths, "node binary, path binary")
    paths = scratch.write(paths.groupBy("node").agg(F.first("path").alias("path")), "paths")

    held = nodes.agg(F.coalesce(F.sum(F.length("segment") + 4 * F.col("n_tokens")), F.lit(0))).first()[0]
    ranged = nodes.join(paths, "node").repartitionByRange(max(shuffle_partitions(spark), held // RANGE_BYTES), "path").withColumn("part", F.spark_partition_id())
    ranged = scratch.write(ranged, "ranged")
    before, at, places = {}, 0, {}
    for row in sorted(ranged.select("part", "path", "n_tokens").groupBy("part").applyInArrow(_summary, _SUMMARY).collect(), key=lambda r: r.part):  # a short row for each range
        before[row.part], last, open_ = (at, places), bytes(row.last), {}
        for i, (start, size) in enumerate(zip(row.opened, row.sizes, strict=True)):
            name = _chain(last, i)
            a, b = (at + start, at + start) if start >= 0 else places[name]
            open_[name] = a, b + size
        at, places = at + row.total, open_
    schema = "node binary, depth int, role string, segment string, loss_start int, loss_end int, token_ids array<int>, n_tokens int, start long, position long, ancestors array<struct<start: long, end: long>>"
    laid = scratch.write(ranged.groupBy("part").applyInArrow(_layout(spark.sparkContext.broadcast(before)), schema), "laid")
    for name in ("distinct", "nodes", "paths", "ranged"):
        scratch.drop(name)
    return laid, turns.select("conv_id", "row", "depth", "node")


def formatted(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, segments) of each conversation: its nodes' segment, loss_start and loss_end by depth."""
    parts = turns.join(nodes.select("node", "segment", "loss_start", "loss_end"), "node")
    return parts.groupBy("conv_id", "row").agg(F.sort_array(F.collect_list(F.struct("depth", "segment", "loss_start", "loss_end"))).alias("segments")).drop("row")


def read_back(segments: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all parsed from the formatted text."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for conv, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text, spans, at = "".join(p["segment"] for p in parts), [], 0
                for p in parts:
                    spans.append((at + p["loss_start"], at + p["loss_end"]))
                    at += len(p["segment"])
                turns, loss = parsed(text), "".join(unescaped(text[a:b]) for a, b in spans)
                whole = "".join(f"{role}\n{body}\n" for role, body in turns)
                row = (conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield batch_of(schema, *out)

    return segments.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
