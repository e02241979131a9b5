"""Chat formatting with a prefix tree.

Each turn is formatted by a template that marks turns and escapes control characters in roles and texts reversibly. Conversations that begin
with the same turns share the nodes of those turns: the packed output holds every node's text once, depth first, with its offset in the
output, its position in a conversation, the spans of it that a loss covers, and the offsets of all that it may attend to
before itself (its ancestors), merged where they touch. `tokens` puts the same tree out in tokens: each node's ids once, a position id for
each token, a loss mask, and the ancestors' intervals in tokens.

A node is known by a chained hash of all turns up to it. No group is gathered: conversations pass through tasks as sorted streams, the
depth-first order is a distributed sort by the tree path of the first conversation through a node and by depth, and
offsets are running sums over the sorted partitions.

Results for odd input: null role and null text count as empty; turns are ordered by turn, role, text (nulls first), so ties are no matter;
repeated rows are turns of their own; a null conversation id is a conversation of its own; an empty table gives empty results. Other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, tidy
from .tokenizer import encode, encoding, piece_encoding
from .tokenizer import PATTERN as SPLITTABLE

# The template.
OPEN, AFTER_ROLE, CLOSE = "<|turn ", "|>\n", "<|end|>\n"
ESCAPES = {"\\": "\\\\", "<": "\\l", "|": "\\p"}
LEARNT_ROLE = "assistant"
FLUSH = 4 << 20


def escape(s: str) -> str:
    return re.sub(r"[\\<|]", lambda m: ESCAPES[m[0]], s)


def unescape(s: str) -> str:
    back = {v: k for k, v in ESCAPES.items()}
    return re.sub(r"\\.", lambda m: back[m[0]], s, flags=re.S)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn's formatted text, and the span of it that the loss covers (empty for other roles than the learnt one)."""
    head = OPEN + escape(role) + AFTER_ROLE
    body = escape(text)
    span = (len(head), len(head) + len(body)) if role == LEARNT_ROLE else (0, 0)
    return head + body + CLOSE, *span


def parse_turn(formatted: str) -> tuple[str, str]:
    role, _, rest = formatted[len(OPEN) :].partition(AFTER_ROLE)
    return unescape(role), unescape(rest[: -len(CLOSE)])


TURNS = "conv_id long, idx long, node binary, parent binary, pos long, formatted string, loss_start long, loss_end long, path binary"


def _batch(rows: list[list], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in TURNS.split(", ")]
    types = [{"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[x.split()[1]] for x in TURNS.split(", ")]
    rows, size, conv, idx, node, pos, path = [], 0, None, None, b"", 0, []
    for b in batches:
        for c, role, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if idx is None or c != conv:
                if rows:
                    rows[-1][8] = b"".join(path)
                conv, idx, node, pos, path = c, 0, b"", 0, []
            if size > FLUSH:
                yield _batch(rows[:-1], names, types)  # the last row waits: it may be its conversation's last
                rows, size = rows[-1:], 0
            role, text = role or "", text or ""
            parent, node = node, xxhash.xxh3_128_digest(node + len(role.encode()).to_bytes(8, "big") + role.encode() + text.encode())
            path.append(node[:8])
            formatted, lo, hi = format_turn(role, text)
            rows.append([c, idx, node, parent, pos, formatted, lo, hi, None])
            size += len(formatted) + 64
            idx, pos = idx + 1, pos + len(formatted)
    if rows:
        rows[-1][8] = b"".join(path)
        yield _batch(rows, names, types)


def turns(conversations: DataFrame) -> DataFrame:
    """Formatted turns with node hashes; path, the tree path, on each conversation's last turn."""
    bounded_batches(conversations.sparkSession)
    src = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "role", "text", "turn")
    return src.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn").mapInArrow(tidy(_scan), TURNS)


NODES = "node binary, parent binary, depth long, pos long, first long, formatted string, loss_start long, loss_end long, part int, local long"


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition's number and the running sum of lengths in it."""
    from pyspark import TaskContext

    part, total = TaskContext.get().partitionId(), 0
    for b in batches:
        starts = []
        for s in b.column(5).to_pylist():
            starts.append(total)
            total += len(s)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int32()), pa.array(starts, pa.int64())], names=[x.split()[0] for x in NODES.split(", ")])


def _attend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each conversation's nodes in order: the merged intervals of a node's ancestors, for nodes that this conversation is the first of."""
    conv, begun, spans = None, False, []
    for b in batches:
        out = []
        for c, node, start, size, owned in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4, 5)), strict=True):
            if not begun or c != conv:
                conv, begun, spans = c, True, []
            if owned:
                out.append([node, [{"start": x, "end": y} for x, y in spans]])
            if spans and spans[-1][1] == start:
                spans[-1] = (spans[-1][0], start + size)
            else:
                spans.append((start, start + size))
        yield _batch(out, ["node", "attends"], [pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))])


def from_parts(sums: DataFrame, size) -> DataFrame:
    """Replaces part and local, a running sum of sizes within the partition, by start, the sum over all partitions."""
    ends = sorted((r["part"], r["n"]) for r in sums.groupBy("part").agg(F.max(F.col("local") + size).alias("n")).collect())  # a row for each partition
    offsets, at = [], 0
    for p, n in ends:
        offsets.append((p, at))
        at += n
    base = F.broadcast(sums.sparkSession.createDataFrame(offsets, "part int, base long"))
    return sums.join(base, "part").withColumn("start", F.col("base") + F.col("local")).drop("part", "local", "base")


def tokens(packed: DataFrame, rank_file: str, pattern: str, materialise) -> DataFrame:
    """The packed output in tokens, a row for each node: node, parent, depth, token_ids, loss_mask (of each token), start, end (token offsets in the output),
    position_ids (of each token in a conversation), attends (token intervals of all ancestors).

    A turn's mark, its text and its end are encoded apart, so that the loss mask covers whole tokens and no token crosses nodes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, pieces = encoding(rank_file, pattern), piece_encoding(rank_file) if pattern == SPLITTABLE else None
        part, total = TaskContext.get().partitionId(), 0
        for b in batches:
            ids, masks, starts = [], [], []
            for text, lo, hi in zip(*(b.column(k).to_pylist() for k in (5, 6, 7)), strict=True):
                cut = [encode(enc, x, pieces) for x in (text[:lo], text[lo:hi], text[hi:])]
                ids.append([i for x in cut for i in x])
                masks.append([k == 1 for k, x in enumerate(cut) for _ in x])
                starts.append(total)
                total += len(ids[-1])
            columns = [*b.columns[:5], pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.bool_())), pa.array([part] * b.num_rows, pa.int32()), pa.array(starts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "parent", "depth", "from", "to", "token_ids", "loss_mask", "part", "local"])

    schema = "node binary, parent binary, depth long, from long, to long, token_ids array<int>, loss_mask array<boolean>, part int, local long"
    in_order = packed.select("node", "parent", "depth", F.col("start").alias("from"), F.col("end").alias("to"), "formatted", "loss_start", "loss_end").orderBy("from")
    sums = materialise(in_order.mapInArrow(tidy(run), schema), "chat-tokens")
    placed = from_parts(sums, F.size("token_ids")).withColumn("end", F.col("start") + F.size("token_ids"))
    # An ancestors' interval begins where a node does and ends where one does.
    spans = packed.select("node", F.explode("attends").alias("a")).select("node", F.col("a.start").alias("from"), F.col("a.end").alias("to"))
    spans = spans.join(placed.select("from", F.col("start").alias("s")), "from").join(placed.select("to", F.col("end").alias("e")), "to")
    spans = spans.groupBy("node").agg(F.array_sort(F.collect_list(F.struct(F.col("s").alias("start"), F.col("e").alias("end")))).alias("attends"), F.sum(F.col("e") - F.col("s")).alias("pos"))
    whole = placed.join(spans, "node", "left")
    pos, size = F.coalesce("pos", F.lit(0).cast("long")), F.size("token_ids")
    positions = F.transform(F.sequence(F.lit(0), size - 1), lambda k: pos + k)  # a node has its marks' tokens at least
    return whole.select("node", "parent", "depth", "token_ids", "loss_mask", "start", "end", positions.alias("position_ids"), F.coalesce("attends", F.array().cast("array<struct<start: bigint, end: bigint>>")).alias("attends"))


def decoded(coded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """What a tree in tokens says: node, at (position id of its first token), formatted, loss_start, loss_end (from the loss mask)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for b in batches:
            out = []
            for node, at, ids, mask in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                lo = next((k for k, m in enumerate(mask) if m), 0)
                hi = lo + sum(mask)
                head, learnt, rest = (enc.decode_bytes(x).decode() for x in (ids[:lo], ids[lo:hi], ids[hi:]))
                out.append([node, at, head + learnt + rest, len(head), len(head) + len(learnt)])
            yield _batch(out, ["node", "at", "formatted", "loss_start", "loss_end"], [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64()])

    rows = coded.select("node", F.element_at("position_ids", 1).cast("long").alias("at"), "token_ids", "loss_mask")
    return rows.mapInArrow(tidy(run), "node binary, at long, formatted string, loss_start long, loss_end long")


def pack(turn_rows: DataFrame, materialise) -> DataFrame:
    """The packed output, a row for each node: node, parent, depth, start, end (offsets in the output), pos (position of its first character in a
    conversation), formatted, loss_start, loss_end, attends array<struct<start, end>>. Sorted by start it is the depth-first text.

    materialise(df, tag) writes a table to the shared folder and reads it again.
    """
    # One conversation of each tree path stands for its copies; the order of paths is the order of the tree.
    owners = turn_rows.where(F.col("path").isNotNull()).groupBy("path").agg(F.min(F.struct(F.col("conv_id").isNotNull().alias("set"), F.col("conv_id").alias("conv_id"))).alias("o"))
    ranked = materialise(owners.orderBy("path").select(F.col("o.conv_id").alias("conv_id"), F.monotonically_increasing_id().alias("rank")), "chat-rank")
    own = turn_rows.alias("t").join(ranked.alias("r"), F.expr("t.conv_id <=> r.conv_id")).select("t.*", "r.rank")
    firsts = own.groupBy("node").agg(F.min("rank").alias("first"))
    nodes = own.join(firsts, "node").where(F.col("rank") == F.col("first"))
    schema = NODES
    in_order = nodes.select("node", "parent", F.col("idx").alias("depth"), "pos", "first", "formatted", "loss_start", "loss_end").orderBy("first", "depth")
    sums = materialise(in_order.mapInArrow(tidy(_running), schema), "chat-nodes")
    placed = from_parts(sums, F.length("formatted")).withColumn("end", F.col("start") + F.length("formatted"))
    steps = own.select("conv_id", "idx", "node", "rank").join(placed.select("node", "start", "end", "first"), "node")
    steps = steps.select("conv_id", "idx", "node", "start", (F.col("end") - F.col("start")).alias("size"), (F.col("rank") == F.col("first")).alias("owned"))
    attends = steps.repartition("conv_id").sortWithinPartitions("conv_id", "idx").mapInArrow(tidy(_attend), "node binary, attends array<struct<start: bigint, end: bigint>>")
    return placed.drop("first").join(attends, "node").select("node", "parent", "depth", "start", "end", "pos", "formatted", "loss_start", "loss_end", "attends")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    state: list | None = None
    finish = lambda s: [s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]]
    for b in batches:
        out = []
        for c, formatted, lo, hi in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
            if state is None or state[0] != c:
                if state is not None:
                    out.append(finish(state))
                state = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = parse_turn(formatted)
            learnt = unescape(formatted[lo:hi])
            state[1] += 1
            state[2].update(f"{role}\n{text}\n".encode())
            state[3] += len(learnt)
            state[4].update(learnt.encode())
            state[5] += len(formatted)
        yield _batch(out, names, types)
    if state is not None:
        yield _batch([finish(state)], names, types)


def read_back(turn_rows: DataFrame, packed: DataFrame) -> DataFrame:
    """Digests of every conversation, read from the packed output along its path: `packed` is pack()'s or decoded()'s, and the nodes of a conversation are in the order of their
    positions in it."""
    at = "at" if "at" in packed.columns else "pos"
    walk = turn_rows.select("conv_id", "node").join(packed.select("node", F.col(at).alias("at"), "formatted", "loss_start", "loss_end"), "node").select("conv_id", "at", "formatted", "loss_start", "loss_end")
    return walk.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(tidy(_read), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
