"""Chat formatting into packed prefix trees.

A conversation is a sequence of turns, each ``<|im_start|>role\\ntext<|im_end|>\\n``. Sorted by the hashes of their
turns, conversations that share initial turns stand together, in depth-first order of their prefix tree. A range
partitioning by that order, ties broken by id, spreads even a first turn that most conversations share. Each task
then walks its range once with a stack of open turns: turns shared with the conversation before are not written
again, new ones are appended to the pack. A pack ends after `PACK_CHARS` tokens, and the next one starts with a fresh
tree, so a shared turn is written once a pack. Tokens are code points here; offsets are in tokens.

For every node of the tree a pack holds start and length, the position id of its first token (its tokens count on
from there, as if the ancestors stood right before it), the parent, the span under the loss mask, and the attention
intervals: the stretches of the pack that its ancestors and itself occupy. A token sees those intervals up to itself.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxelake.llm.common import tune

PACK_CHARS = 1 << 16
START, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"
NODE = "struct<start: bigint, length: bigint, position: bigint, parent: int, loss_start: bigint, loss_length: bigint, intervals: array<struct<start: bigint, end: bigint>>>"
NODE_ARROW = pa.struct(
    [("start", pa.int64()), ("length", pa.int64()), ("position", pa.int64()), ("parent", pa.int32()), ("loss_start", pa.int64()), ("loss_length", pa.int64())]
    + [("intervals", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
)


def escape(text: str) -> str:
    """One backslash more between a ``<`` and a ``|`` that only backslashes part, so no control string is left."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    """As `escape`, and on one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


def format_turn(role: str, text: str) -> tuple[str, int]:
    """(tokens, offset of the text in them)."""
    head = f"{START}{escape_role(role)}\n"
    return f"{head}{escape(text)}{END}\n", len(head)


def parse_turns(tokens: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    at = 0
    while at < len(tokens):
        line = tokens.index("\n", at)
        end = tokens.index(END, line)
        yield unescape_role(tokens[at + len(START) : line]), unescape(tokens[line + 1 : end])
        at = end + len(END) + 1


class Pack:
    """A tree under construction."""

    def __init__(self):
        self.parts, self.size, self.nodes, self.convs = [], 0, [], []
        self.open: list[tuple[tuple[str, str], int]] = []

    def add(self, conv_id, turns: list[tuple[str, str]]) -> None:
        shared = 0
        while shared < min(len(turns), len(self.open)) and self.open[shared][0] == turns[shared]:
            shared += 1
        del self.open[shared:]
        for turn in turns[shared:]:
            tokens, offset = format_turn(*turn)
            parent = self.open[-1][1] if self.open else -1
            above = self.nodes[parent] if self.open else None
            own = {"start": self.size, "end": self.size + len(tokens)}
            intervals = list(above["intervals"]) if above else []
            if intervals and intervals[-1]["end"] == own["start"]:
                intervals[-1] = {"start": intervals[-1]["start"], "end": own["end"]}
            else:
                intervals.append(own)
            trained = turn[0] == TRAINED
            self.nodes.append(
                {
                    "start": self.size,
                    "length": len(tokens),
                    "position": above["position"] + above["length"] if above else 0,
                    "parent": parent,
                    "loss_start": self.size + offset if trained else 0,
                    "loss_length": len(tokens) - offset - len(END) - 1 if trained else 0,
                    "intervals": intervals,
                }
            )
            self.parts.append(tokens)
            self.size += len(tokens)
            self.open.append((turn, len(self.nodes) - 1))
        self.convs.append({"conv_id": conv_id, "node": self.open[-1][1]})


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", pack_chars: int = PACK_CHARS) -> DataFrame:
    """Packs (tokens string, nodes array, convs array<struct<conv_id, node>>) of all conversations.

    A conversation's rows are ordered by turn (null first), then role, then text; repeated rows are turns of their
    own, null roles and texts are empty, and each row without an id is a conversation of its own. An empty table
    gives no pack. Other columns are ignored. A turn is never cut, so a pack can exceed ``pack_chars`` by a conversation.
    """
    tune(rows.sparkSession)
    kind = rows.schema[conv_col].dataType
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    turns = rows.select(F.col(conv_col).alias("__conv"), F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")).alias("__turn"))
    # rows without an id have nothing that ties them together; any number of them is no group
    turns = turns.withColumn("__alone", F.when(F.col("__conv").isNull(), F.monotonically_increasing_id()))
    turns = turns.groupBy("__conv", "__alone").agg(F.array_sort(F.collect_list("__turn")).alias("__turns"))
    turns = turns.withColumn("__path", F.transform("__turns", lambda t: F.xxhash64(t.role, t.text)))
    turns = turns.repartitionByRange("__path", "__conv").sortWithinPartitions("__path", "__conv").select("__conv", "__turns")
    arrow = pa.list_(pa.struct([("conv_id", _arrow_type(kind)), ("node", pa.int32())]))

    def run(batches):
        pack = Pack()

        def closed():
            return pa.RecordBatch.from_arrays(
                [pa.array(["".join(pack.parts)], pa.string()), pa.array([pack.nodes], pa.list_(NODE_ARROW)), pa.array([pack.convs], arrow)],
                names=["tokens", "nodes", "convs"],
            )

        for batch in batches:
            for conv, said in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pack.add(conv, [(t["role"], t["text"]) for t in said])
                if pack.size >= pack_chars:
                    yield closed()
                    pack = Pack()
        if pack.convs:
            yield closed()

    return turns.mapInArrow(run, f"tokens string, nodes array<{NODE}>, convs array<struct<conv_id: {kind.simpleString()}, node: int>>")


def _arrow_type(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def read_back(packs: DataFrame) -> DataFrame:
    """Digests of every conversation, taken from the packs alone: turns by the attention intervals of its last node,
    loss by the masked spans along the path from the root."""
    kind = packs.schema["convs"].dataType.elementType["conv_id"].dataType

    def run(batches):
        for batch in batches:
            rows = []
            for tokens, nodes, convs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for conv in convs:
                    formatted = "".join(tokens[i["start"] : i["end"]] for i in nodes[conv["node"]]["intervals"])
                    said = list(parse_turns(formatted))
                    spans, at = [], conv["node"]
                    while at >= 0:
                        spans.append((nodes[at]["loss_start"], nodes[at]["loss_length"]))
                        at = nodes[at]["parent"]
                    loss = "".join(unescape(tokens[a : a + n]) for a, n in reversed(spans) if n)
                    digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode("utf-8", "surrogatepass"))
                    rows.append((conv["conv_id"], len(said), digest.hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(formatted)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = [_arrow_type(kind), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return packs.mapInArrow(run, f"conv_id {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
