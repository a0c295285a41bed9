"""Operator 6: chat formatting into prefix trees.

Conversations are sorted by the hashes of their turns, so those that share initial turns lie
side by side; a range exchange on the hashes and the id splits even a group with one common
first turn. Each partition then streams its conversations through a stack of turns: a turn
shared with the conversation before is not emitted again. A tree (an output row) is closed
before it exceeds ``tree_tokens`` or where the first turn changes; it holds, depth first, the
token ids of its nodes, a position id per token that restarts after the node's parent, the loss
mask, and for each node the intervals of its ancestors, which are what its tokens may attend to
besides their own node. Intervals that touch are one, so only branches add to them, not turns.
Memory is one tree and one conversation.

Template: ``### role: text</turn>`` and a line feed per turn. Inside roles and texts every
backslash is doubled, and ``###``, ``</turn>`` and (in roles) ``:`` get one in front, so no
text can end its turn or begin another. Header, body and end are tokenized apart, so the loss
mask covers exactly the assistant's text.

Edge cases: null role, text or turn count as empty or first; equal turns keep both rows; null
``conv_id`` is one conversation; an empty table gives no trees; other columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synapta.llm.shared import partitions
from synapta.llm.tokens import default_path, encoder

HEAD, COLON, END = "### ", ": ", "</turn>\n"
_ESCAPE, _UNESCAPE = re.compile(r"\\|###|</turn>"), re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, str, str]:
    """Header, body and end of a formatted turn."""
    return HEAD + escape(role).replace(":", "\\:") + COLON, escape(text), END


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


_NODE = T.StructType([T.StructField(n, T.IntegerType()) for n in ("parent", "start", "stop", "position", "loss_start", "loss_stop")])
_SPAN = T.StructType([T.StructField(n, T.IntegerType()) for n in ("start", "stop")])
SCHEMA = T.StructType([
    T.StructField("tree_id", T.LongType()),
    T.StructField("ids", T.ArrayType(T.IntegerType())),
    T.StructField("position_ids", T.ArrayType(T.IntegerType())),
    T.StructField("nodes", T.ArrayType(_NODE)),
    T.StructField("ancestors", T.ArrayType(T.ArrayType(_SPAN))),
    T.StructField("leaves", T.ArrayType(T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("node", T.IntegerType())]))),
])


class Tree:
    """A forest of turns under construction: nodes depth first, with the path to the last one."""

    def __init__(self):
        self.ids, self.positions = array("i"), array("i")
        self.nodes: list[dict] = []
        self.leaves: list[dict] = []
        self.path: list[tuple[tuple[str, str], int]] = []

    def shared(self, turns: list[tuple[str, str]]) -> int:
        n = 0
        for (turn, _), other in zip(self.path, turns):
            if turn != other:
                break
            n += 1
        return n

    def add(self, conv: int | None, turns: list[tuple[str, str]], parts: list[tuple[array, array, array]], common: int) -> None:
        """Append a conversation; ``parts`` has ids of header, body and end of the turns after the first ``common``."""
        del self.path[common:]
        for turn, (head, body, end) in zip(turns[common:], parts, strict=True):
            parent = self.path[-1][1] if self.path else -1
            at = len(self.ids)
            position = self.nodes[parent]["position"] + self.nodes[parent]["stop"] - self.nodes[parent]["start"] if parent >= 0 else 0
            for x in (head, body, end):
                self.ids.extend(x)
            self.positions.extend(range(position, position + len(self.ids) - at))
            body_at = at + len(head)
            loss = (body_at, body_at + len(body)) if turn[0] == "assistant" else (body_at, body_at)
            self.nodes.append({"parent": parent, "start": at, "stop": len(self.ids), "position": position, "loss_start": loss[0], "loss_stop": loss[1]})
            self.path.append((turn, len(self.nodes) - 1))
        self.leaves.append({"conv_id": conv, "node": self.path[-1][1] if self.path else -1})

    def row(self, tree_id: int) -> dict:
        spans: list[list[dict]] = []
        for node in self.nodes:
            if (p := node["parent"]) < 0:
                spans.append([])
                continue
            above, start, stop = spans[p], self.nodes[p]["start"], self.nodes[p]["stop"]
            if above and above[-1]["stop"] == start:
                spans.append([*above[:-1], {"start": above[-1]["start"], "stop": stop}])
            else:
                spans.append([*above, {"start": start, "stop": stop}])
        return {"tree_id": tree_id, "ids": np.frombuffer(self.ids, np.int32), "position_ids": np.frombuffer(self.positions, np.int32), "nodes": self.nodes, "ancestors": spans, "leaves": self.leaves}


def build_trees(rows: Iterator[tuple[int | None, list[tuple[str, str]]]], path: str, tree_tokens: int | None, tree_leaves: int | None) -> Iterator[Tree]:
    """Trees of conversations that come in the order of their turns."""
    tok, tree = encoder(path), Tree()
    for conv, turns in rows:
        common = tree.shared(turns)
        texts = [x for role, text in turns[common:] for x in format_turn(role, text)]
        ids = [array("i", x) for x in tok.encode(texts)]
        grows = sum(map(len, ids))
        full = tree_tokens and len(tree.ids) + grows > tree_tokens or tree_leaves and len(tree.leaves) >= tree_leaves
        if tree.leaves and (common == 0 or full):
            yield tree
            tree = Tree()
            if common:
                common = 0
                ids = [array("i", x) for x in tok.encode([x for role, text in turns for x in format_turn(role, text)])]
        tree.add(conv, turns, list(zip(ids[::3], ids[1::3], ids[2::3], strict=True)), common)
    if tree.leaves:
        yield tree


def format_chats(conversations: DataFrame, path: str | None = None, tree_tokens: int | None = 65_536, tree_leaves: int | None = 1_024) -> DataFrame:
    """Trees of ``conversations`` (conv_id, turn, role, text): see ``SCHEMA``.

    A leaf names the node where a conversation ends (-1: it has no turns); its tokens are those
    of the node's ancestors and the node. A single conversation is never cut, however long. The two
    bounds keep a tree small enough to train on; with None for both, a shared turn is emitted once a partition.
    """
    path = path or default_path()
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    whole = rows.groupBy("conv_id").agg(turns)
    way = F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"]))
    spark = conversations.sparkSession
    ordered = whole.withColumn("way", way).repartitionByRange(partitions(spark), "way", "conv_id").sortWithinPartitions("way", "conv_id").select("conv_id", "turns")

    def run(batches):
        from pyspark import TaskContext

        def conversations():
            for batch in batches:
                for i in range(batch.num_rows):  # one at a time: conversations may be long
                    turns = batch.column("turns")[i].as_py()
                    yield batch.column("conv_id")[i].as_py(), [(t["role"], t["text"]) for t in turns]

        first = TaskContext.get().partitionId() << 32
        out, size = [], 0
        for n, tree in enumerate(build_trees(conversations(), path, tree_tokens, tree_leaves)):
            out.append(tree.row(first + n))
            size += len(tree.ids)
            if size > 1 << 18:
                yield _batch(out)
                out, size = [], 0
        if out:
            yield _batch(out)

    return ordered.mapInArrow(run, SCHEMA)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(SCHEMA)
    flat = lambda n: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[len(r[n]) for r in rows]]), pa.int32()), pa.array(np.concatenate([r[n] for r in rows])))
    return pa.RecordBatch.from_arrays([flat(f.name) if f.name in ("ids", "position_ids") else pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)


def read_tree(row: dict, path: str) -> Iterator[tuple[int | None, str, str]]:
    """(conv_id, formatted conversation, text under the loss mask) of every leaf, from a tree row alone."""
    tok = encoder(path).tokenizer
    decode = lambda ids: tok.decode(ids.tolist(), skip_special_tokens=False)
    ids = np.asarray(row["ids"], np.int32)
    whole = [decode(ids[n["start"] : n["stop"]]) for n in row["nodes"]]
    loss = [unescape(decode(ids[n["loss_start"] : n["loss_stop"]])) if n["loss_stop"] > n["loss_start"] else "" for n in row["nodes"]]
    for leaf in row["leaves"]:
        way, at = [], leaf["node"]
        while at >= 0:
            way.append(at)
            at = row["nodes"][at]["parent"]
        way.reverse()
        yield leaf["conv_id"], "".join(whole[i] for i in way), "".join(loss[i] for i in way)


def read_back(trees: DataFrame, path: str | None = None) -> DataFrame:
    """Per conversation, from the trees: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    path = path or default_path()

    def run(batches):
        from hashlib import sha256

        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i] for n in batch.schema.names}
                row = {n: v.values.to_numpy() if n in ("ids", "position_ids") else v.as_py() for n, v in row.items()}
                out = []
                for conv, formatted, loss in read_tree(row, path):
                    turns = parse(formatted)
                    digest = sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                    out.append((conv, len(turns), digest, len(loss), sha256(loss.encode()).hexdigest(), len(formatted)))
                names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string() if "sha" in n else pa.int64()) for k, n in enumerate(names)], names=names)

    return trees.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
