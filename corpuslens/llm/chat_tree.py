"""Chat formatting as packed prefix trees.

Conversations are sorted by the sequence of their turns' hashes, which is the depth-first order of the tree of
all conversations: those with the same first turns stand beside each other. Going through them in that order,
only turns that differ from the conversation before are written. The result is packs: a text in which each shared
turn stands once, its nodes (start, end, parent, position of the first token, the ancestors' intervals that its
tokens may attend to besides their own node), the spans under the loss mask, and the conversations that end at
a node. A pack that is full is closed and the path to the current turn is written again in the next, so neither
a first turn that a third of all conversations share nor a conversation with many copies makes a large group.
A token is a code point here; positions and intervals count those.

Template: ``<s>role``, a new line, the text, ``</s>``; a user's text stands between ``[INST] `` and `` [/INST]``.
Control strings inside roles and texts are escaped: a backslash becomes two, and the first character of what
would read as a control string becomes a backslash and a letter.

Defined cases: null text or role is empty; turns are ordered by turn, role, text (null first); null conv_id is one
conversation; repeated rows are turns of their own; other columns are ignored; an empty table gives no pack. A single
conversation has to fit in a task, like a single text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared

_CONTROL = re.compile(r"\\|<(?=/?s>)|\[(?=/?INST\])")
_TO = {"\\": "\\\\", "<": "\\l", "[": "\\b"}
_FROM = {"\\": "\\", "l": "<", "b": "[", "n": "\n"}
_ESCAPED = re.compile(r"\\(.)", re.S)

PACK = "text string, start array<int>, end array<int>, parent array<int>, position array<int>, attend array<array<int>>, loss array<array<int>>, leaf_conv array<long>, leaf_node array<int>"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: _TO.get(m[0], m[0]), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _FROM[m[1]], text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn's characters, and the span of its text under the loss mask (empty unless an assistant's)."""
    head = f"<s>{escape(role).replace(chr(10), chr(92) + 'n')}\n"
    body = escape(text)
    if role == "user":
        return f"{head}[INST] {body} [/INST]</s>", 0, 0
    a = len(head)
    return f"{head}{body}</s>", a if role == "assistant" else 0, a + len(body) if role == "assistant" else 0


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    if not (formatted.startswith("<s>") and formatted.endswith("</s>")):
        raise ValueError("not a turn")
    role, _, body = formatted[3:-4].partition("\n")
    role = unescape(role)
    if role == "user":
        if not (body.startswith("[INST] ") and body.endswith(" [/INST]")):
            raise ValueError("not a user's turn")
        body = body[7:-8]
    return role, unescape(body)


class _Pack:
    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size = 0
        self.rows: dict[str, list] = {k: [] for k in ("start", "end", "parent", "position", "attend", "loss", "leaf_conv", "leaf_node")}

    def add(self, turn: tuple[str, str], parent: int) -> int:
        formatted, a, b = format_turn(*turn)
        r, s = self.rows, self.size
        r["start"].append(s)
        r["end"].append(s + len(formatted))
        r["parent"].append(parent)
        r["position"].append(0 if parent < 0 else r["position"][parent] + r["end"][parent] - r["start"][parent])
        seen: list[int] = []
        if parent >= 0:
            seen = list(r["attend"][parent])
            if seen and seen[-1] == r["start"][parent]:
                seen[-1] = r["end"][parent]
            else:
                seen += [r["start"][parent], r["end"][parent]]
        r["attend"].append(seen)
        r["loss"].append([s + a, s + b])
        self.parts.append(formatted)
        self.size += len(formatted)
        return len(r["start"]) - 1

    def row(self) -> dict:
        return {"text": "".join(self.parts), **self.rows}


_SCHEMA = pa.schema([("text", pa.string()), *((k, pa.list_(pa.int32())) for k in ("start", "end", "parent", "position")), ("attend", pa.list_(pa.list_(pa.int32()))), ("loss", pa.list_(pa.list_(pa.int32()))), ("leaf_conv", pa.list_(pa.int64())), ("leaf_node", pa.list_(pa.int32()))])


def pack(turns: DataFrame, pack_chars: int = 1 << 16, pack_leaves: int = 1024) -> DataFrame:
    """Packs of all conversations of (conv_id, turn, role, text)."""
    empty = F.lit("")
    one = F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), empty).alias("role"), F.coalesce(F.col("text").cast("string"), empty).alias("text"))
    whole = turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    step = lambda t: F.substring(F.sha2(F.concat(t["role"], F.lit("\n"), t["text"]), 256), 1, 16)
    keyed = whole.withColumn("path", F.concat_ws("", F.transform("turns", step))).select("conv_id", "path", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, before, nodes = _Pack(), [], []
        for batch in batches:
            for conv, turns in zip(batch.column(0).to_pylist(), batch.column(1)):
                path = [(t["role"], t["text"]) for t in turns.as_py()]
                if now.size >= pack_chars or len(now.rows["leaf_conv"]) >= pack_leaves:
                    yield pa.RecordBatch.from_pylist([now.row()], schema=_SCHEMA)
                    now, before, nodes = _Pack(), [], []
                same = next((i for i, (x, y) in enumerate(zip(path, before)) if x != y), min(len(path), len(before)))
                nodes = nodes[:same]
                for turn in path[same:]:
                    nodes.append(now.add(turn, nodes[-1] if nodes else -1))
                before = path
                now.rows["leaf_conv"].append(conv)
                now.rows["leaf_node"].append(nodes[-1])
        if now.rows["leaf_conv"]:
            yield pa.RecordBatch.from_pylist([now.row()], schema=_SCHEMA)

    dealt = keyed.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").select("conv_id", "turns")
    return dealt.mapInArrow(_shared.lean(run), PACK)


def write(turns: DataFrame, **options: int) -> DataFrame:
    """Packs as a table in the shared folder."""
    return _shared.saved(pack(turns, **options), "packs")


def position_ids(row: dict) -> list[int]:
    """Position of each token of a pack: its distance from its conversation's beginning."""
    return [p + i for s, e, p in zip(row["start"], row["end"], row["position"]) for i in range(e - s)]


RESULT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read(packs: DataFrame) -> DataFrame:
    """One row per conversation, from the packs alone: its turns, its text under the loss mask, its length by the last turn's positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                text = row["text"]
                state: list[tuple] = []
                for s, e, parent, at, seen, (a, b) in zip(*(row[k] for k in ("start", "end", "parent", "position", "attend", "loss"))):
                    turns, loss, n, chars, size = state[parent] if parent >= 0 else (hashlib.sha256(), hashlib.sha256(), 0, 0, 0)
                    if at != size or sum(seen[1::2]) - sum(seen[::2]) != size:
                        raise ValueError("positions and attended intervals have to cover what comes before a turn")
                    role, said = parse_turn(text[s:e])
                    turns, loss = turns.copy(), loss.copy()
                    turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    learnt = unescape(text[a:b])
                    loss.update(learnt.encode("utf-8", "surrogatepass"))
                    state.append((turns, loss, n + 1, chars + len(learnt), at + e - s))
                own = [state[i] for i in row["leaf_node"]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["leaf_conv"], pa.int64()), pa.array([x[2] for x in own], pa.int64()), pa.array([x[0].hexdigest() for x in own], pa.string()), pa.array([x[3] for x in own], pa.int64()), pa.array([x[1].hexdigest() for x in own], pa.string()), pa.array([x[4] for x in own], pa.int64())],
                    names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
                )

    return packs.mapInArrow(_shared.lean(run), RESULT)
