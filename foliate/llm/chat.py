"""Chat formatting with offset-aligned loss masks.

A conversation is rendered by one template, ``### role: text</turn>\\n`` per turn, encoded once with byte offsets, and
the sorted spans of assistant texts are intersected with the token spans by binary search. A token that straddles a
border is in the mask with the part of it that lies inside (``skip``, ``keep``: bytes), so the masked bytes are the
assistant texts exactly.

Control strings inside texts and roles are escaped by backslashes and can't be taken for the template's: a backslash
goes before every backslash, before ``###`` and before ``</turn>`` (in roles also before ``: ``).

Conversations are streamed: rows are dealt by conversation and sorted by turn, and a conversation is emitted in chunks
of about CHUNK characters, cut between turns. A turn's border is also a border of the tokeniser's words (a line feed
before ``#``), so the chunks' tokens are those of the whole. A conversation of any number of turns needs the memory of one
chunk: CHUNK characters and one turn, whatever that turn's length. Its turns are read in one task, since its digests
run over them in order.

Defined cases: null text or role is empty; null turns come first; ties in turn are ordered by role and text; rows that
repeat are turns of their own; rows of a null conversation id are one conversation; extra columns are ignored, whatever their names; an
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import load

CHUNK = 1 << 18
LOSS_ROLE = "assistant"
END = "</turn>\n"
ESCAPE, ESCAPE_ROLE = re.compile(r"\\|###|</turn>"), re.compile(r"\\|###|</turn>|: ")
UNESCAPE = re.compile(r"\\(.)", re.S)
TURN = re.compile(r"### ((?:\\.|[^\\])*?): ((?:\\.|[^\\])*?)</turn>\n", re.S)
FORMATTED = (
    "conv_id long, chunk long, last boolean, formatted string, ids binary, "
    "mask array<struct<first:int,until:int,skip:int,keep:int>>"
)


def escape(text: str, pattern: re.Pattern = ESCAPE) -> str:
    return pattern.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int]:
    """A turn as formatted, and where its text starts."""
    head = f"### {escape(role, ESCAPE_ROLE)}: "
    return head + escape(text) + END, len(head)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of formatted text."""
    return [(unescape(role), unescape(text)) for role, text in TURN.findall(formatted)]


def align(spans: list[tuple[int, int]], ends: np.ndarray) -> list[dict]:
    """Intersects sorted byte spans with tokens that end at ``ends``: token range, bytes to skip in it, bytes to keep."""
    if not spans:
        return []
    low, high = np.array(spans, np.int64).T
    first = np.searchsorted(ends, low, "right")
    until = np.searchsorted(ends, high, "left") + 1
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else np.zeros(1, np.int64)
    rows = []
    for s, e, f, u in zip(low.tolist(), high.tolist(), first.tolist(), until.tolist()):
        if e > s:
            rows.append({"first": f, "until": u, "skip": s - int(starts[f]), "keep": e - s})
        else:
            rows.append({"first": f, "until": f, "skip": 0, "keep": 0})
    return rows


class Chunk:
    def __init__(self, conv, number: int):
        self.conv, self.number, self.parts, self.spans, self.chars, self.bytes = conv, number, [], [], 0, 0

    def add(self, role: str, text: str) -> None:
        turn, start = render(role, text)
        head, size = len(turn[:start].encode()), len(turn.encode())
        if role == LOSS_ROLE:
            self.spans.append((self.bytes + head, self.bytes + size - len(END)))
        self.parts.append(turn)
        self.chars += len(turn)
        self.bytes += size


def format_conversations(rows: DataFrame, path: str) -> DataFrame:
    """conv_id, chunk, last, formatted, ids, mask: chunks of each conversation in order, in one partition."""

    def emit(ready: list[tuple[Chunk, bool]]) -> pa.RecordBatch:
        bpe = load(path)
        texts = ["".join(c.parts) for c, _ in ready]
        ids = bpe.encode_batch(texts)
        masks = [align(c.spans, bpe.ends(np.frombuffer(i, "<u4"))) for (c, _), i in zip(ready, ids)]
        mask_type = pa.list_(pa.struct([(k, pa.int32()) for k in ("first", "until", "skip", "keep")]))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([c.conv for c, _ in ready], pa.int64()), pa.array([c.number for c, _ in ready], pa.int64()),
                pa.array([last for _, last in ready], pa.bool_()), pa.array(texts, pa.string()),
                pa.array(ids, pa.binary()), pa.array(masks, mask_type),
            ],
            ["conv_id", "chunk", "last", "formatted", "ids", "mask"],
        )

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ready, chars = None, [], 0
        for batch in stream:
            for conv, role, text in zip(*(batch.column(i) for i in range(3))):
                conv, role, text = conv.as_py(), role.as_py() or "", text.as_py() or ""
                if now is not None and (now.conv != conv or now.chars >= CHUNK):
                    ready.append((now, now.conv != conv))
                    chars += now.chars
                    now = Chunk(conv, now.number + 1 if now.conv == conv else 0)
                    if chars >= CHUNK:
                        yield emit(ready)
                        ready, chars = [], 0
                now = now or Chunk(conv, 0)
                now.add(role, text)
        if now is not None:
            yield emit([*ready, (now, True)])

    dealt = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    dealt = dealt.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, FORMATTED)


def masked(formatted_bytes: bytes, ends: np.ndarray, mask: list[dict]) -> Iterator[str]:
    """The texts under the mask, found through the token offsets."""
    for m in mask:
        at = (int(ends[m["first"] - 1]) if m["first"] else 0) + m["skip"]
        yield formatted_bytes[at : at + m["keep"]].decode()


def read_back(chunks: DataFrame, path: str, in_order: bool = False) -> DataFrame:
    """Digests of each conversation, from the formatted text, the ids and the mask alone.

    ``in_order``: the chunks are still dealt and sorted as ``format_conversations`` left them; else they are dealt again.
    A conversation whose chunks are not complete and in order raises.
    """
    if not in_order:
        chunks = chunks.repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        turns, loss, counts = hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
        conv, number = None, 0
        for batch in stream:
            done = []
            for row in batch.to_pylist():
                if row["chunk"] != number or (number and row["conv_id"] != conv):
                    raise ValueError(f"chunk {row['chunk']} of conversation {row['conv_id']} is out of order")
                conv, number = row["conv_id"], 0 if row["last"] else number + 1
                ids = np.frombuffer(row["ids"], "<u4")
                raw = b"".join([bpe.bytes_of[i] for i in ids.tolist()])
                for role, text in parse(row["formatted"]):
                    counts[0] += 1
                    turns.update(f"{role}\n{text}\n".encode())
                for text in map(unescape, masked(raw, bpe.ends(ids), row["mask"])):
                    counts[1] += len(text)
                    loss.update(text.encode())
                counts[2] += len(row["formatted"])
                if row["last"]:
                    done.append((row["conv_id"], counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]))
                    turns, loss, counts = hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
            if done:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names)
        if number:
            raise ValueError(f"conversation {conv} ends after chunk {number - 1}, which is not its last")

    return chunks.mapInArrow(run, schema)
