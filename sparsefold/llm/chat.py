"""Chat formatting with a loss mask over assistant texts, aligned by the tokens' offsets.

A turn is rendered as START role SAYS text END. Control strings inside roles and texts are broken by a backslash behind
their first character and backslashes are doubled, so that ``unescaped`` gives the text back and no text can close a
turn. Whole conversations are rendered and encoded once with offsets; a token is under the mask if its span meets the
span of an assistant text, found by binary search in the sorted spans. The markers are single tokens, so no token
reaches over a text's ends, and a conversation may be cut between turns without changing its tokens: it is written in
chunks of bounded size, numbered upwards, and no task holds more than a chunk. A conversation of more than ``HOT_ROWS`` rows
is formatted by many tasks, each a range of its turns; only its digests, which need all its text in order, stream through one.

Rows of a conversation are taken by turn, equal turns by role, then text, nulls first; null roles and texts are empty,
null ids form one conversation, as does an id -1 that is there already. Repeated rows are turns of their own, an empty table gives an empty one, and further
columns are not read. The tokenizer file is read on the driver and travels with the tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sparsefold.llm.shared import broadcast_if_small, stored

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
START, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
#: Control strings of this and of widespread templates.
CONTROLS = (START, SAYS, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|im_start|>", "<|im_end|>")
CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
ESCAPED = re.compile(rf"\\|(?={CONTROL.pattern}).", re.DOTALL)
TURN = re.compile(f"{re.escape(START)}(.*?){re.escape(SAYS)}(.*?){re.escape(END)}", re.DOTALL)
LEARNT = "assistant"
CHUNK_CHARS, ENCODED_AT_ONCE, HOT_ROWS = 1 << 18, 1 << 20, 100_000
#: Characters of a text by which ranges of a long conversation are cut; within one, whole texts are compared.
PREFIX = 64
CHUNKS = "conv_id long, chunk long, text string, ids array<int>, loss_mask array<boolean>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"


def escaped(text: str) -> str:
    if "\\" not in text and not CONTROL.search(text):
        return text
    return ESCAPED.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescaped(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text) if "\\" in text else text


def masked(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens meet one of the spans (n x 2, sorted, apart from each other)."""
    if not len(spans):
        return np.zeros(len(starts), dtype=bool)
    at = np.searchsorted(spans[:, 1], starts, side="right")
    return (at < len(spans)) & (spans[np.minimum(at, len(spans) - 1), 0] < ends)


def tokenizer(json_text: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(json_text)
    t.add_special_tokens([START, SAYS, END])
    return t


class Chunk:
    """A piece of one conversation's rendering, with the spans of assistant texts in it."""

    def __init__(self, conv_id: int | None, number: int):
        self.conv_id, self.number, self.parts, self.spans, self.size = conv_id, number, [], [], 0

    def add(self, role: str, text: str) -> None:
        head, body = f"{START}{escaped(role)}{SAYS}", escaped(text)
        if role == LEARNT and body:
            self.spans.append((self.size + len(head), self.size + len(head) + len(body)))
        self.parts += [head, body, END]
        self.size += len(head) + len(body) + len(END)


def chunks(rows: Iterator[tuple], size: int) -> Iterator[Chunk]:
    """Rows come sorted by conversation, then turn."""
    now = None
    for conv_id, role, text in rows:
        if now is None or now.conv_id != conv_id:
            if now is not None:
                yield now
            now = Chunk(conv_id, 0)
        elif now.size >= size:
            yield now
            now = Chunk(conv_id, now.number + 1)
        now.add(role or "", text or "")
    if now is not None:
        yield now


def batches_of(found: Iterator[Chunk]) -> Iterator[list[Chunk]]:
    some, size = [], 0
    for c in found:
        some.append(c)
        size += c.size
        if size >= ENCODED_AT_ONCE:
            yield some
            some, size = [], 0
    if some:
        yield some


def format_chats(conversations: DataFrame, path: str = TOKENIZER, chunk_chars: int = CHUNK_CHARS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(conv_id, chunk, text, ids, loss_mask); a conversation's chunks follow each other in one partition."""
    with open(path, encoding="utf-8") as f:
        json_text = f.read()

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                yield from zip(*(c.to_pylist() for c in b.slice(at, 1024).columns), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = None, TaskContext.get().partitionId() << 32
        for some in batches_of(chunks(rows_of(batches), chunk_chars)):
            coder = coder or tokenizer(json_text)
            texts = ["".join(c.parts) for c in some]
            ids, masks = [], []
            for c, e in zip(some, coder.encode_batch(texts, add_special_tokens=False), strict=True):
                spans = np.array(e.offsets, dtype=np.int64).reshape(-1, 2)
                ids.append(e.ids)
                masks.append(masked(spans[:, 0], spans[:, 1], np.array(c.spans, dtype=np.int64).reshape(-1, 2)).tolist())
            yield pa.RecordBatch.from_arrays([
                pa.array([c.conv_id for c in some], pa.int64()), pa.array([part + c.number for c in some], pa.int64()), pa.array(texts, pa.string()),
                pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.bool_()))], names=["conv_id", "chunk", "text", "ids", "loss_mask"])

    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    order = ["conv_id", "turn", "role", "text"]
    formatted = lambda rows: rows.sortWithinPartitions(*order).select("conv_id", "role", "text").mapInArrow(run, CHUNKS)
    # At most one row per ``hot_rows`` rows of the input.
    hot = stored(turns.groupBy("conv_id").count().where(F.col("count") > hot_rows).select(F.col("conv_id").alias("hot")))
    if hot.isEmpty():
        return formatted(turns.repartition("conv_id"))
    is_hot, few = F.col("conv_id").eqNullSafe(F.col("hot")), broadcast_if_small(hot, 16)
    usual = formatted(turns.join(few, is_hot, "left_anti").repartition("conv_id"))
    long = stored(formatted(turns.join(few, is_hot, "left_semi").repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, PREFIX))))
    return usual.unionByName(long.repartition("conv_id").sortWithinPartitions("conv_id", "chunk"))


class Digest:
    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.loss = conv_id, hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.n_tokens = self.n_loss = 0

    def add(self, text: str, ids: np.ndarray, mask: np.ndarray, coder) -> None:
        self.chars += len(text)
        self.n_tokens += len(ids)
        self.n_loss += int(mask.sum())
        for m in TURN.finditer(text):
            self.n_turns += 1
            self.turns.update(f"{unescaped(m[1])}\n{unescaped(m[2])}\n".encode())
        edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
        for a, b in edges.reshape(-1, 2).tolist():
            said = unescaped(coder.decode(ids[a:b].tolist(), skip_special_tokens=False))
            self.loss_chars += len(said)
            self.loss.update(said.encode())

    def row(self) -> tuple:
        return (self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.n_tokens, self.n_loss)


def read_back(formatted: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """One row of counts and digests per conversation, from the chunks of ``format_chats`` as they come: roles and texts
    from the rendering, learnt texts from the ids under the mask."""
    with open(path, encoding="utf-8") as f:
        json_text = f.read()
    names = [c.split()[0] for c in DIGESTS.split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in DIGESTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, now, done = None, None, []
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for b in batches:
            coder = coder or tokenizer(json_text)
            for i in range(b.num_rows):
                conv_id, text = b.column(0)[i].as_py(), b.column(2)[i].as_py()
                if now is None or now.conv_id != conv_id:
                    done += [now.row()] if now else []
                    now = Digest(conv_id)
                now.add(text, b.column(3)[i].values.to_numpy(), b.column(4)[i].values.to_numpy(zero_copy_only=False), coder)
            if done:
                yield out(done)
                done = []
        if now:
            yield out([now.row()])

    return formatted.mapInArrow(run, DIGESTS)
