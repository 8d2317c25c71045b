"""Conversations as token ids with a loss mask that is aligned by offsets.

A conversation is rendered whole, `<|im_start|>role<|im_sep|>text<|im_end|>` for each turn, and encoded once with offsets. The three marks are
tokens of their own, so no token crosses a mark and a text's tokens are those between two marks. Tokens under the loss are found by binary
search: tokens and turns' spans are both sorted, a token belongs to the last span that starts at or before it, if it ends within it.

Roles and texts cannot forge a mark: of `<`, any number of backslashes and `|`, one backslash more stands in the output, one fewer after reading,
so that `<|` never occurs in what is escaped and every text comes back as it was.

Turns are sorted by range, so one conversation with a third of all rows is dealt over many tasks. A task renders the turns that it has; beyond
SEGMENT characters a conversation goes on in a further segment, which changes no token, since a turn starts with a mark. Segments of a
conversation have ascending numbers.

Defined cases: a null text or role is empty; null turns come first; rows of one turn are ordered by role, then text; equal rows are turns
of their own; a null conv_id is one conversation; an assistant's empty text has no token under the loss; a table without rows has no segments.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import parallelism, ship, stored

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Characters after which a conversation goes on in another segment; a turn is never cut.
SEGMENT = 1 << 20
_BARE, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")
SEGMENTS = "conv_id long, segment long, n_turns long, formatted string, token_ids binary, loss_mask binary"
_KIND = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("token_ids", pa.binary()), ("loss_mask", pa.binary())])
_READ = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("n_turns", pa.int64()), ("turns", pa.string()), ("loss", pa.string()), ("formatted_chars", pa.int64())])


def escape(text: str) -> str:
    return _BARE.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, bool]]]:
    """The formatted conversation and the span of every text in it, with whether the loss covers it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        at += len(head)
        spans.append((at, at + len(body), role == "assistant"))
        parts += (head, body, END)
        at += len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a rendered conversation."""
    turns = []
    for turn in formatted.split(START)[1:]:
        role, _, rest = turn.partition(SEP)
        turns.append((unescape(role), unescape(rest[: -len(END)])))
    return turns


def loss_mask(offsets: np.ndarray, spans: list[tuple[int, int, bool]]) -> np.ndarray:
    """Which tokens (rows of start and end, sorted) lie in a span under the loss (sorted, apart). Empty tokens lie nowhere."""
    if not len(offsets) or not spans:
        return np.zeros(len(offsets), bool)
    starts, ends, loss = (np.array(x) for x in zip(*spans, strict=True))
    k = np.searchsorted(starts, offsets[:, 0], "right") - 1
    inside = (k >= 0) & (offsets[:, 1] <= ends[np.maximum(k, 0)]) & (offsets[:, 1] > offsets[:, 0])
    return inside & loss[np.maximum(k, 0)].astype(bool)


def tokenizer(path: str):
    """The byte-level tokenizer of a file, with the three marks as further tokens and offsets that keep spaces."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import AddedToken, Tokenizer, pre_tokenizers

    made = Tokenizer.from_file(path)
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False)
    made.post_processor = None
    made.add_special_tokens([AddedToken(mark, normalized=False, special=True) for mark in (START, SEP, END)])
    return made


def _formatter(path: str, segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, state = None, {"key": None, "turns": [], "size": 0, "number": 0}

        def flush() -> pa.RecordBatch:
            nonlocal encoder
            encoder = encoder or tokenizer(path)
            formatted, spans = render(state["turns"])
            made = encoder.encode(formatted, add_special_tokens=False)
            mask = loss_mask(np.array(made.offsets, np.int64).reshape(-1, 2), spans)
            row = (state["key"], state["number"], len(state["turns"]), formatted, np.array(made.ids, "<u4").tobytes(), mask.astype(np.uint8).tobytes())
            state.update(turns=[], size=0, number=state["number"] + 1)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _KIND, strict=True)], schema=_KIND)

        for batch in batches:
            for part, key, role, text in zip(*(batch.column(c).to_pylist() for c in ("part", "conv_id", "role", "text")), strict=True):
                if state["turns"] and (key != state["key"] or state["size"] >= segment):
                    yield flush()
                if key != state["key"] or state["number"] < part << 32:
                    state.update(key=key, number=part << 32)
                state["turns"].append((role or "", text or ""))
                state["size"] += len(role or "") + len(text or "")
        if state["turns"]:
            yield flush()

    return run


def format_conversations(rows: DataFrame, path: str, segment: int = SEGMENT) -> DataFrame:
    """Segments of conversations (conv_id, turn, role, text): formatted text, ids (little-endian 32-bit) and loss mask (a byte a token).

    path: a byte-level tokenizer's JSON file, on every executor. Further columns are left out.
    """
    ship(rows.sparkSession)
    order = ["conv_id", "turn", "role", "text"]
    dealt = rows.select(*order).repartitionByRange(parallelism(rows.sparkSession), *order).sortWithinPartitions(*order)
    return dealt.select(F.spark_partition_id().cast("long").alias("part"), "conv_id", "role", "text").mapInArrow(_formatter(path, segment), SEGMENTS)


def _reader(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = None
        for batch in batches:
            decoder = decoder or tokenizer(path)
            for row in batch.to_pylist():
                ids, mask = np.frombuffer(row["token_ids"], "<u4"), np.frombuffer(row["loss_mask"], np.uint8)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]]))).reshape(-1, 2)
                loss = "".join(unescape(decoder.decode(ids[a:b].tolist(), skip_special_tokens=False)) for a, b in edges)
                turns = "".join(f"{role}\n{text}\n" for role, text in parse(row["formatted"]))
                out = (row["conv_id"], row["segment"], row["n_turns"], turns, loss, len(row["formatted"]))
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(out, _READ, strict=True)], schema=_READ)

    return run


def read_back(segments: DataFrame, path: str) -> DataFrame:
    """What a reader gets from segments: turns (role, newline, text, newline for each) out of the formatted text, and the text under the loss out of ids and mask."""
    ship(segments.sparkSession)
    return segments.mapInArrow(_reader(path), "conv_id long, segment long, n_turns long, turns string, loss string, formatted_chars long")


def _digester(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of segments of a conversation; digests go on from segment to segment, so a conversation is never held whole."""
    import hashlib

    kind = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    now, state = None, None

    def row() -> pa.RecordBatch:
        n, turns, chars, loss, size = state
        out = (now, n, turns.hexdigest(), chars, loss.hexdigest(), size)
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(out, kind, strict=True)], schema=kind)

    for batch in batches:
        for r in batch.to_pylist():
            if state is None or r["conv_id"] != now:
                if state is not None:
                    yield row()
                now, state = r["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[0] += r["n_turns"]
            state[1].update(r["turns"].encode())
            state[2] += len(r["loss"])
            state[3].update(r["loss"].encode())
            state[4] += r["formatted_chars"]
    if state is not None:
        yield row()


def digests(read: DataFrame) -> DataFrame:
    """One row a conversation: what was read back of all its segments, in order. Segments of one conversation meet in one task, as a digest needs, and stream through it."""
    ship(read.sparkSession)
    met = read.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return met.mapInArrow(_digester, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def round_trip(rows: DataFrame, path: str) -> DataFrame:
    """Formats conversations, writes them, reads them back and digests what was read."""
    return digests(read_back(stored(format_conversations(rows, path), "chat-segments"), path))
