"""Chat formatting by columnar byte assembly.

One conversation becomes one string. Every turn opens with a header and closes with a
footer built from control strings; texts and roles are escaped so that no control string
survives inside them, and the escape can be undone exactly. Lengths, cumulative offsets and
gather indices are numpy arrays over a whole Arrow batch, and all bytes are written into one
preallocated buffer that becomes the Arrow string column.

Defined cases: null text is the empty text; null role is the empty role; rows whose conv_id is
null form one conversation with a null id; null turns come first; equal turns are ordered by
role, then text; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, whole_groups

ESCAPE = "\\"
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")
TURNS = {
    "user": ("[INST] ", " [/INST]"),
    "assistant": ("<s>", "</s>"),
    "system": ("<<SYS>>\n", "\n<</SYS>>"),
}
FORMATTED = "conv_id long, formatted string, n_turns long, loss_spans array<struct<start:int,end:int>>"
_CHUNK = 4 << 20


def escape(text: str) -> str:
    text = text.replace(ESCAPE, ESCAPE * 2)
    for c in CONTROLS:
        text = text.replace(c, c[0] + ESCAPE + c[1:])
    return text


def _escape_column(col: pa.Array) -> pa.Array:
    col = pc.replace_substring(col, ESCAPE, ESCAPE * 2)
    for c in CONTROLS:
        col = pc.replace_substring(col, c, c[0] + ESCAPE + c[1:])
    return col


_UNESCAPE = re.compile(rb"\\(.)", re.S)


def unescape(raw: bytes) -> bytes:
    return _UNESCAPE.sub(rb"\1", raw) if b"\\" in raw else raw


def frame_of(role: str) -> tuple[bytes, bytes]:
    """Header and footer bytes of a turn."""
    if role in TURNS:
        head, foot = TURNS[role]
    else:
        head, foot = f"[ROLE] {escape(role)} [/ROLE]", "</s>"
    return head.encode(), foot.encode()


def parse(raw: bytes) -> list[tuple[str, bytes]]:
    """(role, text) of every turn, read back from formatted bytes."""
    out, at = [], 0
    frames = [(r, h.encode(), f.encode()) for r, (h, f) in TURNS.items()]
    while at < len(raw):
        for role, head, foot in frames:
            if raw.startswith(head, at):
                begin = at + len(head)
                break
        else:
            if not raw.startswith(b"[ROLE] ", at):
                raise ValueError(f"no turn at byte {at}")
            close = raw.index(b" [/ROLE]", at)
            role, foot = unescape(raw[at + 7 : close]).decode(), b"</s>"
            begin = close + 8
        end = raw.index(foot, begin)
        out.append((role, unescape(raw[begin:end])))
        at = end + len(foot)
    return out


def _bytes_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a string array without nulls."""
    col = col.cast(pa.large_string())
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=np.int64, count=len(col) + 1 + col.offset)[col.offset :]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, offsets


def _assemble(table: pa.Table) -> pa.RecordBatch:
    """One output row per conversation; ``table`` holds whole conversations in order."""
    ids = table["conv_id"].combine_chunks()
    roles = pc.fill_null(table["role"].combine_chunks(), "")
    texts = _escape_column(pc.fill_null(table["text"].combine_chunks(), ""))
    n = len(ids)
    codes = roles.dictionary_encode()
    code, names = codes.indices.to_numpy(), codes.dictionary.to_pylist()
    frames = [frame_of(r) for r in names]
    pool = b"".join(h + f for h, f in frames)
    head_len = np.array([len(h) for h, _ in frames], np.int64)
    foot_len = np.array([len(f) for _, f in frames], np.int64)
    head_at = np.concatenate([[0], np.cumsum(head_len + foot_len)[:-1]])
    data, offsets = _bytes_of(texts)
    # three segments a turn: header, text, footer
    source = np.concatenate([np.frombuffer(pool, np.uint8), data])
    start = np.empty((n, 3), np.int64)
    size = np.empty((n, 3), np.int64)
    start[:, 0], size[:, 0] = head_at[code], head_len[code]
    start[:, 1], size[:, 1] = offsets[:-1] + len(pool), np.diff(offsets)
    start[:, 2], size[:, 2] = head_at[code] + head_len[code], foot_len[code]
    start, size = start.ravel(), size.ravel()
    target = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(int(target[-1]), np.uint8)
    cuts = np.unique(np.searchsorted(target, np.arange(0, target[-1] + _CHUNK, _CHUNK), "left").clip(0, len(size)))
    for a, b in zip(cuts[:-1], cuts[1:]):
        lo, hi = target[a], target[b]
        index = np.repeat(start[a:b] - (target[a:b] - lo), size[a:b]) + np.arange(hi - lo)
        out[lo:hi] = source[index]
    same = np.zeros(n, bool)
    if n > 1:
        key = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
        null = pc.is_null(ids).to_numpy(zero_copy_only=False)
        same[1:] = (key[1:] == key[:-1]) & (null[1:] == null[:-1])
    first = np.flatnonzero(~same)
    bounds = np.concatenate([first, [n]])
    text_at, text_end = target[1:-1:3], target[2::3]
    wanted = np.array([r == "assistant" for r in names], bool)[code] if n else np.zeros(0, bool)
    conv = np.cumsum(~same) - 1
    base = target[first * 3]
    spans = pa.StructArray.from_arrays(
        [
            pa.array((text_at - base[conv])[wanted], pa.int32()),
            pa.array((text_end - base[conv])[wanted], pa.int32()),
        ],
        ["start", "end"],
    )
    counts = np.concatenate([[0], np.cumsum(np.bincount(conv[wanted], minlength=len(first)))])
    offsets_out = target[bounds * 3]
    formatted = pa.LargeStringArray.from_buffers(
        len(first), pa.py_buffer(offsets_out.astype(np.int64)), pa.py_buffer(out)
    ).cast(pa.string())
    return pa.RecordBatch.from_arrays(
        [
            ids.take(pa.array(first)),
            formatted,
            pa.array(np.diff(bounds), pa.int64()),
            pa.ListArray.from_arrays(pa.array(counts, pa.int32()), spans),
        ],
        ["conv_id", "formatted", "n_turns", "loss_spans"],
    )


def _format_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in whole_groups(batches, "conv_id"):
        yield _assemble(t)


def format_chats(conversations: DataFrame) -> DataFrame:
    """Format (conv_id, turn, role, text) rows: one row per conversation.

    ``loss_spans`` are byte ranges of the formatted text under the loss mask: exactly the
    (escaped) assistant texts. A conversation is one output string, so its turns meet in one
    task; conversations are dealt by a hash of their id and streamed in sorted order.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    )
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return arrow_map(dealt.select("conv_id", "role", "text"), _format_partition, FORMATTED)
