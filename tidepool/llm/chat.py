"""Chat formatting by columnar byte assembly."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Control strings of this template and of common others; none survives inside a text.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_TAILS = b"|".join(re.escape(c[1:].encode()) for c in CONTROL)
_ESCAPE = re.compile(rb"([<\[])(\\*)(" + _TAILS + rb")")
_UNESCAPE = re.compile(rb"([<\[])\\(\\*)(" + _TAILS + rb")")
_OPEN, _CLOSE = b"<|im_start|>", b"<|im_end|>\n"


def escape(text: bytes) -> bytes:
    """Put one backslash after the first character of every control string, escaped or not: reversible."""
    return _ESCAPE.sub(rb"\1\\\2\3", text)


def unescape(text: bytes) -> bytes:
    return _UNESCAPE.sub(rb"\1\2\3", text)


def _role(role: str) -> bytes:
    """A role as it stands in a header line: backslashes and line feeds escaped too."""
    return escape(role.encode().replace(b"\\", b"\\\\").replace(b"\n", b"\\n"))


def _unrole(head: bytes) -> str:
    return re.sub(rb"\\(.)", lambda m: b"\n" if m[1] == b"n" else m[1], unescape(head), flags=re.S).decode()


def assemble(heads: list[bytes], bodies: list[bytes], first: np.ndarray) -> tuple[pa.Buffer, np.ndarray, np.ndarray, np.ndarray]:
    """Lay turns out in one preallocated buffer.

    heads, bodies: bytes of each turn; first: position of each conversation's first turn and the number of turns. Lengths
    of the three segments of each turn are summed to offsets; each kind of segment is then scattered by its indices.
    Returns the buffer, the conversations' offsets, and each body's begin and end relative to its conversation.
    """
    n = len(heads)
    size = np.zeros((n, 3), np.int64)
    size[:, 0] = np.fromiter(map(len, heads), np.int64, n)
    size[:, 1] = np.fromiter(map(len, bodies), np.int64, n)
    size[:, 2] = len(_CLOSE)
    ends = np.cumsum(size.reshape(-1)).reshape(n, 3)
    starts = ends - size
    total = int(ends[-1, 2]) if n else 0
    buffer = pa.allocate_buffer(total)
    target = np.frombuffer(buffer, np.uint8)
    for column, parts in ((0, b"".join(heads)), (1, b"".join(bodies)), (2, _CLOSE * n)):
        source = np.frombuffer(parts, np.uint8)
        if len(source):
            shift = starts[:, column] - (np.cumsum(size[:, column]) - size[:, column])
            target[np.arange(len(source)) + np.repeat(shift, size[:, column])] = source
    offsets = np.concatenate([[0], ends[:, 2]])[first]
    base = np.repeat(offsets[:-1], np.diff(first))
    return buffer, offsets, starts[:, 1] - base, ends[:, 1] - base


def format_chats(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted (binary, UTF-8) and loss, the byte spans [begin, end) under the loss mask.

    Every turn becomes ``<|im_start|>role\\n text <|im_end|>\\n``; control strings inside texts and roles are escaped
    reversibly. Rows go by turn, then role, then text, nulls first; null text and role are empty; repeated rows repeat;
    the rows of a null conv_id are one conversation; an empty table gives no rows.
    """
    order = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))))
    rows = turns.groupBy(F.col(conv_id).cast("long").alias("conv_id")).agg(order.alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            flat = lists.flatten()
            roles, texts = flat.field("role").to_pylist(), flat.field("text").to_pylist()
            heads = [_OPEN + _role(r) + b"\n" for r in roles]
            bodies = [escape(t.encode()) for t in texts]
            first = np.asarray(lists.offsets) - lists.offsets[0].as_py()
            buffer, offsets, begin, end = assemble(heads, bodies, first)
            formatted = pa.Array.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(offsets.astype(np.int64)), buffer]).cast(pa.binary())
            own = np.fromiter((r == loss_role for r in roles), bool, len(roles))
            counts = np.concatenate([[0], np.cumsum(own)])[first]
            spans = pa.StructArray.from_arrays([pa.array(begin[own]), pa.array(end[own])], ["begin", "end"])
            yield pa.RecordBatch.from_arrays([b.column(0), formatted, pa.ListArray.from_arrays(pa.array(counts, pa.int32()), spans)], ["conv_id", "formatted", "loss"])

    return rows.mapInArrow(run, "conv_id long, formatted binary, loss array<struct<begin:long,end:long>>")


_TURN = re.compile(rb"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def parse_chat(formatted: bytes) -> list[tuple[str, str]]:
    """Read a formatted conversation back: its (role, text) turns."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"no turn at byte {at}")
        turns.append((_unrole(m[1]), unescape(m[2]).decode()))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn at byte {at}")
    return turns


def chat_digests(chats: DataFrame) -> DataFrame:
    """What a formatted conversation says when it is read back: turns and loss text as digests, lengths in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for conv, formatted, loss in zip(*(c.to_pylist() for c in b.columns)):
                turns = parse_chat(formatted)
                said = "".join(unescape(formatted[x["begin"]:x["end"]]).decode() for x in loss)
                digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                out.append((conv, len(turns), digest, len(said), hashlib.sha256(said.encode()).hexdigest(), len(formatted.decode())))
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    return chats.select("conv_id", "formatted", "loss").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
