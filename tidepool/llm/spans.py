"""Coding of texts by spans: numpy cuts the bytes of many texts, Arrow finds the distinct spans, each is coded once while it is remembered."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Ids that are remembered in all, before every span is forgotten.
_IDS = 1 << 23
#: Bytes of texts that are coded at once, and ids that are decoded, but for a single longer one: memory does not grow with a batch of long texts.
_HELD, _HELD_IDS = 1 << 21, 1 << 17


def slices(batch: pa.RecordBatch, place: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of a bounded size of the texts or lists in one of its columns."""
    column = batch.column(place)
    length, held = (pc.list_value_length, _HELD_IDS) if pa.types.is_list(column.type) else (pc.binary_length, _HELD)
    upto, at = np.cumsum(pc.fill_null(length(column), 0).to_numpy(), dtype=np.int64), 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + held, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def flags(chars: str | bytes) -> np.ndarray:
    """For each byte, whether it is one of these."""
    out = np.zeros(256, bool)
    out[list(chars.encode("latin-1") if isinstance(chars, str) else chars)] = True
    return out


_ALNUM = flags("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
#: second bytes of ß to ÿ without the division sign; the first is C3
_LATIN = flags(bytes({*range(0x9F, 0xC0)} - {0xB7}))


def before(mask: np.ndarray) -> np.ndarray:
    """The mask moved on by a place: what stands before each byte."""
    out = np.zeros_like(mask)
    out[1:] = mask[:-1]
    return out


def ends_word(data: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Places of those of the bytes ``marks`` that follow an ASCII letter or digit or a letter from ß to ÿ."""
    at = np.flatnonzero(marks[data])
    at = at[at > 0]
    last = data[at - 1]
    return at[_ALNUM[last] | _LATIN[last] & (at > 1) & (data[at - 2] == 0xC3)]


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (strings without nulls) and where each begins, the end last."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, edges, data = texts.cast(pa.string()).buffers()
    edges = np.frombuffer(edges, np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8)
    return data[edges[0]:edges[-1]], edges - edges[0]


def stretches(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1 and so on, sizes[0] of them, then those of the next."""
    upto = np.cumsum(sizes)
    return np.repeat(begin - upto + sizes, sizes) + np.arange(upto[-1] if len(upto) else 0)


class _Numbers(dict):
    """Spans by number; a new one gets the next number and is noted."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, span: str) -> int:
        n = self[span] = len(self)
        self.new.append(span)
        return n


class SpanTable:
    """Ids of the spans that were coded lately, by number. All are forgotten when they are more than ``most``, or their ids too many.

    cut: for the bytes of texts and where each begins, which bytes begin a span beside those that begin a text.
    code: the ids (int32) of a list of distinct spans, one after the other, and how many each has.
    """

    def __init__(self, cut: Callable[[np.ndarray, np.ndarray], np.ndarray], code: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int) -> None:
        self.cut, self.code, self.most = cut, code, most
        self.forget()

    def forget(self) -> None:
        self.numbers = _Numbers()
        self.flat, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _numbered(self, spans: np.ndarray) -> np.ndarray:
        at = np.fromiter(map(self.numbers.__getitem__, spans), np.int64, len(spans))
        if self.numbers.new:
            ids, sizes = self.code(self.numbers.new)
            self.numbers.new = []
            self.flat = np.concatenate([self.flat, ids])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        return at

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where those of each begin, the end last."""
        if len(self.numbers) > self.most or len(self.flat) > _IDS:
            self.forget()
        data, edges = raw_bytes(texts)
        cut = self.cut(data, edges)
        cut[edges[:-1][edges[:-1] < edges[1:]]] = True
        first = np.flatnonzero(cut)
        spans = pa.StringArray.from_buffers(len(first), pa.py_buffer(np.append(first, len(data)).astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
        at = self._numbered(spans.dictionary.to_numpy(zero_copy_only=False))[spans.indices.to_numpy()]
        begin, sizes = self.ends[at], self.ends[at + 1] - self.ends[at]
        ids = self.flat[stretches(begin, sizes)]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        return ids, upto[np.searchsorted(first, edges)]
