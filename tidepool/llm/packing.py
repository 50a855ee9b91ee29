"""Packing of documents into sequences, shortest pack first over the histogram of their lengths.

Documents are cut at the sequence length; what is left of each is its tail. The plan never sees documents, only how many tails
have each length: lengths are placed longest first, each into the packs with most room (the shortest packs), and a pack pattern
is kept with the number of packs that follow it. Packs that stay open are then topped up: the emptiest are given up and their
tails are cut to fill the others. A document finds its place by the rank of its tail among those of equal length.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm._common import P, stage_table
from tidepool.llm.spans import SpanTable, before, ends_word, flags, slices, stretches

#: Rows of bases that are broadcast (about 60 MB); above it they are joined by a shuffle.
_BROADCAST_ROWS = 1_000_000

_PART, _TAIL, _NTH, _FULLS = f"{P}part", f"{P}tail", f"{P}nth", f"{P}fulls"


def read_tokenizer(path: str) -> str:
    """A tokenizer file, read on the driver; it goes to the tasks with the function (1.6 MB)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


#: White space beyond the plain kinds; texts that hold any are coded whole, and so are those with the name of a special token.
_RARE = "[\\x{b}\\x{c}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
#: Spans that are one word of the tokenizer's own: letters, a space before them or none.
_WORD = re.compile(" ?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+")
_PLAIN_SPACE, _MARKS = flags(" \t\n\r"), flags(",.;:!?")
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
#: Spans whose ids are remembered.
_SPANS = 500_000


def _cut(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where spans begin that the tokenizer codes alike alone and in place, since its own words never cross their borders: a space
    may lead a span of other characters, the last space of a run leads what follows, and a letter or digit ends a span before a mark."""
    white = _PLAIN_SPACE[data]
    led, after = before(white), np.zeros(len(data), bool)
    after[:-1] = ~white[1:]
    after[edges[1:][edges[:-1] < edges[1:]] - 1] = False  # a run at the end of a text is one span
    cut = white & (~led | after) | ~white & led & ~before(data == 32)
    cut[ends_word(data, _MARKS)] = True
    return cut


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}


class SpanCoder:
    """Ids of whole texts by the library, which codes each distinct span once while it is remembered; numpy puts texts together."""

    def __init__(self, spec: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.coder = Tokenizer.from_str(spec)
        names = [x.content for x in self.coder.get_added_tokens_decoder().values()]
        self.odd = "|".join([_RARE, *map(re.escape, names)])
        self.line = self.whole("\n")
        self.table = SpanTable(_cut, self.learn, _SPANS)
        self.letters, parts = _byte_letters(), json.loads(spec)
        #: the same model without the library's search for words, for spans that are one word each
        self.words = None
        if (parts.get("pre_tokenizer"), parts.get("normalizer"), parts["model"].get("type")) == (_BYTE_LEVEL, None, "BPE") and len(self.line) == 1:
            rules = {k: v for k, v in parts["model"].items() if k not in ("type", "vocab", "merges") and v is not None}
            merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in parts["model"]["merges"]]
            self.words = Tokenizer(models.BPE(parts["model"]["vocab"], merges, cache_capacity=0, **rules))  # each span comes once
            self.words.pre_tokenizer = pre_tokenizers.Split(self.letters[10], "isolated")

    def forget(self) -> None:
        self.table.forget()

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.coder.encode(text, add_special_tokens=False).ids, np.int32)

    def _parted(self, coder, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the lines of a text and how many each has: those of its line ends part them."""
        ids = np.array(coder.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
        ends = ids == self.line[0]
        return ids[~ends], np.diff(np.concatenate([[-1], np.flatnonzero(ends), [len(ids)]])) - 1

    def learn(self, spans: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new spans one after the other and how many each has: those that line ends may part go to the library in one text."""
        word = _WORD.fullmatch if self.words else lambda x: None
        kind = np.array([0 if word(x) else 2 if x.isspace() or len(self.line) != 1 else 1 for x in spans])
        ids, sizes = [np.zeros(0, np.int32)], np.zeros(len(spans), np.int64)
        for k in range(3):
            some = list(compress(spans, kind == k))
            if k == 2:
                rows = [self.whole(x) for x in some]
                ids, sizes[kind == k] = [*ids, *rows], [len(r) for r in rows]
            elif some:
                text = "\n".join(some)
                flat, n = self._parted(self.coder, text) if k else self._parted(self.words, text.encode().decode("latin-1").translate(self.letters))
                ids, sizes[kind == k] = [*ids, flat], n
        order = np.argsort(kind, kind="stable")
        begin = np.empty(len(spans), np.int64)
        begin[order] = np.cumsum(sizes[order]) - sizes[order]
        return np.concatenate(ids)[stretches(begin, sizes)], sizes

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """Ids of each text."""
        texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string()), "")
        odd = pc.match_substring_regex(texts, self.odd)
        ids, edges = self.table.encode(pc.if_else(odd, "", texts))
        out = [ids[a:z] for a, z in zip(edges.tolist(), edges[1:].tolist())]
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
            out[i] = self.whole(texts[i].as_py())
        return out


@lru_cache(maxsize=2)
def _coder(spec: str) -> SpanCoder:
    return SpanCoder(spec)


def token_ids(docs: DataFrame, spec: str, *, end_id: int = 1, longest: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, doc_tokens, ids) per document, and its number among its task's documents with a tail of the same length.

    ids: little-endian unsigned 32-bit numbers of the whole text, then ``end_id``; null is the empty text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, end = _coder(spec), TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()
        seen, fulls = [0] * longest, 0
        for b in (some for whole in batches for some in slices(whole, 1)):
            raws, numbers = [], []
            for ids in code.encode(b.column(1)):
                n = len(ids) + 1
                tail = n % longest
                raws.append(ids.astype("<u4").tobytes() + end)
                numbers.append((n, tail, seen[tail], fulls))
                seen[tail] += 1
                fulls += n // longest
            sizes, tails, nth, full = zip(*numbers)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(raws, pa.binary()), pa.array([part] * len(sizes), pa.int32()),
                                              pa.array(tails, pa.int32()), pa.array(nth, pa.int64()), pa.array(full, pa.int64())], ["doc_id", "doc_tokens", "ids", _PART, _TAIL, _NTH, _FULLS])

    schema = f"doc_id long, doc_tokens long, ids binary, {_PART} int, {_TAIL} int, {_NTH} long, {_FULLS} long"
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


@dataclass(frozen=True)
class Piece:
    """Tokens ``start`` to ``start + size`` of the tails of one length, for as many tails in order of rank, from rank ``low``, as its pattern has packs."""

    length: int
    start: int
    size: int
    low: int

    def later(self, packs: int) -> Piece:
        return Piece(self.length, self.start, self.size, self.low + packs)


@dataclass
class Pattern:
    """``packs`` packs of like make: the pieces in order, and the room that is left in each."""

    room: int
    packs: int
    pieces: list[Piece] = field(default_factory=list)

    def split(self, packs: int) -> tuple[Pattern, Pattern | None]:
        """The first so many packs, and the others if there are any."""
        if packs == self.packs:
            return self, None
        return Pattern(self.room, packs, self.pieces), Pattern(self.room, self.packs - packs, [p.later(packs) for p in self.pieces])

    def plus(self, piece: Piece) -> Pattern:
        return Pattern(self.room - piece.size, self.packs, [*self.pieces, piece])


class _Shortest:
    """Patterns by room, most first; full ones are put aside."""

    def __init__(self) -> None:
        self.heap: list[tuple[int, int, Pattern]] = []
        self.full: list[Pattern] = []
        self.added = 0

    def put(self, pattern: Pattern | None) -> None:
        if pattern and pattern.room:
            self.added += 1
            heapq.heappush(self.heap, (-pattern.room, self.added, pattern))
        elif pattern:
            self.full.append(pattern)

    def room(self) -> int:
        return -self.heap[0][0] if self.heap else 0

    def take(self) -> Pattern:
        return heapq.heappop(self.heap)[2]


def shortest_pack_first(tails: dict[int, int], longest: int) -> list[Pattern]:
    """Patterns for ``tails[length]`` tails of each length below ``longest``, uncut."""
    packs = _Shortest()
    for length in sorted(tails, reverse=True):
        left, low = tails[length], 0
        while left:
            if packs.room() >= length:
                some, rest = (top := packs.take()).split(min(left, top.packs))
                packs.put(rest)
                packs.put(some.plus(Piece(length, 0, length, low)))
                took = some.packs
            else:  # new packs, each filled with tails of this length
                each = min(longest // length, left)
                many = left // each
                pieces = [Piece(length, 0, length, low + i * many) for i in range(each)]
                packs.put(Pattern(longest - each * length, many, pieces))
                took = each * many
            left, low = left - took, low + took
    return packs.full + [p for _, _, p in sorted(packs.heap, key=lambda x: x[:2])]


def _settled(pattern: Pattern, longest: int, slack: int) -> bool:
    used = longest - pattern.room
    return pattern.room <= slack or used & (used - 1) == 0  # a power of two needs no padding


def top_up(patterns: list[Pattern], longest: int, slack: int) -> list[Pattern]:
    """Give up the emptiest packs and fill the room of the others with their pieces, cut where needed.

    Packs with ``slack`` tokens of room at most, or with a power of two of tokens, stay as they are.
    """
    done = [p for p in patterns if _settled(p, longest, slack)]
    open_ = sorted((p for p in patterns if not _settled(p, longest, slack)), key=lambda p: -p.room)
    room = sum(p.room * p.packs for p in open_)
    loose: list[tuple[int, int, int, Piece, int]] = []  # longest first

    def loosen(piece: Piece, packs: int) -> None:
        heapq.heappush(loose, (-piece.size, piece.length, piece.low, piece, packs))

    held, i = 0, 0
    while i < len(open_) and held < room:
        top = open_[i]
        # giving up a pack frees its tokens and takes its room away
        some, rest = top.split(min(top.packs, -(-(room - held) // longest)))
        held += (longest - top.room) * some.packs
        room -= top.room * some.packs
        for p in some.pieces:
            loosen(p, some.packs)
        if rest:
            open_[i] = rest
        else:
            i += 1
    wanting = _Shortest()
    for p in open_[i:]:
        wanting.put(p)
    while wanting.heap and loose:
        _, _, _, piece, packs = heapq.heappop(loose)
        some, rest = (top := wanting.take()).split(min(packs, top.packs))
        wanting.put(rest)
        if packs > some.packs:
            loosen(piece.later(some.packs), packs - some.packs)
        size = min(piece.size, some.room)
        if size < piece.size:
            loosen(Piece(piece.length, piece.start + size, piece.size - size, piece.low), some.packs)
        wanting.put(some.plus(Piece(piece.length, piece.start, size, piece.low)))
    done += wanting.full + [p for _, _, p in sorted(wanting.heap, key=lambda x: x[:2])]
    pack = Pattern(longest, 1)
    for _, _, _, piece, packs in sorted(loose, key=lambda x: x[:3]):  # less than a pack as a rule, one after the other
        for k in range(packs):
            at = piece.later(k)
            while at.size > pack.room:
                done.append(pack.plus(Piece(at.length, at.start, pack.room, at.low)))
                at = Piece(at.length, at.start + pack.room, at.size - pack.room, at.low)
                pack = Pattern(longest, 1)
            pack = pack.plus(at)
    return done + [pack] * bool(pack.pieces)


def recipes(patterns: list[Pattern], longest: int) -> tuple[list[tuple], int]:
    """(length, low, high, pieces): tails of this length with rank in low..high - 1 have these pieces (start, size, sequence of
    rank low, offset); and the number of packs."""
    held, packs = defaultdict(list), 0
    for p in patterns:
        at = 0
        for x in p.pieces:
            held[x.length].append((x.low, x.low + p.packs, x.start, x.size, packs, at))
            at += x.size
        packs += p.packs
    out = []
    for length, rows in held.items():
        rows.sort()
        edges = sorted({e for r in rows for e in r[:2]})
        over, i = [], 0
        for low, high in zip(edges, edges[1:]):
            while i < len(rows) and rows[i][0] <= low:
                over.append(rows[i])
                i += 1
            over = [r for r in over if r[1] > low]
            out.append((length, low, high, sorted((start, size, sequence + low - a, at) for a, _, start, size, sequence, at in over)))
    return out, packs


def pack_documents(coded: DataFrame, *, longest: int = 2048, slack: int | None = None) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset) per piece of the documents of :func:`token_ids` (same ``longest``).

    Every id lies in one piece; sequences hold ``longest`` ids at most, their offsets have no gaps. Packs with at most ``slack``
    tokens of room (by default a 256th) are not topped up. Repeated rows and null ids are documents of their own; an empty table
    gives no rows. The driver plans from one count per length; documents are ranked by numbers that their tasks gave them and
    the sums of those of the tasks before, so no length is gathered, however many documents have it.
    """
    spark = coded.sparkSession
    held = stage_table(coded, compression="zstd")
    counts = stage_table(held.groupBy(_PART, _TAIL).agg(F.count("*").alias("n"), F.sum(F.floor(F.col("doc_tokens") / longest)).alias("f")))
    tails = {r[_TAIL]: r["n"] for r in counts.filter(F.col(_TAIL) > 0).groupBy(_TAIL).agg(F.sum("n").alias("n")).collect()}  # fewer than longest rows
    plan, packs = recipes(top_up(shortest_pack_first(tails, longest), longest, longest // 256 if slack is None else slack), longest)
    before = Window.partitionBy(_TAIL).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    fulls = counts.groupBy(_PART).agg(F.sum("f").alias("f")).withColumn("base", F.coalesce(F.sum("f").over(Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + packs)  # a row a task
    bases = stage_table(counts.select(_PART, _TAIL, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("low")).join(fulls.select(_PART, "base"), _PART))
    if bases.count() <= _BROADCAST_ROWS:
        bases = F.broadcast(bases)
    shape = "array<struct<start:int,size:int,sequence:long,at:int>>"
    book = spark.createDataFrame(plan, f"{_TAIL} int, first long, past long, pieces {shape}")
    rank = F.col("low") + F.col(_NTH)
    placed = held.join(bases, [_PART, _TAIL]).withColumn("rank", rank)
    ways = placed.join(F.broadcast(book.withColumnRenamed(_TAIL, "b_tail")), (F.col(_TAIL) == F.col("b_tail")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("past")), "left")
    n_full = F.floor(F.col("doc_tokens") / longest)
    cut = lambda start, size: F.substring(F.col("ids"), (start * 4 + 1).cast("int"), (size * 4).cast("int"))
    row = lambda start, size, sequence, at: F.struct(start.cast("long").alias("start"), size.cast("long").alias("length"), cut(start, size).alias("ids"),
                                                     sequence.cast("long").alias("sequence_id"), at.cast("long").alias("offset"))
    whole = F.when(n_full > 0, F.transform(F.sequence(F.lit(0).cast("long"), n_full - 1), lambda i: row(i * longest, F.lit(longest), F.col("base") + F.col(_FULLS) + i, F.lit(0))))
    part = F.transform("pieces", lambda x: row(n_full * longest + x["start"], x["size"], x["sequence"] + F.col("rank") - F.col("first"), x["at"]))
    none = F.array().cast("array<struct<start:bigint,length:bigint,ids:binary,sequence_id:bigint,offset:bigint>>")
    pieces = ways.select("doc_id", "doc_tokens", F.concat(F.coalesce(whole, none), F.coalesce(part, none)).alias("all"))
    return pieces.select("doc_id", "doc_tokens", F.explode("all").alias("x")).select("doc_id", "x.start", "x.length", "x.ids", "doc_tokens", "x.sequence_id", "x.offset")


def padded_sequences(packed: DataFrame, *, longest: int = 2048, pad_id: int = 0) -> DataFrame:
    """(sequence_id, n_tokens, ids): the sequences themselves, padded to ``longest`` unless their tokens are a power of two."""
    pieces = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(pieces, F.lit(b""), lambda all_, x: F.concat(all_, x["ids"]))
    n = F.sum("length")
    pad = F.when(F.bit_count(n) == 1, n).otherwise(longest)
    rows = packed.groupBy("sequence_id").agg(n.alias("n_tokens"), pad.alias("to"), joined.alias("ids"))
    return rows.select("sequence_id", "n_tokens", F.rpad("ids", (F.col("to") * 4).cast("int"), F.lit(int(pad_id).to_bytes(4, "little"))).alias("ids"))
