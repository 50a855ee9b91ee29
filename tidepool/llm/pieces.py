"""SentencePiece encoding and decoding by a weighted finite-state transducer."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.llm.spans import SpanTable, before, ends_word, flags, slices, stretches

SPACE = "▁"

#: Entries that a worker keeps of coded units and, at most, of neighbours checked one by one.
_CACHE = 400_000

#: Longest unit that is composed together with others, characters that are composed at once, and places for checked neighbours.
_LONG, _CHARS, _PLACES = 256, 200_000, 1 << 20


class _Lookup:
    """Values of whole numbers, by open addressing over arrays; -1 for those without one."""

    def __init__(self, entries: dict[int, int]) -> None:
        keys, values = np.array(list(entries), np.int64), np.array(list(entries.values()), np.int32)
        bits = (8 * len(keys) + 8).bit_length()
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        at = _place(keys, self.shift)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            in_ = self.keys[at] == keys
            self.values[at[in_]] = values[in_]
            keys, values, at = keys[~in_], values[~in_], at[~in_] + 1 & self.last

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = _place(keys, self.shift)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], np.int32(-1))
        left = np.flatnonzero((held != keys) & (held >= 0))
        while len(left):
            at[left] = at[left] + 1 & self.last
            held = self.keys[at[left]]
            here = held == keys[left]
            out[left[here]] = self.values[at[left[here]]]
            left = left[~here & (held >= 0)]
        return out


def _place(keys: np.ndarray, shift: np.uint64) -> np.ndarray:
    return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> shift).astype(np.int64)


class Transducer:
    """Normaliser, pieces and byte fallback of a BPE model with byte fallback, compiled for shortest paths.

    Normaliser: every character reads as itself but for the space mark U+2581, which reads as a space; a space is put in front.
    Pieces: a trie over normalised characters, one arc for each piece, which writes its id and weighs minus its score.
    Byte fallback: one arc for each character without a piece, which writes the ids of its bytes.
    Order: a piece may follow another where the model's merge order lets the two stand side by side; elsewhere the arc
    weighs infinity, for scores of such a model are merge ranks, whose plain sums would prefer other segmentations.

    A text is composed with these one after the other as it is read; a path's weight is the sum of its arcs' weights, and
    the path of least weight is taken (tropical semiring). The last piece decides which arcs are open, and every beginning
    of a text has one segmentation of finite weight, so one state for each place in the text is enough.
    """

    def __init__(self, model: bytes, remembered: int = _CACHE) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.remembered = remembered
        proto = pb.ModelProto.FromString(model)
        spec, train = proto.normalizer_spec, proto.trainer_spec
        if train.model_type != train.BPE or not train.byte_fallback or spec.name != "identity" or spec.remove_extra_whitespaces:
            raise ValueError("only BPE models with byte fallback and the identity normaliser are supported")
        self.prefix = " " if spec.add_dummy_prefix else ""
        kinds = type(proto.pieces[0]) if proto.pieces else None
        self.ids = {p.piece.replace(SPACE, " "): i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        self.byte_ids = [0] * 256
        self.bytes_of: list[bytes] = []
        for i, p in enumerate(proto.pieces):
            if p.type == kinds.BYTE:
                self.byte_ids[int(p.piece[1:-1], 16)] = i
                self.bytes_of.append(bytes([int(p.piece[1:-1], 16)]))
            else:
                self.bytes_of.append(p.piece.replace(SPACE, " ").encode() if p.type == kinds.NORMAL else b"" if p.type == kinds.CONTROL else " ⁇ ".encode())
        #: weights of the arcs, minus the scores
        self.weight = {i: -float(proto.pieces[i].score) for i in self.ids.values()}
        order = {w: n for n, w in enumerate(sorted({self.weight[i] for p, i in self.ids.items() if len(p) > 1}))}
        self.text = {i: p for p, i in self.ids.items()}
        #: when a piece is made; single characters are there from the start
        self.made = {i: order[self.weight[i]] if len(p) > 1 else -1 for p, i in self.ids.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        for p, i in self.ids.items():
            if len(p) > 1 and all(c in self.ids for c in p):
                ids, last = self._merge(p)
                if len(ids) == 1:
                    self.halves[i] = last
        self.arcs = {p: i for p, i in self.ids.items() if len(p) == 1 or i in self.halves}
        #: the pieces' trie: a node is its id, -1 where no piece ends, and the nodes of the next characters
        self.trie = self._trie()
        #: weights by id, for the search
        self._costs = [self.weight.get(i, math.inf) for i in range(len(proto.pieces))]
        if any(" " in p.lstrip(" ") for p in self.arcs):
            raise ValueError("a piece holds a space after other characters: texts cannot be cut into words")
        if any("\n" in p for p in self.arcs if len(p) > 1):
            raise ValueError("a piece holds a line feed beside other characters: texts cannot be cut at lines")
        # no piece holds a letter or digit before one of these: a word ends there
        joined = {p[k + 1] for p in self.arcs for k in range(len(p) - 1) if p[k].isalnum()}
        self._ends = flags("".join(c for c in ",.!?;:)|" if c not in joined))
        self._pairs: dict[int, bool] = {}
        self._arrays()
        self.table = SpanTable(self._cut, self._encode_units, remembered)

    def _arrays(self) -> None:
        """The pieces' trie, the merges and the pieces as arrays, to compose many units at once."""
        prefixes = sorted({p[:k] for p in self.arcs for k in range(len(p) + 1)})
        number = {p: i for i, p in enumerate(prefixes)}  # the root is 0
        self._next = _Lookup({number[p[:-1]] << 21 | ord(p[-1]): i for p, i in number.items() if p})
        self._ending = np.array([self.arcs.get(p, -1) for p in prefixes], np.int32)
        self._goes_on = np.zeros(len(prefixes), bool)
        self._goes_on[[number[p[:-1]] for p in prefixes if p]] = True
        n = len(self.bytes_of)
        self._made, self._half = np.full(n, -1, np.int64), np.full((2, n), -1, np.int64)
        for i, at in self.made.items():
            self._made[i] = at
        for i, two in self.halves.items():
            self._half[:, i] = two
        self._merges = _Lookup({self.ids[p[:k]] << 20 | self.ids[p[k:]]: self.made[i] for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids})
        # the last entry, number -1, stands for a byte arc
        self._weights, self._sizes = np.array([*self._costs, 0.0]), np.array([*(len(self.text.get(i, "")) for i in range(n)), 1])
        self._places, self._beside = np.full(_PLACES, -1, np.int64), np.zeros(_PLACES, bool)
        self._bytes, self._begins = np.frombuffer(b"".join(self.bytes_of), np.uint8), np.cumsum([0, *map(len, self.bytes_of)])
        self._byte_ids = np.array(self.byte_ids, np.int32)

    def _trie(self) -> dict:
        root, none = {}, {}
        below = {p[:k] for p in self.arcs for k in range(1, len(p))}
        for p in sorted(self.arcs.keys() | below, key=len):
            at = root
            for c in p[:-1]:
                at = at[c][1]
            at[p[-1]] = (self.arcs.get(p, -1), {} if p in below else none)
        return root

    def _merge(self, s: str) -> tuple[list[int], tuple[int, int]]:
        """The merge order itself: pieces of a string of known characters, and the halves of the last merge."""
        n = len(s)
        tok, left, right = [self.ids[c] for c in s], list(range(-1, n - 1)), list(range(1, n + 1))
        last, alive, heap = (-1, -1), [True] * n, []

        def offer(i: int) -> None:
            j = right[i] if i >= 0 else n
            if i >= 0 and j < n and (c := self.ids.get(self.text[tok[i]] + self.text[tok[j]])) is not None:
                heapq.heappush(heap, (self.made[c], i, c, tok[i], tok[j], j))

        for i in range(n):
            offer(i)
        while heap:
            _, i, c, a, b, j = heapq.heappop(heap)
            if alive[i] and j < n and alive[j] and right[i] == j and (tok[i], tok[j]) == (a, b):
                last, tok[i], alive[j], right[i] = (a, b), c, False, right[j]
                if right[i] < n:
                    left[right[i]] = i
                offer(left[i])
                offer(i)
        return [t for t, on in zip(tok, alive) if on], last

    def side_by_side(self, a: int, b: int) -> bool:
        """Whether no merge crosses from a to b: undo the later of the two sides' merges until only characters are left, and
        see whether the pieces then at the border would have merged before that."""
        known = self._pairs.get(a << 20 | b)
        if known is None:
            if len(self._pairs) >= self.remembered:
                self._pairs.clear()
            known = self._pairs[a << 20 | b] = self._free(a, b)
        return known

    def _free(self, a: int, b: int) -> bool:
        before = float("inf")
        while True:
            c = self.ids.get(self.text[a] + self.text[b])
            if c is not None and self.made[c] < before:
                return False
            ma, mb = self.made[a], self.made[b]
            if ma < 0 and mb < 0:
                return True
            if ma > mb:  # a's last merge lies left of the border and so wins a tie
                before, a = ma, self.halves[a][1]
            else:
                before, b = mb + 0.5, self.halves[b][0]

    def _path(self, unit: str) -> list[int]:
        """Compose a stretch of normalised text with the transducer and write the path of least weight."""
        n = len(unit)
        cost, back = [0.0] + [math.inf] * n, [-1] * (n + 1)
        trie, known, free, weight = self.trie, self._pairs, self.side_by_side, self._costs
        for start in range(n):
            so_far, last = cost[start], back[start]
            if so_far == math.inf:
                continue
            end, level = start, trie
            while end < n and (node := level.get(unit[end])) is not None:
                i, level = node
                end += 1
                if i >= 0 and (w := so_far + weight[i]) < cost[end]:
                    if last < 0 or (free(last, i) if (ok := known.get(last << 20 | i)) is None else ok):
                        cost[end], back[end] = w, i
            if end == start:  # byte fallback; whatever follows is open
                if so_far < cost[start + 1]:
                    cost[start + 1], back[start + 1] = so_far, -1
        out: list[int] = []
        while n:
            i = back[n]
            out += (i,) if i >= 0 else [self.byte_ids[x] for x in reversed(unit[n - 1].encode())]
            n -= len(self.text[i]) if i >= 0 else 1
        return out[::-1]

    def _cut(self, data: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Where units begin: at the first space of a run, at and after a line feed, and at a mark after a word."""
        line, space = data == 10, data == 32
        cut = line | before(line) | space & ~before(space)
        cut[ends_word(data, self._ends)] = True
        return cut

    def _free_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """:meth:`_free` of many pairs."""
        ok, left, until = np.ones(len(a), bool), np.arange(len(a)), np.full(len(a), np.iinfo(np.int64).max)
        while len(left):
            made = self._merges.get(a << 20 | b).astype(np.int64)
            crossed = (made >= 0) & (2 * made < until)
            ok[left[crossed]] = False
            go = ~crossed & ((self._made[a] >= 0) | (self._made[b] >= 0))
            left, a, b = left[go], a[go], b[go]
            ma, mb = self._made[a], self._made[b]
            until = np.where(ma > mb, 2 * ma, 2 * mb + 1)
            a, b = np.where(ma > mb, self._half[1, a], a), np.where(ma > mb, b, self._half[0, b])
        return ok

    def _open(self, last: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """:meth:`side_by_side` of many pairs, true beside byte arcs (-1) and where a unit begins; answers are kept by place, the latest one of each."""
        key = last.astype(np.int64) << 20 | piece
        at = _place(key, np.uint64(44))
        held, ok = self._places[at] == key, self._beside[at]
        either = key < 0  # last or piece is -1
        ok |= either
        asked = np.flatnonzero(~(held | either))
        if len(asked):
            new, of = np.unique(key[asked], return_inverse=True)
            free = self._free_pairs(new >> 20, new & (1 << 20) - 1)
            ok[asked] = free[of]
            at = _place(new, np.uint64(44))
            self._places[at] = new
            self._beside[at] = free  # of two new pairs with one place the last stands in both arrays
        return ok

    def _paths(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`_path` of many units: ids one after the other and how many each has.

        First all arcs of the composition are found, a character deeper in the trie at a time; then the arcs are taken in order of
        their place in the unit, those of all units together.
        """
        codes = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.array([len(u) for u in units])
        first = np.cumsum(sizes) - sizes
        unit = np.repeat(np.arange(len(units), dtype=np.int32), sizes)
        offset = (np.arange(len(codes)) - first[unit]).astype(np.int32)
        room = (sizes[unit] - offset).astype(np.int32)
        at, node, deep, arcs = np.arange(len(codes), dtype=np.int32), np.zeros(len(codes), np.int64), 0, []
        while len(at):
            node = self._next.get(node << 21 | codes[at + deep])
            deep += 1
            on = node >= 0
            if deep == 1:  # byte fallback; whatever follows is open
                arcs.append((none := at[~on], np.full(len(none), -1, np.int32), 1))
            at, node = at[on], node[on]
            piece = self._ending[node]
            here = piece >= 0
            arcs.append((at[here], piece[here], deep))
            on = self._goes_on[node] & (room[at] > deep)
            at, node = at[on], node[on].astype(np.int64)
        start, piece = (np.concatenate(x) for x in list(zip(*arcs))[:2])
        size = np.repeat(np.array([x[2] for x in arcs], np.int32), [len(x[0]) for x in arcs])
        order = np.argsort(offset[start].astype(np.uint16), kind="stable")
        start, piece, size = start[order], piece[order], size[order]
        edges = np.concatenate([[0], np.cumsum(np.bincount(offset[start]))]).tolist()
        # a unit of n characters has n + 1 states
        state = start + unit[start]
        end, zero = state + size, first + np.arange(len(units))
        cost, back = np.full(len(codes) + len(units), math.inf), np.full(len(codes) + len(units), -1, np.int32)
        cost[zero] = 0.0
        for a, z in zip(edges, edges[1:]):
            weight = cost[state[a:z]] + self._weights[piece[a:z]]
            on = np.flatnonzero(weight < cost[end[a:z]])
            on = on[self._open(back[state[a + on]], piece[a + on])]
            cost[end[a + on]], back[end[a + on]] = weight[on], piece[a + on]
        ids = np.zeros(len(back), np.int64)  # written at each state of the paths
        now, floor = zero + sizes, zero
        while len(now):
            ids[now] = 1
            now = now - self._sizes[back[now]]
            now, floor = now[on := now > floor], floor[on]
        rare = np.flatnonzero((ids > 0) & (back < 0))
        chars = codes[rare - np.searchsorted(zero, rare, "right")]
        ids[rare] += (chars > 0x7F).astype(np.int64) + (chars > 0x7FF) + (chars > 0xFFFF)
        out = np.repeat(back, ids)
        if len(rare):
            out[out < 0] = self._byte_ids[np.frombuffer(chars.astype(np.uint32).tobytes().decode("utf-32-le").encode(), np.uint8)]
        return out, np.add.reduceat(ids, zero)

    def _encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes, some, held = [], [], [], 0

        def flush() -> None:
            nonlocal some, held
            if some:
                flat, counts = self._paths(some)
                ids.append(flat)
                sizes.append(counts)
            some, held = [], 0

        for u in units:
            if len(u) <= _LONG:
                some.append(u)
                held += len(u)
                if held > _CHARS:
                    flush()
            else:
                flush()
                ids.append(np.array(self._path(u), np.int32))
                sizes.append(np.array([len(ids[-1])]))
        flush()
        return np.concatenate(ids), np.concatenate(sizes)

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts one after the other, and where those of each begin, the end last; none for null and empty texts.
        No piece crosses the border of two units, so a shortest path is one of each unit after the other."""
        lines = pc.replace_substring(pc.fill_null(texts.cast(pa.string()), ""), SPACE, " ")
        if self.prefix:
            lines = pc.if_else(pc.equal(pc.binary_length(lines), 0), lines, pc.binary_join_element_wise("", lines, self.prefix))
        return self.table.encode(lines)

    def encode(self, text: str | None) -> np.ndarray:
        """Piece ids of a text."""
        return self.encode_all(pa.array([text], pa.string()))[0]

    def decode_all(self, ids: np.ndarray, edges: np.ndarray) -> pa.Array:
        """The texts of many id sequences."""
        sizes = self._begins[ids + 1] - self._begins[ids]
        data = self._bytes[stretches(self._begins[ids], sizes)]
        upto = np.concatenate([[0], np.cumsum(sizes)])[edges]
        if self.prefix and len(data):  # the space in front goes
            led = upto[:-1][upto[:-1] < upto[1:]]
            led = led[data[led] == 32]
            upto = upto - np.searchsorted(led, upto)
            data = np.delete(data, led)
        out = pa.StringArray.from_buffers(len(edges) - 1, pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(data))
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:  # byte pieces that make no text
            return pa.array([self.decode(ids[a:z].tolist()) for a, z in zip(edges, edges[1:])], pa.string())
        return out

    def decode(self, ids) -> str:
        """The text of piece ids, without the space that encoding put in front."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return raw[1:] if self.prefix and raw.startswith(" ") else raw


@lru_cache(maxsize=2)
def transducer(model: bytes, remembered: int = _CACHE) -> Transducer:
    """Compiled once for each Python worker."""
    return Transducer(model, remembered)


def read_model(path: str) -> bytes:
    """A model file, read on the driver; it goes to the tasks with the function (about 0.5 MB)."""
    with open(path, "rb") as f:
        return f.read()


def _encoded(batches: Iterator[pa.RecordBatch], model: bytes, place: int, into: str, remembered: int) -> Iterator[pa.RecordBatch]:
    code = transducer(model, remembered)
    for b in (part for whole in batches for part in slices(whole, place)):
        ids, edges = code.encode_all(b.column(place))
        yield _with(b, into, pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids)))


def _decoded(batches: Iterator[pa.RecordBatch], model: bytes, place: int, into: str, remembered: int) -> Iterator[pa.RecordBatch]:
    code = transducer(model, remembered)
    for b in (part for whole in batches for part in slices(whole, place)):
        lists = b.column(place)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        yield _with(b, into, code.decode_all(lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)))


def _with(b: pa.RecordBatch, into: str, column: pa.Array) -> pa.RecordBatch:
    rest = [c for c in b.schema.names if c != into]
    return pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], column], [*rest, into])


def _and(schema: T.StructType, into: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*[f for f in schema if f.name != into], T.StructField(into, kind)])


def encode_documents(docs: DataFrame, model: bytes, *, text: str = "text", into: str = "ids", remembered: int = _CACHE) -> DataFrame:
    """``docs`` and the piece ids of each whole text (array<int>); null and empty texts have no pieces. Nothing is shuffled.

    remembered: entries that a worker keeps of what it has coded; fewer cost time and save memory, the ids are the same.
    """
    place = docs.columns.index(text)
    return docs.mapInArrow(lambda batches: _encoded(batches, model, place, into, remembered), _and(docs.schema, into, T.ArrayType(T.IntegerType())))


def decode_documents(encoded: DataFrame, model: bytes, *, ids: str = "ids", into: str = "decoded", remembered: int = _CACHE) -> DataFrame:
    """``encoded`` and the text of each row's ids; null ids give the empty text."""
    place = encoded.columns.index(ids)
    return encoded.mapInArrow(lambda batches: _decoded(batches, model, place, into, remembered), _and(encoded.schema, into, T.StringType()))


def recode_documents(docs: DataFrame, model: bytes, *, text: str = "text", ids: str = "ids", into: str = "decoded", remembered: int = _CACHE) -> DataFrame:
    """What :func:`decode_documents` gives for :func:`encode_documents`, in one pass: the rows go to a worker once, and a task needs one worker."""
    place, schema = docs.columns.index(text), _and(docs.schema, ids, T.ArrayType(T.IntegerType()))
    at = schema.names.index(ids)
    return docs.mapInArrow(lambda batches: _decoded(_encoded(batches, model, place, ids, remembered), model, at, into, remembered), _and(schema, into, T.StringType()))


def piece_digests(coded: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_hash (of the id sequence) and round_trip: whether decoding gives the text back (U+2581 as a space)."""
    same = F.col("decoded") == F.translate(F.coalesce(F.col(text), F.lit("")), SPACE, " ")
    return coded.select(F.col(doc_id).alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), same.alias("round_trip"))
