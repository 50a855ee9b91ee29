"""Periodic runs of words, found with the suffix tree by Stoye and Gusfield's method.

The suffix tree of a text is kept as its suffix array and longest common prefixes: a node is an interval of suffixes with a
depth. Of every node all leaves but those of its largest child are listed (smaller-half rule, n log n in all); a leaf i of a
node of depth d starts a tandem repeat of twice d words where suffix i + d is below the node too, and the repeat branches where
the words behind the two halves differ. Rotated to the left as far as its words allow, a branching repeat is a maximal run; runs
that a smaller period already gives are merged with it. Texts are handled in Arrow batches by numpy, many short ones at a time.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.llm._common import P, WORD

_RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))

#: Words that are sorted at once; a longer text is sorted by itself.
_AT_ONCE = 1 << 18


def shared_words(min_length: int, min_exponent: int) -> int:
    """Words that two suffixes of a text with such a run share at least: a run of period q agrees with itself q words on."""
    return min(max(min_length - q, (min_exponent - 1) * q) for q in range(1, min_length + 1))


class SuffixTree:
    """Suffix tree of several texts side by side; texts never share a node below the root.

    codes: the texts' words as numbers, one text after the other; sizes: words of each. ``kept`` are the numbers of the texts in
    which two suffixes share ``least`` words or nearly so (the largest power of two within it); the others have no node of that
    depth, which sorting by doubled prefixes shows on its way, and get no tree.
    """

    def __init__(self, codes: np.ndarray, sizes: np.ndarray, least: int) -> None:
        n, self.codes = len(codes), codes
        ends = np.cumsum(sizes)
        text = np.repeat(np.arange(len(sizes)), sizes)
        self.stops, self.starts = np.repeat(ends, sizes), np.repeat(ends - sizes, sizes)
        enough, kept = 1 << (least.bit_length() - 1), np.zeros(len(sizes), bool)
        key = text * (int(codes.max(initial=0)) + 1) + codes
        self.order = np.argsort(key, kind="stable")
        self.ranks: list[np.ndarray] = []  # after 1, 2, 4, ... words: the first place of each suffix's group in the order
        rank, slots, active, width = np.zeros(n, np.int32), np.arange(n), self.order, 1
        key = key[active]
        while len(active):
            first = np.r_[True, key[1:] != key[:-1]]
            rank[active] = slots[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))]
            self.order[slots] = active
            self.ranks.append(rank.copy())
            tied = ~(first & np.r_[first[1:], True])
            active, slots = active[tied], slots[tied]
            if width == enough:
                kept[text[active]] = True
            behind = active + width
            after = np.where(behind < self.stops[active], rank[np.minimum(behind, n - 1)], -1)
            key = rank[active].astype(np.int64) * (n + 1) + after + 1
            by = np.argsort(key, kind="stable")
            active, key, width = active[by], key[by], 2 * width
        self.kept, self.rank = np.flatnonzero(kept), rank
        self.slots = np.flatnonzero(kept[text])  # a text's suffixes have the places of its words

    def shared(self) -> np.ndarray:
        """Words that each kept suffix shares with the one before it in the order; 0 where that is another text's."""
        here = self.slots
        a, b = self.order[here], self.order[np.maximum(here - 1, 0)]
        a, stop = a.copy(), self.stops[a]
        b = np.where((here > 0) & (self.stops[b] == stop), b, stop)
        out = np.zeros(len(here), np.int64)
        last = len(self.codes) - 1
        for i in range(len(self.ranks) - 1, -1, -1):
            rank = self.ranks[i]
            on = np.flatnonzero((a < stop) & (b < stop))
            on = on[rank[np.minimum(a[on], last)] == rank[np.minimum(b[on], last)]]
            out[on] += 1 << i
            a[on] += 1 << i
            b[on] += 1 << i
        return out

    def nodes(self) -> np.ndarray:
        """Inner nodes below the root as rows: depth, first and last place, first and last place of the largest child."""
        out: list[tuple[int, int, int, int, int]] = []
        depth, low, best_a, best_z = [0], [0], [0], [-1]
        places = self.slots.tolist()
        before = -1
        for here, words in zip([*places, -1], [*self.shared().tolist(), 0]):
            a = z = before  # the child that ends before this suffix: a leaf first, then the nodes that it closes
            while depth[-1] > words:
                if z - a > best_z[-1] - best_a[-1]:
                    best_a[-1], best_z[-1] = a, z
                a = low.pop()
                out.append((depth.pop(), a, z, best_a.pop(), best_z.pop()))
            if words:
                if depth[-1] == words:
                    if z - a > best_z[-1] - best_a[-1]:
                        best_a[-1], best_z[-1] = a, z
                else:
                    depth.append(words)
                    low.append(a)
                    best_a.append(a)
                    best_z.append(z)
            before = here
        return np.array(out, np.int64).reshape(-1, 5)

    def branching_repeats(self, copies: int, slab: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """(start, half): branching tandem repeats to whose left the word stretch goes on for ``copies`` - 2 whole halves at least."""
        rows = self.nodes()
        d, low, high, a, z = rows.T
        parts = np.r_[np.c_[d, low, high, low, a - low], np.c_[d, low, high, z + 1, high - z]]
        parts = parts[parts[:, 4] > 0]
        found = []
        cuts = np.cumsum(parts[:, 4])
        for p in np.split(parts, np.searchsorted(cuts, np.arange(slab, cuts[-1], slab))) if len(parts) else ():
            if not len(p):
                continue
            many = p[:, 4]
            d, low, high = (np.repeat(p[:, i], many) for i in range(3))
            leaf = self.order[np.repeat(p[:, 3] - np.cumsum(many) + many, many) + np.arange(many.sum())]
            for start in (leaf, leaf - d):
                found.append(self._branching(start, d, low, high, copies))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.unique(np.concatenate(found), axis=0)
        return pairs[:, 0], pairs[:, 1]

    def _branching(self, start: np.ndarray, half: np.ndarray, low: np.ndarray, high: np.ndarray, copies: int) -> np.ndarray:
        """Of these starts, those of a branching repeat: both halves begin below the node, and so do the copies to the left."""
        on = np.flatnonzero((start >= 0) & (start + half < len(self.codes)))
        for step in (0, 1, *range(-1, 1 - copies, -1)):
            at = start[on] + step * half[on]
            ok = at >= 0
            at = np.where(ok, at, 0)
            place = self.rank[at]
            on = on[ok & (place >= low[on]) & (place <= high[on])]
        second = start[on] + half[on]
        behind = second + half[on]
        ends = behind >= self.stops[second]
        on = on[ends | (self.codes[second] != self.codes[np.minimum(behind, len(self.codes) - 1)])]
        return np.c_[start[on], half[on]]


def _first_equal(codes: np.ndarray, low: int, start: int, half: int) -> int:
    """How far the stretch of period ``half`` from ``start`` goes on to the left, not beyond ``low``."""
    step = 64
    while start > low:
        a = max(low, start - step)
        apart = np.flatnonzero(codes[a:start] != codes[a + half:start + half])
        if len(apart):
            return a + int(apart[-1]) + 1
        start, step = a, 2 * step
    return start


def maximal_runs(codes: np.ndarray, sizes: np.ndarray, min_length: int, min_exponent: int) -> dict[int, list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each text that has any, by the text's number; starts count from the text's first word."""
    tree = SuffixTree(codes, sizes, shared_words(min_length, min_exponent))
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    if not len(tree.kept):
        return out
    start, half = tree.branching_repeats(min_exponent)
    ends = np.cumsum(sizes)
    reach: dict[int, int] = {}  # of an end: where the run found so far begins
    by = np.lexsort((half, start + 2 * half))
    for s, d in zip(start[by].tolist(), half[by].tolist()):
        end = s + 2 * d
        if reach.get(end, end) <= s:
            continue  # a smaller period spans the repeat, so its run is this one
        low = int(tree.starts[s])
        first = _first_equal(codes, low, s, d)
        reach[end] = first
        if end - first >= max(min_length, min_exponent * d):
            out[int(np.searchsorted(ends, s, "right"))].append((first - low, end - first, d))
    return {i: sorted(x, key=lambda r: (r[0], r[2])) for i, x in out.items()}


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run holds after its first period."""
    if runs:
        edge = np.zeros(len(words) + 1, np.int64)
        for s, n, q in runs:
            edge[s + q] += 1
            edge[s + n] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
    return b" ".join(words)


def find_runs(docs: DataFrame, *, text: str = "text", min_length: int = 24, min_exponent: int = 3, runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """``docs`` with every maximal run of words and the text without the runs' repeated words.

    ``runs``: array of (start, length, period) by start, then period: stretches of consecutive words, ``min_length`` and
    ``min_exponent`` (2 at least) smallest periods long at least, that no neighbour extends. ``collapsed``: the words left when each run keeps its
    first period, joined by one space. Whole texts are searched; null, empty and wordless texts have no runs and collapse to the
    empty text. Rows stay as they are, repeated ones and null ids too; columns named like the results give way to them.
    Nothing is shuffled; a task holds one batch of texts or one long text at a time.
    """
    if min_exponent < 2 or min_length < 2:
        raise ValueError("a run has two periods and two words at least")
    place = docs.columns.index(text)
    rest = [c for c in docs.columns if c not in (runs, collapsed)]

    def chunk(b: pa.RecordBatch, split: list[list[bytes]]) -> pa.RecordBatch:
        number = defaultdict(count().__next__)
        sizes = np.array([len(w) for w in split], np.int64)
        codes = np.fromiter((number[w] for ws in split for w in ws), np.int64, int(sizes.sum()))
        found = maximal_runs(codes, sizes, min_length, min_exponent)
        lists = [[dict(zip(("start", "length", "period"), r)) for r in found.get(i, ())] for i in range(len(split))]
        left = pa.array([collapse(w, found.get(i, [])) for i, w in enumerate(split)], pa.binary()).cast(pa.string())
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        return pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], pa.array(lists, kind), left], [*rest, runs, collapsed])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            split, begun, held = [], 0, 0
            for i, t in enumerate(b.column(place)):
                words = t.as_buffer().to_pybytes().split() if t.is_valid else []
                if split and held + len(words) > _AT_ONCE:
                    yield chunk(b.slice(begun, len(split)), split)
                    split, begun, held = [], i, 0
                split.append(words)
                held += len(words)
            yield chunk(b.slice(begun, len(split)), split)

    schema = T.StructType([*[docs.schema[c] for c in rest], T.StructField(runs, _RUNS), T.StructField(collapsed, T.StringType())])
    return docs.mapInArrow(run, schema)


def plant_tails(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` where texts of one id in ten, by crc32 of the id in decimal, end in a periodic tail; others are unchanged.

    With h the crc32, g = h div 10 and n words, words from a = g mod n on repeat the p = 1 + (n - a) div (3 + g mod 8) words
    from a. Texts without words and rows without id are unchanged; the words of a changed text are joined by one space.
    """
    h = F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def tail(words):
        n = F.size(words)
        a = F.pmod(g, n)
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))
        told = F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + F.pmod(i - a, p)).cast("int"))))
        return F.array_join(told, " ")

    split = F.transform(F.array(F.regexp_extract_all(text, F.lit(WORD), 0)), tail)
    return docs.withColumn(text, F.when((F.pmod(h, F.lit(10)) == 0) & F.regexp_like(text, F.lit(WORD)), F.get(split, F.lit(0))).otherwise(F.col(text)))


def run_digests(found: DataFrame, *, doc_id: str = "doc_id", runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """doc_id, n_runs, the run of greatest exponent (ties: smallest start, then period; none: nulls) and digests of all runs and of what is left."""
    better = lambda a, x: F.when(x["length"] * a["period"] > a["length"] * x["period"], x).otherwise(a)
    best = F.aggregate(runs, F.get(F.col(runs), F.lit(0)), better)
    lines = F.array_join(F.transform(runs, lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n"))), "")
    b = F.col(f"{P}best")
    return found.withColumn(f"{P}best", best).select(
        F.col(doc_id).alias("doc_id"), F.size(runs).cast("long").alias("n_runs"), b["start"].alias("start"), b["length"].alias("length"), b["period"].alias("period"),
        F.expr(f"1000 * {P}best.length div {P}best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col(collapsed), 256).alias("collapsed_sha256"))
