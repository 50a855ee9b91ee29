"""Ranked lexical search over a bit-sliced impact index.

A block of documents holds, for each term, one bitmap per bit of the term's impacts (bit i of a bitmap is document i of the
block). A query adds the bitmaps of its terms by bitwise carry arithmetic, so one machine word adds the scores of 64 documents,
and its best documents are read off from the most significant slice downwards. Nothing is shuffled but the winners of each block.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm._common import lean_workers, stage_table

#: Bytes to their place in a term: letters and digits of ASCII, A-Z lower-cased, and all of other characters; the rest part terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))

#: Documents that a task unpacks at once.
_ROWS = 512

#: Documents of a block: its slices are one row, which a task holds whole in the JVM and in Python.
DOCS_PER_BLOCK = 2048

_FORWARD = "doc_id long, n long, terms array<int>, tfs array<long>"
_INDEX = "docs array<long>, terms array<int>, ends array<long>, widths array<int>, slices binary"
_HITS = "item int, doc_id long, score long"


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a text as UTF-8, in order and with repeats; none for null."""
    return text.encode("utf-8", "replace").translate(_FOLD).split() if text else []


@dataclass(frozen=True)
class Statistics:
    """What scores need of the whole corpus: documents with a term, terms with repeats, and documents holding each asked term."""

    n_docs: int
    n_terms: int
    holders: np.ndarray

    def weights(self) -> np.ndarray:
        return np.array([math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * df + 1))) for df in self.holders.tolist()], np.int64)

    def impacts(self, tf: np.ndarray, n: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Weighted impact of each posting: its share of a document's score."""
        m = 25 + 75 * n * self.n_docs // self.n_terms
        return weight * (1_000_000_000 * tf // (1000 * tf + 8 * m))


def forward_rows(docs: DataFrame, vocabulary: list[bytes], *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, terms, tfs) per document with a term: its length and the counts of the vocabulary's terms, by number."""
    number = {t: i for i, t in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, _ROWS) for whole in batches for at in range(0, whole.num_rows, _ROWS)):
            ids, ns, ends, terms, tfs = [], [], [0], [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                words = terms_of(t.as_py())
                if words:
                    held = sorted((i, k) for w, k in Counter(words).items() if (i := number.get(w)) is not None)
                    ids.append(d)
                    ns.append(len(words))
                    terms += [i for i, _ in held]
                    tfs += [k for _, k in held]
                    ends.append(len(terms))
            at = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.ListArray.from_arrays(at, pa.array(terms, pa.int32())),
                                              pa.ListArray.from_arrays(at, pa.array(tfs, pa.int64()))], ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, _FORWARD)


def statistics_of(forward: DataFrame, n_vocabulary: int) -> Statistics:
    """Counts over all rows of ``forward``; the driver gets one row per term of the vocabulary at most."""
    n_docs, n_terms = forward.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    holders = np.zeros(n_vocabulary, np.int64)
    for r in forward.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toLocalIterator():
        holders[r["t"]] = r["df"]
    return Statistics(n_docs, n_terms, holders)


def bit_slices(places: np.ndarray, values: np.ndarray, n_bytes: int) -> np.ndarray:
    """Bitmaps of the values' bits, least significant first: one row of ``n_bytes`` bytes a bit, bit p % 8 of byte p // 8 for place p."""
    width = int(values.max()).bit_length()
    rows = np.zeros((width, n_bytes), np.uint8)
    marks = np.left_shift(1, places & 7).astype(np.uint8)
    for bit in range(width):
        on = (values >> bit) & 1 == 1
        np.bitwise_or.at(rows[bit], places[on] >> 3, marks[on])
    return rows


def impact_index(forward: DataFrame, stats: Statistics, docs_per_block: int = DOCS_PER_BLOCK, terms_per_block: int = 1 << 18) -> DataFrame:
    """One row per block: its documents by id (nulls last), its terms and their bit slices.

    A block is closed at ``docs_per_block`` documents or ``terms_per_block`` postings, so a row and the memory of its task are
    bounded; slices of one term are compressed together, which keeps those of rare terms small.
    """
    import zlib

    weights = stats.weights()

    def block(parts: list[tuple]) -> pa.RecordBatch:
        ids, n, sizes, terms, tfs = (np.concatenate([p[i] for p in parts]) for i in range(5))
        null = np.concatenate([p[5] for p in parts])
        order = np.lexsort((ids, null))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        by = np.argsort(terms, kind="stable")
        doc, terms = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)[by], terms[by]
        value = stats.impacts(tfs[by], n[doc], weights[terms])
        keep = value > 0
        doc, terms, value = place[doc[keep]], terms[keep], value[keep]
        starts = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]]) if len(terms) else np.zeros(0, np.int64)
        blobs, widths = [], []
        for a, z in zip(starts, np.r_[starts[1:], len(terms)]):
            rows = bit_slices(doc[a:z], value[a:z], -(-len(ids) // 8))
            blobs.append(zlib.compress(rows.tobytes(), 1))
            widths.append(len(rows))
        one = lambda x, kind: pa.array([x], pa.list_(kind))
        docs = pa.array(ids[order], pa.int64(), mask=null[order])
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs), one(terms[starts], pa.int32()), one(np.cumsum([len(x) for x in blobs]).astype(np.int64), pa.int64()),
                                           one(np.array(widths, np.int32), pa.int32()), pa.array([b"".join(blobs)], pa.binary())], ["docs", "terms", "ends", "widths", "slices"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, postings = [], 0, 0
        for whole in batches:
            for b in (whole.slice(at, _ROWS) for at in range(0, whole.num_rows, _ROWS)):
                ids, lists, tfs = b.column(0), b.column(2), b.column(3)
                sizes = np.diff(lists.offsets.to_numpy())
                parts.append((ids.fill_null(0).to_numpy(), b.column(1).to_numpy(), sizes, lists.flatten().to_numpy(), tfs.flatten().to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)))
                held, postings = held + b.num_rows, postings + int(sizes.sum())
                if held + _ROWS > docs_per_block or postings > terms_per_block:
                    yield block(parts)
                    parts, held, postings = [], 0, 0
        if held:
            yield block(parts)

    return forward.mapInArrow(run, _INDEX)


def add_slices(total: list[int], more: list[int], shift: int = 0) -> None:
    """Add numbers held as bit slices, ``more`` times 2 ** shift, to ``total`` in place: a ripple of carries over whole bitmaps."""
    total += [0] * (len(more) + shift - len(total))
    carry = 0
    for i in range(shift, len(total)):
        a, b = total[i], more[i - shift] if i - shift < len(more) else 0
        if not b and not carry:
            if i - shift >= len(more):
                return
            continue
        half = a ^ b
        total[i], carry = half ^ carry, (a & b) | (half & carry)
    if carry:
        total.append(carry)


def top_slices(total: list[int], k: int, n_docs: int) -> tuple[int, int]:
    """Bitmaps (sure, tied): documents surely among the best k with a sum above 0, and those that tie for the places left.

    From the most significant slice down, documents that still may belong are split by their bit: if those with a 1 fill the
    places, the others go, else they are sure.
    """
    sure, open_ = 0, 0
    for s in total:
        open_ |= s  # a sum above 0
    for s in reversed(total):
        ones = open_ & s
        n = sure.bit_count() + ones.bit_count()
        if n > k:
            open_ = ones
        else:
            sure, open_ = sure | ones, open_ & ~s
            if n == k:
                return sure, 0
    return sure, open_


def places_of(bitmap: int, most: int | None = None) -> list[int]:
    """The places of a bitmap's bits in rising order, ``most`` at most."""
    out = []
    while bitmap and (most is None or len(out) < most):
        low = bitmap & -bitmap
        out.append(low.bit_length() - 1)
        bitmap ^= low
    return out


def search_blocks(index: DataFrame, asked: list[list[tuple[int, int]]], k: int, items_at_once: int = 256) -> DataFrame:
    """(item, doc_id, score): the k best documents of each block for each item, ties by smaller id.

    asked: per item, its terms by number with their repeats. Every term's slices are opened once for ``items_at_once`` items and
    added to the sums of those that ask for it.
    """
    import zlib

    groups = []
    for at in range(0, len(asked), items_at_once):
        wants: dict[int, list[tuple[int, int]]] = {}
        for item in range(at, min(at + items_at_once, len(asked))):
            for term, times in asked[item]:
                wants.setdefault(term, []).append((item, times))
        groups.append(wants)

    def hits(row: dict) -> Iterator[tuple]:
        docs, starts, n_bytes = row["docs"], [0, *row["ends"]], -(-len(row["docs"]) // 8)
        where = {t: j for j, t in enumerate(row["terms"])}
        for wants in groups:
            sums: dict[int, list[int]] = {}
            for term in sorted(wants.keys() & where.keys()):
                j = where[term]
                raw = zlib.decompress(row["slices"][starts[j]:starts[j + 1]])
                slices = [int.from_bytes(raw[i:i + n_bytes], "little") for i in range(0, len(raw), n_bytes)]
                for item, times in wants[term]:
                    total = sums.setdefault(item, [])
                    for bit in places_of(times):
                        add_slices(total, slices, bit)
            for item, total in sums.items():
                sure, tied = top_slices(total, k, len(docs))
                best = places_of(sure)
                for p in best + places_of(tied, k - len(best)):
                    yield item, docs[p], sum((s >> p & 1) << i for i, s in enumerate(total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                found = list(hits(b.slice(i, 1).to_pylist()[0]))
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], kind) for c, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["item", "doc_id", "score"])

    return index.mapInArrow(run, _HITS)


def _query_groups(items: DataFrame, item_id: str, text: str, most_items: int, most_terms: int) -> Iterator[list[tuple]]:
    """The items in groups of bounded size, (item_id, counts of terms) each; items come one partition after another."""
    group, seen = [], set()
    for r in items.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).toLocalIterator():
        terms = Counter(terms_of(r["t"]))
        if group and (len(group) >= most_items or len(seen | terms.keys()) > most_terms):
            yield group
            group, seen = [], set()
        group.append((r["i"], terms))
        seen |= terms.keys()
    if group:
        yield group


def ranked_search(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 10,
                  most_items: int = 4096, most_terms: int = 1 << 18, docs_per_block: int = DOCS_PER_BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents of each item, scores above 0 only, ties by smaller doc_id.

    All documents count in the statistics and are ranked. Items are taken in groups of ``most_items`` and ``most_terms`` distinct
    terms, which bounds what goes to the tasks; each group reads the documents once, whatever the number of groups.
    Null, empty and termless texts score nothing and are no documents of the statistics; null ids rank after all others among
    equal scores; rows that repeat an id are documents of their own, items that repeat an id are ranked each for itself. Other
    columns are not read. Empty tables give no rows.
    """
    spark, parts = docs.sparkSession, []
    lean_workers(spark)
    for group in _query_groups(items, item_id, item_text, most_items, most_terms):
        vocabulary = sorted(set().union(*[terms for _, terms in group]))
        number = {t: i for i, t in enumerate(vocabulary)}
        forward = stage_table(forward_rows(docs, vocabulary, doc_id=doc_id, text=text))
        stats = statistics_of(forward, len(vocabulary))
        if not stats.n_docs:
            break
        index = stage_table(impact_index(forward, stats, docs_per_block))
        asked = [[(number[t], c) for t, c in sorted(terms.items())] for _, terms in group]
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        best = search_blocks(index, asked, k).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(i, g[0]) for i, g in enumerate(group)], "item int, item_id long")
        parts.append(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.union, parts)
