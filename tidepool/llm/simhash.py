"""SimHash near-dedup by an inverted index of fingerprint bytes with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm._common import P, stage_table
from tidepool.llm.components import connected_components, named_components

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

#: Hashes whose bits are unpacked at a time, so that a long text needs bounded memory.
_SLAB = 1 << 14


def simhash(text: str | None, shingle: int = 3, words64: int = 1) -> bytes:
    """Fingerprint of 64 * words64 bits, big-endian; null and blank texts give zero.

    A-Z are lower-cased, words are runs of other than ASCII white space, shingles are ``shingle`` words joined by a space
    (repeats included; the whole sequence if there are fewer). A bit is 1 if it is set in over half the XXH64 values; the
    k-th 64 bits use seed 42 + k.
    """
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return bytes(8 * words64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(shingle, len(words))
    stops = ends[k - 1:].tolist()
    starts = [0, *(ends[:len(stops) - 1] + 1).tolist()]
    out = []
    for seed in range(42, 42 + words64):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(stops), _SLAB):
            h = np.array([xxhash.xxh64_intdigest(line[a:b], seed) for a, b in zip(starts[at:at + _SLAB], stops[at:at + _SLAB])], dtype=">u8")
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * ones > len(stops)).tobytes())
    return b"".join(out)


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, words64: int = 1) -> DataFrame:
    """One row per document: doc_id, fp (binary). Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [simhash(t.as_py(), shingle, words64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.binary())], ["doc_id", "fp"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp binary")


def quads() -> list[tuple[int, ...]]:
    """The 14 blocks of the Steiner system S(3, 4, 8): whichever 3 of 8 bytes differ, one block avoids all of them."""
    code = [c for c in combinations(range(8), 4) if not (c[0] ^ c[1] ^ c[2] ^ c[3])]
    assert len(code) == 14
    return code


def lists_to_open(depth: int, n_bytes: int = 8, least: int = 5) -> list[tuple[int, ...]]:
    """Which posting lists, or meets of ``depth`` lists, to open so that every pair with ``least`` equal bytes shares one.

    Of single positions n_bytes - least + 1 are enough. Of meets: deal the positions to so many groups that by pigeonhole
    one group holds ``depth`` of the equal bytes, and take the sets of ``depth`` positions within each group.
    """
    if depth == 1:
        return [(i,) for i in range(n_bytes - least + 1)]
    if (depth, n_bytes, least) == (4, 8, 5):
        return quads()
    groups = (least - 1) // (depth - 1)
    return [c for g in range(groups) for c in combinations(range(g, n_bytes, groups), depth)]


def depth_for(n: int, longest: int, least: int = 5) -> int:
    """How many lists must meet for even fingerprints to leave about ``longest`` of n in a list; grows with the logarithm of n."""
    depth = 1
    while depth < least - 1 and n > longest * 256**depth:
        depth += 1
    return depth


def forest(left: np.ndarray, right: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A spanning forest of links between positions below n."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    kept = []
    for a, b in zip(left.tolist(), right.tolist()):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


@dataclass(frozen=True)
class Tally:
    """Judges fingerprints of 8 bytes or more: shared positional bytes are tallied, pairs that reach the guaranteed minimum
    are verified bit by bit."""

    max_diff: int
    least: int

    def pairs(self, mine: list[bytes], theirs: list[bytes], slab: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        a, b = (np.frombuffer(b"".join(x), np.uint8).reshape(len(x), -1) for x in (mine, theirs))
        words = a.view(np.uint64), b.view(np.uint64)
        columns = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
        step = max(1, slab // max(len(b), 1))
        for at in range(0, len(a), step):
            end = min(at + step, len(a))
            skip = at + 1 if theirs is mine else 0  # a pair is tallied once
            shared = np.zeros((end - at, max(0, len(b) - skip)), np.uint8)
            for j in range(a.shape[1]):
                shared += columns[0][j, at:end, None] == columns[1][j, None, skip:]
            left, right = np.nonzero(shared >= self.least)
            left, right = left + at, right + skip
            near = np.bitwise_count(words[0][left] ^ words[1][right]).sum(axis=1) <= self.max_diff
            yield left[near], right[near]

    def close(self, mine: list[bytes], lead: list[bytes]) -> np.ndarray:
        a, b = (np.frombuffer(b"".join(x), np.uint8).reshape(len(x), -1) for x in (mine, lead))
        enough = (a == b).sum(axis=1) >= self.least
        return enough & (np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)).sum(axis=1) <= self.max_diff)


@dataclass(frozen=True)
class Screen:
    """Judges by size and SimHash whether two sets may have a Jaccard similarity; payload: size (4 bytes) and fingerprint.

    The bits of two sets of this similarity differ with the chance arccos(2s / (1 + s)) / pi at most where sets are large; sets
    of under ``small`` shingles differ more (four shingles in five: 3 / 16). Both radii are ``sds`` standard deviations above
    these means."""

    similarity: float
    bits: int
    sds: float = 6.0
    small: int = 64

    def _radius(self, p: float, bits: int) -> int:
        return int(bits * p + self.sds * np.sqrt(bits * p * (1 - p)))

    def _may(self, n: np.ndarray, m: np.ndarray, diff: np.ndarray, bits: int) -> np.ndarray:
        """Whether sizes, and the differing bits among the first ``bits``, allow a link."""
        low, high = np.minimum(n, m), np.maximum(n, m)
        s = self.similarity
        large, small = self._radius(np.arccos(2 * s / (1 + s)) / np.pi, bits), self._radius(3 / 16, bits)
        return (low >= s * high - 1e-9) & (diff <= np.where(low < self.small, max(small, large), large))

    @staticmethod
    def _split(x: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(b"".join(x), np.uint8).reshape(len(x), -1)
        return np.ascontiguousarray(raw[:, :4]).view(np.int32)[:, 0].astype(np.int64), np.ascontiguousarray(raw[:, 4:]).view(np.uint64)

    def pairs(self, mine: list[bytes], theirs: list[bytes], slab: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        (n, a), (m, b) = self._split(mine), self._split(theirs)
        step = max(1, slab // max(len(b), 1))
        first = min(2, a.shape[1])  # most pairs are told apart by 128 bits
        for at in range(0, len(a), step):
            end = min(at + step, len(a))
            skip = at + 1 if theirs is mine else 0
            diff = np.zeros((end - at, max(0, len(b) - skip)), np.uint16)
            for j in range(first):
                diff += np.bitwise_count(a[at:end, j, None] ^ b[None, skip:, j])
            left, right = np.nonzero(self._may(n[at:end, None], m[None, skip:], diff, 64 * first))
            left, right = left + at, right + skip
            ok = self._may(n[left], m[right], np.bitwise_count(a[left] ^ b[right]).sum(axis=1, dtype=np.int64), self.bits)
            yield left[ok], right[ok]

    def close(self, mine: list[bytes], lead: list[bytes]) -> np.ndarray:
        (n, a), (m, b) = self._split(mine), self._split(lead)
        return self._may(n, m, np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64), self.bits)


@dataclass(frozen=True)
class Exact:
    """Judges sets of shingles, sorted 64-bit values, by their Jaccard similarity."""

    similarity: float

    def _ok(self, both, n, m):
        return both >= self.similarity * (n + m - both) - 1e-9

    def pairs(self, mine: list[bytes], theirs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        own = [np.frombuffer(x, np.uint64) for x in mine]
        other = own if theirs is mine else [np.frombuffer(x, np.uint64) for x in theirs]
        n, m = (np.array([len(x) for x in y], np.int64) for y in (own, other))
        if len(own) * len(other) <= 16:
            hits = [(i, j) for i in range(len(own)) for j in range(i + 1 if theirs is mine else 0, len(other))
                    if self._ok(len(np.intersect1d(own[i], other[j], assume_unique=True)), n[i], m[j])]
            yield np.array([i for i, _ in hits], np.int64), np.array([j for _, j in hits], np.int64)
            return
        # shingles that two sets of the block hold become columns of a bit matrix; others are in no intersection
        every = own if theirs is mine else own + other
        ids, place, seen = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
        column = np.where(seen > 1, np.cumsum(seen > 1) - 1, -1)[place]
        row = np.repeat(np.arange(len(every)), [len(x) for x in every])
        width = -(-int((seen > 1).sum()) // 64)
        bits = np.zeros((len(every), width * 8), np.uint8)
        on = column >= 0
        np.bitwise_or.at(bits, (row[on], column[on] >> 3), (1 << (column[on] & 7)).astype(np.uint8))
        words = bits.view(np.uint64)
        b = words if theirs is mine else words[len(own):]
        for i in range(len(own)):
            at = np.arange(i + 1 if theirs is mine else 0, len(other))
            at = at[np.minimum(n[i], m[at]) >= self.similarity * np.maximum(n[i], m[at]) - 1e-9]
            both = np.bitwise_count(b[at] & words[i]).sum(axis=1, dtype=np.int64)
            hit = at[self._ok(both, n[i], m[at])]
            yield np.full(len(hit), i), hit

    def close(self, mine: list[bytes], lead: list[bytes]) -> np.ndarray:
        sets = ((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(mine, lead))
        return np.array([self._ok(len(np.intersect1d(u, v, assume_unique=True)), len(u), len(v)) for u, v in sets], bool)


def linked(judge, mine: list[bytes], theirs: list[bytes] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among the members of one list, or between them and others (whose positions follow):
    fewer links than members, and bounded memory whatever the number of pairs."""
    others = mine if theirs is None else theirs
    shift, total = (0, len(mine)) if theirs is None else (len(mine), len(mine) + len(theirs))
    kept: list[tuple[int, int]] = []
    for left, right in judge.pairs(mine, others):
        kept += zip(left.tolist(), (right + shift).tolist())
        if len(kept) > 4 * total + 1024:
            kept = forest(*np.array(kept).T, total)
    return forest(*np.array(kept).T, total) if kept else []


def _links_in_lists(lists: DataFrame, judge, few: int = 6) -> DataFrame:
    """lists: one or two columns of arrays of struct(fp, doc); returns (a, b), the links of lists of up to ``few`` members, all
    judged at once, and the forest of each longer list or pair of lists."""

    def small(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Links of the short lists of a batch, and which lists are longer."""
        flat = lists.flatten()
        start = np.asarray(lists.offsets, np.int64)[:-1] - lists.offsets[0].as_py()
        size = np.diff(np.asarray(lists.offsets, np.int64))
        pairs = [(start[size == m] + i, start[size == m] + j) for m in range(2, few + 1) for i, j in combinations(range(m), 2)]
        left, right = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
        if len(left):
            fp = flat.field("fp")
            ok = judge.close(fp.take(pa.array(left)).to_pylist(), fp.take(pa.array(right)).to_pylist())
            left, right = left[ok], right[ok]
        docs = flat.field("doc").to_numpy(zero_copy_only=False)
        return docs[left], docs[right], np.flatnonzero(size > few)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, out_a, out_b = range(batch.num_rows), [], []
            if batch.num_columns == 1:
                a, b, rows = small(batch.column(0))
                out_a.append(a)
                out_b.append(b)
            for i in rows:
                sides = [batch.column(c)[int(i)].values for c in range(batch.num_columns)]
                docs = np.concatenate([x.field("doc").to_numpy(zero_copy_only=False) for x in sides])
                fps = [x.field("fp").to_pylist() for x in sides]
                edges = np.array(linked(judge, *fps) if all(fps) else [], np.int64).reshape(-1, 2)
                out_a.append(docs[edges[:, 0]])
                out_b.append(docs[edges[:, 1]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (out_a, out_b)], ["a", "b"])

    return lists.mapInArrow(run, "a long, b long")


def links_in_groups(index: DataFrame, judge, longest: int = 2048, most_bytes: int = 16 << 20) -> DataFrame:
    """Links (a, b) whose components are those of all links within groups.

    index: key, x (struct of payload fp and doc), rank (which member leads, least first). A group of up to ``longest`` members
    and ``most_bytes`` of payload is one list and gives a spanning forest, not its pairs. A larger one is never gathered:
    members linked to its leader are done in one pass, the others meet all members, blocks against blocks, so no link is lost.
    """
    count, size = F.count("*"), F.sum(F.octet_length("x.fp"))
    blocks = F.greatest(F.ceil(count / longest), F.ceil(size / most_bytes)).cast("int")
    sizes = stage_table(index.groupBy("key").agg(count.alias("n"), blocks.alias("blocks")).filter("n > 1").drop("n"))
    short = index.join(sizes.filter("blocks = 1").select("key"), "key")
    links = _links_in_lists(short.groupBy("key").agg(F.collect_list("x").alias("members")).select("members"), judge)
    long = sizes.filter("blocks > 1")
    return links if long.isEmpty() else links.union(_long_lists(index.join(long, "key"), judge, longest, most_bytes))


def _long_lists(index: DataFrame, judge, longest: int, most_bytes: int) -> DataFrame:
    """Links of groups too long to gather (key, x, rank, blocks); see :func:`links_in_groups`."""
    kind = index.schema["key"].dataType.simpleString()

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            close = judge.close(*(b.column(c).to_pylist() for c in ("fp", "lead_fp"))) if b.num_rows else np.zeros(0, bool)
            keep = ["key", "blocks", "fp", "doc", "lead_doc"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(close)], [*keep, "near"])

    lead = index.groupBy("key").agg(F.min_by("x", F.struct("rank", "x.doc")).alias("lead"))
    flat = index.join(lead, "key").select("key", "blocks", "x.fp", "x.doc", F.col("lead.fp").alias("lead_fp"), F.col("lead.doc").alias("lead_doc"))
    seen = stage_table(flat.mapInArrow(near, f"key {kind}, blocks int, fp binary, doc long, lead_doc long, near boolean"))
    to_lead = seen.filter("near and doc <> lead_doc").select(F.col("doc").alias("a"), F.col("lead_doc").alias("b"))
    rest = seen.filter("not near")
    size = F.greatest(F.ceil(F.count("*") / longest), F.ceil(F.sum(F.octet_length("fp")) / most_bytes)).cast("int")
    left = stage_table(rest.groupBy("key").agg(size.alias("rest_blocks")))
    of = lambda n: F.pmod(F.xxhash64("doc"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    one, none = F.struct("fp", "doc"), F.lit(None).cast("struct<fp:binary,doc:bigint>")
    few = rest.join(left, "key").select("key", of(F.col("rest_blocks")).alias("i"), every(F.col("blocks")).alias("j"), one.alias("u"), none.alias("m"))
    many = seen.join(left, "key").select("key", every(F.col("rest_blocks")).alias("i"), of(F.col("blocks")).alias("j"), none.alias("u"), one.alias("m"))
    pairs = few.union(many).groupBy("key", "i", "j").agg(F.collect_list("u").alias("u"), F.collect_list("m").alias("m")).select("u", "m")
    return to_lead.union(_links_in_lists(pairs, judge).filter("a <> b"))


def _post(reps: DataFrame, lists: list[tuple[int, ...]]) -> DataFrame:
    """The inverted index: a posting (key, x, rank) in each of a fingerprint's lists, a key being byte positions and their values."""
    byte = lambda i: F.substring("fp", i + 1, 1)
    posts = F.array(*[F.concat(F.lit(bytes(key)), *[byte(i) for i in key]) for key in lists])
    return reps.select(F.explode(posts).alias("key"), F.struct("fp", "doc").alias("x"), F.col("doc").alias("rank"))


def near_links(reps: DataFrame, max_diff: int = 3, n_bytes: int = 8, longest: int = 2048, depth: int | None = None) -> DataFrame:
    """Links (a, b) whose components are those of all pairs at ``max_diff`` or fewer differing bits.

    reps: doc (long), fp (binary), fingerprints distinct. At most max_diff differing bits leave n_bytes - max_diff bytes
    equal, so a pair meets in one of the opened lists of (position, byte); there the bytes that it shares are tallied,
    pairs below that minimum go and the rest is verified. Lists of single positions grow with n / 256, so a larger table
    opens meets of two, three or four lists, which lose no pair either (``depth``; by default from the table's size).
    """
    least = n_bytes - max_diff
    if least < 2 or n_bytes % 8:
        raise ValueError("no number of equal bytes is guaranteed at this radius")
    index = _post(reps, lists_to_open(depth or depth_for(reps.count(), longest // 2, least), n_bytes, least))
    return links_in_groups(index, Tally(max_diff, least), longest)


def simhash_components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, words64: int = 1,
                       max_diff: int = 3, depth: int | None = None) -> DataFrame:
    """One row per document: doc_id, fp (binary), component_id (smallest doc_id reachable over links, itself included).

    Documents with one fingerprint are one class, so copies never meet in a join; links are sought between classes, which
    are numbered by themselves: rows without an id link, and others reach each other through them. Null and blank texts have
    fingerprint zero and link like any other. The component of null ids is null where nothing that they reach has an id.
    Repeated rows stay; an empty table gives no rows.
    """
    prints = stage_table(fingerprints(docs, doc_id=doc_id, text=text, shingle=shingle, words64=words64))
    reps = stage_table(prints.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("doc", F.monotonically_increasing_id()))
    parts = connected_components(near_links(reps.select("fp", "doc"), max_diff, 8 * words64, depth=depth))
    classes = named_components(reps.select("fp", "doc", "least"), parts, "doc", "least").select(F.col("fp").alias("c_fp"), "component_id")
    return prints.join(classes, F.col("fp") == F.col("c_fp"), "left").select("doc_id", "fp", "component_id")


#: Texts whose sets are held at a time.
_ROWS = 1024


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """The distinct shingles of a text as sorted XXH64 values (seed 42); A-Z lower-cased, words as in :func:`simhash`."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    stops = ends[min(shingle, len(words)) - 1:].tolist()
    starts = [0, *(ends[:len(stops) - 1] + 1).tolist()]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, stops)), np.uint64, len(stops)))


def set_print(ids: np.ndarray, words64: int = 8) -> bytes:
    """SimHash of a set of shingles, each counted once: 64 * words64 bits, each 64 from the values mixed anew."""
    ones = np.zeros(64 * words64, np.int64)
    odd = np.arange(1, 2 * words64, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(ids), 255):  # sums of 255 bits fit a byte
        z = ids[at:at + 255, None] * odd
        z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        z = z ^ (z >> np.uint64(29))
        ones += np.add.reduce(np.unpackbits(z.view(np.uint8).reshape(len(z), -1), axis=1), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(ids)).tobytes()


def prefix_length(n: int, similarity: float) -> int:
    """How many of its n shingles, first in an order that all sets share, a set must post: two sets of this similarity
    then share one, since they share ``similarity`` of each set at least."""
    return n - int(np.ceil(n * similarity - 1e-9)) + 1 if n else 0


def _common(rows: DataFrame, shingle: int, every: int = 16, least: int = 4, most: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles and their counts in one of ``every`` documents. They only set the order in which shingles are
    posted, rare ones first: the cost depends on it, the links do not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py(), shingle).view(np.int64))], ["s"])

    seen = rows.filter(F.pmod("h1", F.lit(every)) == 0).select("text").mapInArrow(run, "s long").groupBy("s").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    top = sorted((r["s"], r["n"]) for r in seen.orderBy(F.desc("n"), "s").limit(most).collect())
    ids = np.array([x for x, _ in top], np.int64).view(np.uint64)
    order = np.argsort(ids)
    return ids[order], np.array([n for _, n in top], np.int64)[order]


def _set_prints(rows: DataFrame, shingle: int, words64: int, similarity: float) -> DataFrame:
    """id, h1, h2, set (128 bits that stand for the set of shingles), fp (its size and SimHash), keys (the posted shingles)."""
    common, counts = _common(rows, shingle)

    def posted(ids: np.ndarray) -> np.ndarray:
        at = np.searchsorted(common, ids)
        weight = np.zeros(len(ids), np.int64)
        hit = at < len(common)
        hit[hit] = common[at[hit]] == ids[hit]
        weight[hit] = counts[at[hit]]
        return ids[np.lexsort((ids, weight))[:prefix_length(len(ids), similarity)]].view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, _ROWS) for whole in batches for at in range(0, whole.num_rows, _ROWS)):
            sets, fps, keys = [], [], []
            for t in b.column(3):
                ids = shingle_set(t.as_py(), shingle)
                sets.append(xxhash.xxh3_128_digest(ids.tobytes()))
                fps.append(np.int32(len(ids)).tobytes() + set_print(ids, words64))
                keys.append(posted(ids))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sets, pa.binary()), pa.array(fps, pa.binary()), lists], ["id", "h1", "h2", "set", "fp", "keys"])

    return rows.mapInArrow(run, "id long, h1 long, h2 long, set binary, fp binary, keys array<long>")


def _sets(need: DataFrame, rows: DataFrame, shingle: int) -> DataFrame:
    """node, ids: the sets of shingles of the nodes in ``need`` (node, h1, h2), from the whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, _ROWS) for whole in batches for at in range(0, whole.num_rows, _ROWS)):
            sets = [shingle_set(t.as_py(), shingle).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["node", "ids"])

    texts = rows.join(need, ["h1", "h2"]).select("node", "text")
    return texts.mapInArrow(run, "node long, ids binary").dropDuplicates(["node"])


def byte_links(reps: DataFrame, max_diff: int = 3) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of nodes that differ in ``max_diff`` or fewer of the first 64 bits
    of their SimHash: by the index of fingerprint bytes, tally and verification of :func:`near_links`; equal ones are one class.

    reps: node, fp (size, then SimHash).
    """
    own = F.substring("fp", 5, 8)  # after the four bytes of the size
    classes = stage_table(reps.groupBy(own.alias("fp")).agg(F.min("node").alias("doc")))
    same = reps.select("node", own.alias("fp")).join(classes, "fp").filter("node <> doc").select(F.col("doc").alias("a"), F.col("node").alias("b"))
    return near_links(classes.select("doc", "fp"), max_diff).union(same)


def set_links(reps: DataFrame, rows: DataFrame, shingle: int, similarity: float, words64: int = 8, longest: int = 2048, few: int = 512) -> DataFrame:
    """Links (a, b) between nodes whose components are those of all pairs with this Jaccard similarity at least.

    reps: node, first (h1 and h2 of a row with its text), fp, keys. Candidates come from the index of fingerprint bytes
    (:func:`byte_links`), which finds the pairs within its radius, and, for the pairs beyond it, from the lists of posted
    shingles (:func:`links_in_groups`), whose members are screened by size and SimHash: the components of both hold every pair
    that may be a link, and each node is in one. In these components the members' sets of shingles are compared.
    """
    index = reps.select("node", F.explode("keys").alias("key"))
    lists = stage_table(index.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"))
    posts = stage_table(index.join(lists, "key"))
    x = lambda payload, doc: F.struct(F.col(payload).alias("fp"), F.col(doc).alias("doc"))
    screened = posts.join(reps.select("node", "fp"), "node").select("key", x("fp", "node").alias("x"), F.col("node").alias("rank"))
    parts = connected_components(byte_links(reps).union(links_in_groups(screened, Screen(similarity, 64 * words64), longest)))
    joined = stage_table(parts.union(parts.select(F.col("component").alias("node"), "component").distinct()))
    # the member that shares most leads its group: most others are near it
    shares = posts.groupBy("node").agg((-F.sum("c")).alias("rank"))
    need = reps.join(joined, "node").join(shares, "node", "left").select("node", "component", F.coalesce("rank", F.lit(0)).alias("rank"), "first.h1", "first.h2")
    sets = stage_table(_sets(need, rows, shingle).join(need.select("node", "component", "rank"), "node").select(F.col("component").alias("key"), x("ids", "node").alias("x"), "rank"))
    return stage_table(links_in_groups(sets, Exact(similarity), few))


def drop_near_copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8,
                     words64: int = 8) -> DataFrame:
    """``docs`` with one row of each group of near copies; columns stay.

    A link is a Jaccard similarity of the sets of five-word shingles of 0.8 or more, verified on the whole texts (shingles
    stand as XXH64 values). The index of fingerprint bytes (:func:`byte_links`) finds the pairs within 3 of 64 SimHash bits. At
    this similarity 15 % of the bits may differ, so no number of equal bytes is guaranteed for the others; an exact way finds
    them: each set posts its rarest shingles too, as many as make every such pair share one, and members of a list are screened
    by size and by 512-bit SimHash (:class:`Screen`). Then the sets are compared. Groups are the components of the links.
    Of a group the row with the smallest id stays, null ids last, then by a hash of the row; rows are told apart by their
    values, not by id, so rows without an id or with a repeated one go only as copies. Null and blank texts are copies of
    each other. An empty table stays empty.
    """
    names = [c for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    cols = [*map(F.col, names), *[F.col(c).isNull() for c in names]]  # a hash passes over nulls, so their places count too
    h1, h2 = F.xxhash64(*cols), F.xxhash64(F.lit(1), *cols)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), h1.alias("h1"), h2.alias("h2"), F.col(text).cast("string").alias("text"))
    prints = stage_table(_set_prints(rows, shingle, words64, similarity))
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "h1", "h2")
    classes = prints.groupBy("set").agg(F.min(order).alias("first"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    reps = stage_table(classes.select(F.monotonically_increasing_id().alias("node"), "first", "fp", "keys"))
    parts = connected_components(set_links(reps, rows, shingle, similarity, words64))
    groups = reps.join(parts, "node", "left").groupBy(F.coalesce("component", "node").alias("group")).agg(F.min("first").alias("first"))
    stay = groups.select(F.col("first.h1").alias(f"{P}h1"), F.col("first.h2").alias(f"{P}h2"))
    kept = docs.withColumn(f"{P}1", h1).withColumn(f"{P}2", h2)
    kept = kept.join(stay, (F.col(f"{P}1") == F.col(f"{P}h1")) & (F.col(f"{P}2") == F.col(f"{P}h2")), "left_semi")
    return kept.dropDuplicates([f"{P}1", f"{P}2"]).drop(f"{P}1", f"{P}2")
