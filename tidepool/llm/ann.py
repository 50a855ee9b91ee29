"""Approximate nearest neighbours by learned partitions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm._common import stage_table
from tidepool.llm.vectors import centres, lengths_of, matrix, of_length, scaled, unit, with_bytes


@dataclass
class Router:
    """A small classifier, one hidden layer, from a unit vector to the chance of each partition."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(unit(x) @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def home(self, x: np.ndarray) -> np.ndarray:
        """The partition that a vector is kept in: its likeliest."""
        return self.logits(x).argmax(axis=1)

    def routes(self, x: np.ndarray, probes: int) -> np.ndarray:
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, :probes]


def neighbour_graph(x: np.ndarray, k: int, slab: int = 1024) -> np.ndarray:
    """The k nearest other rows of each row, by cosine."""
    u = unit(x).astype(np.float32)
    k = min(k, len(u) - 1)
    out = np.zeros((len(u), max(k, 0)), np.int64)
    for at in range(0, len(u) if k > 0 else 0, slab):
        s = u[at:at + slab] @ u.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -2
        out[at:at + slab] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.1) -> np.ndarray:
    """Split a neighbour graph into parts of nearly equal size with few edges cut.

    Starts from balanced cells and moves nodes, those that gain most first, to the part that holds most of their
    neighbours, as long as that part has room.
    """
    n = len(x)
    room = int(np.ceil(slack * n / parts))
    u = unit(x)
    score = u @ unit(centres(u, parts) + 1e-12).T
    part = np.full(n, -1)
    held = np.zeros(score.shape[1], np.int64)
    for i in np.argsort(-(score.max(axis=1)), kind="stable"):
        for p in np.argsort(-score[i], kind="stable"):
            if held[p] < room:
                part[i], held[p] = p, held[p] + 1
                break
    if not graph.shape[1]:
        return part
    both = np.concatenate([np.stack([np.repeat(np.arange(n), graph.shape[1]), graph.reshape(-1)]), np.stack([graph.reshape(-1), np.repeat(np.arange(n), graph.shape[1])])], axis=1)
    for _ in range(rounds):
        votes = np.zeros((n, len(held)))
        np.add.at(votes, (both[0], part[both[1]]), 1)
        gain = votes.max(axis=1) - votes[np.arange(n), part]
        moved = 0
        for i in np.argsort(-gain, kind="stable")[:int((gain > 0).sum())]:
            p = int(votes[i].argmax())
            if held[p] < room:
                held[part[i]] -= 1
                part[i], held[p] = p, held[p] + 1
                moved += 1
        if not moved:
            break
    return part


def fit_router(x: np.ndarray, graph: np.ndarray, part: np.ndarray, parts: int, hidden: int = 128, rounds: int = 30, batch: int = 256, rate: float = 2e-3, seed: int = 3, homes: np.ndarray | None = None) -> Router:
    """Train the classifier by Adam on soft targets: where a vector and its neighbours live.

    graph: neighbours of each row as places in ``part``; homes: the rows' own partitions, ``part`` itself where x is all of it.
    """
    rng = np.random.default_rng(seed)
    u, n = unit(x), len(x)
    target = np.zeros((n, parts))
    target[np.arange(n), part if homes is None else homes] = 1.0
    if graph.shape[1]:
        np.add.at(target, (np.repeat(np.arange(n), graph.shape[1]), part[graph.reshape(-1)]), 1.0 / graph.shape[1])
    target /= target.sum(axis=1, keepdims=True)
    w = [rng.normal(size=(u.shape[1], hidden)) * np.sqrt(2 / u.shape[1]) * 2, np.zeros(hidden), rng.normal(size=(hidden, parts)) / np.sqrt(hidden), np.zeros(parts)]
    first, second, t = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w], 0
    for _ in range(rounds):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            i = order[at:at + batch]
            h = np.maximum(u[i] @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            d = (p / p.sum(axis=1, keepdims=True) - target[i]) / len(i)
            dh = (d @ w[2].T) * (h > 0)
            t += 1
            for v, a, b, g in zip(w, first, second, (u[i].T @ dh, dh.sum(axis=0), h.T @ d, d.sum(axis=0))):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                v -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    return Router(*w)


def _best(query: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest rows of each query among these rows, exactly, ties to the smaller id; a query's own row is left out."""
    x, ids = scaled(matrix(rows["raw"])), rows["id"].to_numpy()
    norm = np.sqrt((x * x).sum(axis=1))
    q, q_ids = scaled(matrix(query["raw"])), query["id"].to_numpy()
    q_norm = np.sqrt((q * q).sum(axis=1))
    out: list[tuple[int, int, float]] = []
    ux = x / norm[:, None]
    step = max(1, (1 << 22) // max(len(x), 1))
    for at in range(0, len(q), step):
        rough = (q[at:at + step] / q_norm[at:at + step, None]) @ ux.T
        for r in range(len(rough)):
            s = rough[r]
            s[ids == q_ids[at + r]] = -3.0
            if len(s) > k:
                edge = np.partition(s, len(s) - k)[len(s) - k] - 1e-9
                near = np.flatnonzero(s >= edge)
            else:
                near = np.arange(len(s))
            near = near[ids[near] != q_ids[at + r]]
            exact = (x[near] * q[at + r]).sum(axis=1) / (norm[near] * q_norm[at + r])
            top = np.lexsort((ids[near], -exact))[:k]
            out += [(int(q_ids[at + r]), int(ids[near[t]]), float(exact[t])) for t in top]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def nearest_neighbours(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5, parts: int | None = None,
                       probes: int | None = None, recall: float = 0.97, sample: int = 6000, graph_k: int = 10, block: int = 16384, seed: int = 3) -> DataFrame:
    """The k nearest other rows found for every row whose id is divisible by ``every``: query_id, rank, vec_id, score.

    The neighbour graph of at most ``sample`` vectors is split into balanced partitions, and a classifier learns from five
    sixths of it where a vector's neighbours live. Every row is indexed in its likeliest partition; a query is answered by its
    likeliest partitions, whose rows are compared exactly (cosine in double precision on the vectors as given, ties to the
    smaller id). ``parts`` grows with the table by default, ``probes`` is the smallest number that finds ``recall`` of the
    neighbours of the sixth that was held out, so clustered tables probe few partitions and shapeless ones most of them.
    Partitions are cut into blocks, on the side of the queries too, so none is gathered whole; a query leaves k rows a block.
    Vectors that are null, zero or hold null or non-finite components take no part, and neither do rows without an id; vectors
    of another length than the query's are no candidates; a repeated query row is answered once; with few candidates all are
    returned; an empty table gives no rows.
    """
    raw = stage_table(with_bytes(vectors, vec_id, vector).filter("id is not null"))
    found = [_search(of_length(raw, n), every, k, parts, probes, recall, sample, graph_k, block, seed) for n in lengths_of(raw)]
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.union, found)


def enough_probes(router: Router, x: np.ndarray, graph: np.ndarray, recall: float) -> int:
    """The smallest number of partitions in which these vectors find this share of their neighbours."""
    homes, routes = router.home(x), router.routes(x, len(router.b2))
    place = np.argsort(routes, axis=1)  # where a partition stands among a vector's routes
    asked = np.arange(5, len(x), 6)
    near = np.concatenate([place[i][homes[graph[i]]] for i in asked]) if len(asked) and graph.shape[1] else np.zeros(0, int)
    share = np.cumsum(np.bincount(near, minlength=routes.shape[1])) / max(1, len(near))
    return int(np.argmax(share >= recall)) + 1 if len(near) and share[-1] >= recall else routes.shape[1]


def _search(raw: DataFrame, every: int, k: int, parts: int | None, probes: int | None, recall: float, sample: int, graph_k: int, block: int, seed: int) -> DataFrame:
    """The search among vectors (id, raw) of one length; see :func:`nearest_neighbours`."""
    some = [bytes(r["raw"]) for r in raw.orderBy(F.xxhash64(F.lit(seed), "id"), "id").select("raw").limit(sample).collect()]
    x = matrix(list(dict.fromkeys(some)))
    # a partition is learned from 20 sampled vectors at least
    parts = min(parts or max(16, raw.count() // 32768), max(1, len(x) // 20))
    graph = neighbour_graph(x, graph_k)
    part = balanced_partition(x, graph, parts)
    learn = np.arange(len(x)) % 6 != 5
    router = fit_router(x[learn], np.zeros((int(learn.sum()), 0), int) if not graph.shape[1] else graph[learn], part, parts, seed=seed, homes=part[learn])
    probes = min(probes or enough_probes(router, x, graph, recall), parts)

    def place(n: int | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v = matrix(b.column("raw"))
                p = router.home(v)[:, None] if n is None else router.routes(v, n)
                row = pa.array(np.repeat(np.arange(b.num_rows), p.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(p.reshape(-1).astype(np.int32)), *b.take(row).columns], ["part", "id", "raw"])

        return run

    schema = "part int, id long, raw binary"
    index = stage_table(raw.mapInArrow(place(None), schema))
    queries = raw.filter(F.col("id") % every == 0).dropDuplicates(["id"]).mapInArrow(place(probes), schema)
    counts = {r["part"]: r["n"] for r in index.groupBy("part").agg(F.count("*").alias("n")).collect()}  # parts rows at most
    blocks = F.create_map(*[v for p, n in counts.items() for v in (F.lit(p), F.lit(-(-n // block)))])
    queries = stage_table(queries)
    asks = {r["part"]: r["n"] for r in queries.groupBy("part").agg(F.count("*").alias("n")).collect()}  # parts rows at most
    if not asks:
        return raw.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    turns = F.create_map(*[v for p, n in asks.items() for v in (F.lit(p), F.lit(-(-n // block)))])
    own = lambda of, seed_: F.pmod(F.xxhash64(F.lit(seed_), "id"), of[F.col("part")]).cast("int")
    every_one = lambda of: F.explode(F.sequence(F.lit(0), of[F.col("part")] - 1))
    # each block of rows meets each block of queries of its partition once
    index = index.filter(turns[F.col("part")].isNotNull()).withColumn("slot", own(blocks, 1)).withColumn("turn", every_one(turns))
    queries = queries.filter(blocks[F.col("part")].isNotNull()).withColumn("turn", own(turns, 2)).withColumn("slot", every_one(blocks))

    def answer(query: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        return _best(query, rows, k) if len(query) and len(rows) else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    found = queries.groupBy("part", "slot", "turn").cogroup(index.groupBy("part", "slot", "turn")).applyInPandas(answer, "query_id long, vec_id long, score double")
    tops = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("top"))  # k rows a block and probe
    return tops.select("query_id", F.posexplode("top").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))
