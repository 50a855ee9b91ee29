"""Embedding near-dedup by a subspace pigeonhole join."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm._common import stage_table
from tidepool.llm.components import connected_components, named_components
from tidepool.llm.simhash import forest
from tidepool.llm.vectors import centres, cosines, lengths_of, matrix, of_length, unit, usable, with_bytes

#: Slack on squared distances, far above the rounding of the single-precision screen.
_SLACK = 1e-4


class Subspaces:
    """A rotation, its blocks of dimensions, and cells in each block.

    Unit vectors with cosine >= c are at squared distance 2 - 2c or less, so in one of the blocks they are within that
    budget times the block's share of the dimensions. Within radius r, a vector of another cell lies no farther than r
    from the border between the cells, so a vector has to visit only the cells whose border is that near.
    """

    def __init__(self, sample: np.ndarray, cosine: float, blocks: int, cells: int, seed: int) -> None:
        dim = sample.shape[1]
        blocks = min(blocks, dim)
        self.rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))[0]
        edges = np.linspace(0, dim, blocks + 1).astype(int)
        self.parts = [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]
        self.budget = np.array([(2 - 2 * cosine) * (p.stop - p.start) / dim for p in self.parts])
        turned = unit(sample) @ self.rotation
        self.cells = [centres(turned[:, p], cells) for p in self.parts]

    def turn(self, x: np.ndarray) -> np.ndarray:
        return unit(x) @ self.rotation

    def visits(self, turned: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Home cell of each row, and whether it visits each cell: its own and those of higher number near enough."""
        y, c = turned[:, self.parts[block]], self.cells[block]
        d = ((y[:, None, :] - c[None]) ** 2).sum(axis=2)
        home = d.argmin(axis=1)
        apart = np.sqrt(((c[home][:, None, :] - c[None]) ** 2).sum(axis=2))
        border = (d - d[np.arange(len(y)), home][:, None]) / np.maximum(2 * apart, 1e-12)
        go = (border <= np.sqrt(self.budget[block]) + _SLACK) & (np.arange(len(c))[None] >= home[:, None])
        go[np.arange(len(y)), home] = True
        return home, go

    def first_block(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The first block in which turned rows a and b are within budget; each pair is counted there and nowhere else."""
        d = np.stack([((a[:, p] - b[:, p]) ** 2).sum(axis=1) for p in self.parts], axis=1)
        return (d <= self.budget + _SLACK / 2).argmax(axis=1)


def _cell_links(space: Subspaces, block: int, own: pd.DataFrame, other: pd.DataFrame, same: np.ndarray, cosine: float, slab: int = 1 << 22) -> pd.DataFrame:
    """Links between a cell's residents and its visitors as (a, b, n): a row (a, a, n) adds n links to a, others are forest edges.

    same: visitors that live here too, which meet only residents with a larger id.
    """
    x, y = matrix(own["raw"]), matrix(other["raw"])
    tx, ty = space.turn(x), space.turn(y)
    p = space.parts[block]
    bx, by = tx[:, p].astype(np.float32), ty[:, p].astype(np.float32)
    nx, ny = (bx * bx).sum(axis=1), (by * by).sum(axis=1)
    own_id, other_id = own["id"].to_numpy(), other["id"].to_numpy()
    add_x, add_y = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    size_x, size_y = own["size"].to_numpy(), other["size"].to_numpy()
    kept: list[tuple[int, int]] = []
    limit, step = np.float32(space.budget[block] + _SLACK), max(1, slab // max(len(x), 1))
    for at in range(0, len(y), step):
        d = ny[at:at + step, None] + nx[None] - 2 * (by[at:at + step] @ bx.T)
        hit = np.flatnonzero(d <= limit)
        j, i = hit // len(x) + at, hit % len(x)
        ok = ~same[j] | (own_id[i] > other_id[j])
        i, j = i[ok], j[ok]
        for k in range(0, len(i), 1 << 16):
            u, v = i[k:k + (1 << 16)], j[k:k + (1 << 16)]
            on = (space.first_block(tx[u], ty[v]) == block) & (cosines(x[u], y[v]) >= cosine)
            u, v = u[on], v[on]
            np.add.at(add_x, u, size_y[v])
            np.add.at(add_y, v, size_x[u])
            kept += zip(u.tolist(), (v + len(x)).tolist())
        if len(kept) > 4 * (len(x) + len(y)):
            kept = forest(*np.array(kept).T, len(x) + len(y))
    edges = forest(*np.array(kept).T, len(x) + len(y)) if kept else []
    ids = np.concatenate([own_id, other_id])
    a, b = (ids[[e[s] for e in edges]] for s in (0, 1)) if edges else (ids[:0], ids[:0])
    hx, hy = add_x > 0, add_y > 0
    n = np.concatenate([np.zeros(len(a), np.int64), add_x[hx], add_y[hy]])
    return pd.DataFrame({"a": np.concatenate([a, own_id[hx], other_id[hy]]), "b": np.concatenate([b, own_id[hx], other_id[hy]]), "n": n})


def embedding_links(reps: DataFrame, space: Subspaces, cosine: float, residents: int = 8192, visitors: int = 32768) -> DataFrame:
    """reps: id, raw, size (distinct vectors); returns (a, b, n) as :func:`_cell_links` does, for all pairs of reps.

    Residents and visitors of a cell are cut into blocks of bounded size, so no cell is gathered whole.
    """

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            turned = space.turn(matrix(b.column("raw")))
            for block in range(len(space.parts)):
                home, go = space.visits(turned, block)
                row, cell = np.nonzero(go)
                took = b.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), block, np.int32)), pa.array(cell.astype(np.int32)), pa.array(home[row] == cell), *took.columns],
                                                 ["block", "cell", "lives", "id", "raw", "size"])

    calls = stage_table(reps.select("id", "raw", "size").mapInArrow(assign, "block int, cell int, lives boolean, id long, raw binary, size long"))
    counts = calls.groupBy("block", "cell").agg(F.sum(F.col("lives").cast("int")).alias("n"), F.count("*").alias("m")).collect()  # blocks x cells rows at most
    need = {(r["block"], r["cell"]): (-(-r["n"] // residents), -(-r["m"] // visitors)) for r in counts}
    table = F.create_map(*[x for (b, c), (n, m) in need.items() for x in (F.lit(f"{b},{c}"), F.struct(F.lit(int(n)).alias("n"), F.lit(int(m)).alias("m")))]) if need else None
    if table is None:
        return reps.sparkSession.createDataFrame([], "a long, b long, n long")
    at = table[F.concat_ws(",", "block", "cell")]
    rows = calls.withColumns({"nb": at["n"], "mb": at["m"]}).filter("nb > 0")
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    home = rows.filter("lives").select("block", "cell", part("nb").alias("i"), every("mb").alias("j"), F.lit(0).alias("role"), "lives", "id", "raw", "size")
    call = rows.select("block", "cell", every("nb").alias("i"), part("mb").alias("j"), F.lit(1).alias("role"), "lives", "id", "raw", "size")

    def meet(key, pdf):
        own, other = pdf[pdf["role"] == 0], pdf[pdf["role"] == 1]
        return _cell_links(space, int(key[0]), own, other, other["lives"].to_numpy(), cosine)

    return home.union(call).groupBy("block", "cell", "i", "j").applyInPandas(meet, "a long, b long, n long")


def embedding_components(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", cosine: float = 0.9, blocks: int = 4,
                         cells: int = 8, sample: int = 4096, seed: int = 5) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors at this cosine or more), component_id and kept (its own component).

    All rows are compared, whatever their other columns; the cosine that decides is computed in double precision from the
    vectors as given. Equal vectors are one class and never meet each other in a join. Vectors that are null, zero or hold
    a null or non-finite component link with nothing. The cells are fitted on ``sample`` vectors at most and only steer
    where pairs meet, never whether. Classes are numbered by themselves, so vectors without an id link and join components like
    any other; their component is null where it holds no id. Repeated rows count as vectors; vectors of different lengths link
    with nothing but their own; an empty table gives no rows.
    """
    ids = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), usable(F.col(vector)).alias("ok"))
    raw = stage_table(with_bytes(vectors, vec_id, vector))
    reps = stage_table(raw.groupBy("raw").agg(F.min("id").alias("least"), F.count("*").alias("size")).withColumn("id", F.monotonically_increasing_id()))
    found = []
    for n in lengths_of(reps):
        own = of_length(reps, n)
        some = [bytes(r["raw"]) for r in own.orderBy(F.xxhash64("raw"), "raw").select("raw").limit(sample).collect()]
        found.append(embedding_links(own, Subspaces(matrix(some), cosine, blocks, cells, seed), cosine))
    if not found:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links = stage_table(reduce(DataFrame.union, found))
    near = links.filter("n > 0").groupBy(F.col("a").alias("n_id")).agg(F.sum("n").alias("near"))
    parts = connected_components(links.filter("n = 0").select("a", "b"))
    classes = (named_components(reps, parts, "id", "least").join(near, F.col("id") == F.col("n_id"), "left")
               .select(F.col("raw").alias("c_raw"), (F.coalesce("near", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id"))
    placed = raw.join(classes, F.col("raw") == F.col("c_raw")).select(F.col("id").alias("vec_id"), "n_links", "component_id")
    lone = ids.filter(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return placed.union(lone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
