"""Helpers for operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """True for vectors that are not null, hold no null, NaN or infinity and are not zero."""
    v = vector.cast("array<double>")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def with_bytes(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, raw): usable vectors as the bytes of their doubles; equal vectors have equal bytes (-0 becomes 0)."""

    def run(batches):
        for b in batches:
            col = b.column(1)
            flat = np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64) + 0.0
            ends = 8 * (np.asarray(col.offsets, np.int64) - col.offsets[0].as_py())
            raw = pa.Array.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat))])
            yield pa.RecordBatch.from_arrays([b.column(0), raw.cast(pa.binary())], ["id", "raw"])

    good = rows.filter(usable(F.col(vector))).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return good.mapInArrow(run, "id long, raw binary")


def lengths_of(raw: DataFrame) -> list[int]:
    """The numbers of components that occur, one as a rule; vectors of different lengths have no cosine and are apart."""
    return sorted(r["n"] for r in raw.select((F.octet_length("raw") / 8).cast("int").alias("n")).distinct().collect())


def of_length(raw: DataFrame, n: int) -> DataFrame:
    return raw.filter(F.octet_length("raw") == 8 * n)


def matrix(raw) -> np.ndarray:
    """Rows of doubles from a column or list of equally long byte strings."""
    parts = raw.to_pylist() if hasattr(raw, "to_pylist") else list(raw)
    return np.frombuffer(b"".join(parts), np.float64).reshape(len(parts), -1) if parts else np.zeros((0, 1))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component near 1: squares then neither overflow nor vanish, and
    cosines stay as they are to the last bit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True, initial=0))[1])


def unit(x: np.ndarray) -> np.ndarray:
    y = scaled(x)
    return y / np.linalg.norm(y, axis=1, keepdims=True)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with the row of b, in double precision."""
    a, b = scaled(a), scaled(b)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def centres(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's algorithm from evenly spaced rows of a sample."""
    k = min(k, len(sample))
    c = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy() if k else sample
    for _ in range(rounds if k else 0):
        near = (-2 * sample @ c.T + (c * c).sum(axis=1)).argmin(axis=1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c
