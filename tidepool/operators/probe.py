"""A linear probe on embeddings: ridge paths chosen on purged folds, all from one distributed pass over the rows.

A pass gathers the moments of the features (their count, sums and products) for each stretch of dates between the edges of the
folds. Training rows of any fold, outer or inner, are a prefix of stretches, so their standardised Gram matrix, the whole ridge
path and its squared error on the inner test stretches follow from the moments without another look at the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ALPHAS = tuple(10.0**k for k in (0, 2, 3, 4, 5, 6, 7, 8, 9, 10))

#: Features that a probe may have: moments hold the square of their number.
MOST_FEATURES = 2048


def context_scalars(bars: DataFrame, value: str, context: int) -> DataFrame:
    """ticker, date, ctx_std (population deviation of the steps) and ctx_last of the last ``context`` values up to each date: the scale that an embedding has lost."""
    w = Window.partitionBy("ticker").orderBy("date")
    steps = bars.withColumn("_d", F.col(value) - F.lag(value).over(w))
    return steps.select("ticker", "date", F.coalesce(F.stddev_pop("_d").over(w.rowsBetween(2 - context, 0)), F.lit(0.0)).alias("ctx_std"), F.col(value).alias("ctx_last"))


def purged_folds(dates: int, n_folds: int, min_train: int, horizon: int, embargo: int) -> list[tuple[int, int, int]]:
    """(train_end, test_start, test_end) in positions, as :func:`tidepool.operators.folds.fold_table` cuts them."""
    step = (dates - min_train) // n_folds if dates > min_train else 0
    cut = [(min_train + f * step - horizon - embargo, min_train + f * step, min_train + (f + 1) * step) for f in range(n_folds)] if step > 0 else []
    return [c for c in cut if c[0] >= min_train // 2]


@dataclass(frozen=True)
class Moments:
    """Sums over rows of products of (1, features, outcome): a square matrix whose first entry is the number of rows."""

    m: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.m + other.m)

    @property
    def n(self) -> float:
        return float(self.m[0, 0])

    def scale(self) -> tuple[np.ndarray, np.ndarray]:
        """Mean and population deviation of the features; those that do not vary keep deviation 1."""
        mean = self.m[0, 1:-1] / self.n
        var = np.diag(self.m)[1:-1] / self.n - mean**2
        return mean, np.where(var > 1e-16, np.sqrt(np.maximum(var, 0)), 1.0)

    def centred(self, mean: np.ndarray, sd: np.ndarray, y: float) -> np.ndarray:
        """The same sums for standardised features and an outcome less ``y``."""
        k = len(mean)
        t = np.eye(k + 2)
        t[0, 1:-1], t[0, -1] = -mean / sd, -y
        t[range(1, k + 1), range(1, k + 1)] = 1 / sd
        return t.T @ self.m @ t


def moments(rows: DataFrame, edges: list[int], k: int, *, pos: str = "pos", x: str = "x", y: str = "y") -> list[Moments]:
    """Moments of the rows between each two of the sorted ``edges`` (positions of dates), gathered in one pass.

    A task keeps one matrix a stretch and multiplies blocks of rows into it; its matrices are summed by entry across tasks. The
    driver gets stretches x (k + 2)^2 / 2 numbers, whatever the number of rows. Rows without features or outcome go.
    """
    if k > MOST_FEATURES:
        raise ValueError(f"{k} features are more than {MOST_FEATURES}")
    cut = np.array(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(edges) - 1, k + 2, k + 2))
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                z = np.column_stack([np.ones(part.num_rows), part.column(1).flatten().to_numpy().reshape(part.num_rows, k), part.column(2).to_numpy()])
                stretch = np.searchsorted(cut, part.column(0).to_numpy(), "right") - 1
                for s in np.unique(stretch[(stretch >= 0) & (stretch < len(sums))]):
                    own = z[stretch == s]
                    sums[s] += own.T @ own
        i, j = np.triu_indices(k + 2)
        for s in np.flatnonzero(sums[:, 0, 0]):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), s, np.int32)), pa.array(np.arange(len(i), dtype=np.int32)), pa.array(sums[s][i, j])], ["s", "e", "v"])

    finite = lambda c: ~F.isnan(c) & (F.abs(c) != float("inf"))
    ok = (F.size(x) == k) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.col(y).isNotNull() & finite(F.col(y))
    some = rows.filter(ok & F.col(pos).isNotNull()).select(F.col(pos).cast("int"), F.col(x).cast("array<double>"), F.col(y).cast("double"))
    out = np.zeros((len(edges) - 1, k + 2, k + 2))
    i, j = np.triu_indices(k + 2)
    for r in some.mapInArrow(run, "s int, e int, v double").groupBy("s", "e").agg(F.sum("v").alias("v")).toLocalIterator():
        out[r["s"], i[r["e"]], j[r["e"]]] = out[r["s"], j[r["e"]], i[r["e"]]] = r["v"]
    return [Moments(m) for m in out]


def ridge_path(train: Moments, alphas: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(weights, mean, sd, intercept): one row of weights on standardised features for each penalty, from one eigendecomposition."""
    mean, sd = train.scale()
    y = float(train.m[0, -1] / train.n)
    c = train.centred(mean, sd, y)
    values, vectors = np.linalg.eigh(c[1:-1, 1:-1])
    turned = vectors.T @ c[1:-1, -1]
    return np.stack([vectors @ (turned / (np.maximum(values, 0) + a)) for a in alphas]), mean, sd, y


def squared_error(test: Moments, w: np.ndarray, mean: np.ndarray, sd: np.ndarray, y: float) -> float:
    """Mean squared error of weights on the rows behind ``test``, from their moments alone."""
    c = test.centred(mean, sd, y)
    return float((c[-1, -1] - 2 * w @ c[1:-1, -1] + w @ c[1:-1, 1:-1] @ w) / test.n)


@dataclass(frozen=True)
class Fit:
    """One fold's probe: penalty, weights on raw features and intercept; no weights where it abstains."""

    fold: int
    test_start: int
    test_end: int
    rows: int
    alpha: float | None
    weights: tuple[float, ...]
    intercept: float


def fit_probe(rows: DataFrame, dates: int, k: int, *, n_folds: int = 5, min_train: int = 500, horizon: int = 30, inner_folds: int = 3, inner_min_train: int = 250,
              alphas: tuple[float, ...] = ALPHAS, least_rows: int = 100, pos: str = "pos", x: str = "x", y: str = "y") -> list[Fit]:
    """A ridge for each purged fold over ``dates`` positions, its penalty chosen on purged inner folds of the training dates.

    Standardising uses training rows only. Without an inner fold the strongest penalty is taken: where nothing can be measured,
    the one that makes no signal. A fold of fewer than ``least_rows`` rows abstains.
    """
    outer = purged_folds(dates, n_folds, min_train, horizon, horizon)
    inner = {end: purged_folds(end, inner_folds, inner_min_train, horizon, horizon) for end, _, _ in outer}
    edges = sorted({0, dates, *[e for c in outer for e in c], *[e for cuts in inner.values() for c in cuts for e in c]})
    parts = moments(rows, edges, k, pos=pos, x=x, y=y)

    def between(a: int, z: int) -> Moments:
        return sum((parts[i] for i in range(edges.index(a), edges.index(z))), Moments(np.zeros((k + 2, k + 2))))

    out = []
    for fold, (end, start, stop) in enumerate(outer):
        train = between(0, end)
        if train.n < least_rows:
            out.append(Fit(fold, start, stop, int(train.n), None, (), 0.0))
            continue
        scores = []
        for a, b, z in inner[end]:
            own, test = between(0, a), between(b, z)
            if own.n and test.n:
                weights, mean, sd, y0 = ridge_path(own, alphas)
                scores.append([squared_error(test, w, mean, sd, y0) for w in weights])
        at = int(np.argmin(np.mean(scores, axis=0))) if scores else int(np.argmax(alphas))
        weights, mean, sd, y0 = ridge_path(train, (alphas[at],))
        raw = weights[0] / sd
        out.append(Fit(fold, start, stop, int(train.n), float(alphas[at]), tuple(raw.tolist()), float(y0 - raw @ mean)))
    return out


def predict_probe(rows: DataFrame, fits: list[Fit], *, pos: str = "pos", x: str = "x") -> DataFrame:
    """Test rows of each fold with fold and y_pred; 0 where the fold abstained or the row has no features. Weights are a table of one row a fold."""
    table = rows.sparkSession.createDataFrame([(f.fold, f.test_start, f.test_end, list(f.weights), f.intercept) for f in fits], "fold int, _from int, _to int, _w array<double>, _b double")
    both = rows.join(F.broadcast(table), (F.col(pos) >= F.col("_from")) & (F.col(pos) < F.col("_to")))
    dot = F.aggregate(F.zip_with(F.col(x).cast("array<double>"), "_w", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) + F.col("_b")
    return both.withColumn("y_pred", F.coalesce(F.when(F.size("_w") > 0, dot), F.lit(0.0))).drop("_from", "_to", "_w", "_b")
