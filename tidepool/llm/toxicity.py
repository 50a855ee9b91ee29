"""Toxicity by a linear-chain conditional random field over words."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm._common import held_out, lean_workers
from tidepool.llm.simhash import simhash

#: Feature slots of the model; a bound on what goes to the executors (8 bytes each).
SLOTS = 1 << 16
_EDGES = re.compile(r"^\W+|\W+$")

#: Tokens whose weights a worker keeps (about 35 MB).
_CACHE = 200_000

#: Documents whose texts and spans are held at a time.
_ROWS = 1024
_BLOCK = 128


def features(token: str) -> list[int]:
    """Slots of a lower-cased token: the bare word, its first 4 and 6 letters, its last 4, its shape."""
    word = _EDGES.sub("", token)
    if not word:
        return [0]
    shape = "d" if word[0].isdigit() else "w" if word.isalpha() else "m"
    return [zlib.crc32(f.encode()) % (SLOTS - 1) + 1 for f in (f"w:{word}", f"p4:{word[:4]}", f"p6:{word[:6]}", f"s4:{word[-4:]}", f"c:{shape}")]


@dataclass
class Crf:
    """Two labels, 0 clean and 1 toxic. emit: what a slot adds to label 1; chain[i, j]: i to j; start; doc: weights of the document score."""

    emit: np.ndarray
    chain: np.ndarray
    start: np.ndarray
    doc: np.ndarray

    def __post_init__(self) -> None:
        #: weights of tokens, the latest and those before; what is still met moves on, the rest goes
        self._seen: dict[str, float] = {}
        self._older: dict[str, float] = {}

    def emission(self, token: str) -> float:
        got = self._seen.get(token)
        if got is None:
            got = self._older.get(token)
            if got is None:
                got = float(sum(map(self._weights.__getitem__, features(token))))
            if len(self._seen) >= _CACHE // 2:
                self._older, self._seen = self._seen, {}
            if len(token) <= 40:
                self._seen[token] = got
        return got

    @cached_property
    def _weights(self) -> list[float]:
        return self.emit.tolist()

    def marginals(self, docs: list[list[str]]) -> np.ndarray:
        """P(toxic) of each token of all documents in one forward-backward pass; see :func:`forward_backward`."""
        slow = self.emission
        e = np.array([x if (x := self._seen.get(t)) is not None else slow(t) for d in docs for t in d])
        first = np.zeros(len(e), bool)
        at = np.cumsum([0, *map(len, docs)])[:-1]
        first[at[at < len(e)]] = True
        return forward_backward(e, first, self.chain, self.start)

    def doc_scores(self, marginal: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Document scores in [0, 1] from the expected number of toxic tokens, their share and the largest marginal."""
        return 1 / (1 + np.exp(-np.clip(doc_features(marginal, lengths) @ self.doc, -30, 30)))


def forward_backward(e: np.ndarray, first: np.ndarray, chain: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Marginals P(label 1) of many chains laid end to end, ``first`` marking where one begins.

    A chain's first token forgets what came before it, so one pass serves all chains: blocks of tokens are multiplied out
    side by side, the blocks' messages are passed on one by one, then every block is filled in.
    """
    n = len(e)
    if not n:
        return np.zeros(0)
    s = -(-n // _BLOCK)
    x = np.exp(np.clip(np.pad(e, (0, s * _BLOCK - n)), -30, 30)).reshape(s, _BLOCK)
    reset = np.pad(first, (0, s * _BLOCK - n), constant_values=True).reshape(s, _BLOCK)
    a, b = np.exp(chain), np.exp(start)

    def step(k: int) -> tuple[np.ndarray, ...]:
        r = reset[:, k]
        return np.where(r, b[0], a[0, 0]), np.where(r, b[1], a[0, 1]) * x[:, k], np.where(r, b[0], a[1, 0]), np.where(r, b[1], a[1, 1]) * x[:, k]

    p = [np.ones(s), np.zeros(s), np.zeros(s), np.ones(s)]
    for k in range(_BLOCK):
        m = step(k)
        q = [p[0] * m[0] + p[1] * m[2], p[0] * m[1] + p[1] * m[3], p[2] * m[0] + p[3] * m[2], p[2] * m[1] + p[3] * m[3]]
        top = np.maximum(np.maximum(q[0], q[1]), np.maximum(q[2], q[3]))
        p = [v / top for v in q]
    ahead, behind = np.empty((s, 2)), np.empty((s, 2))
    u = v = 0.5
    rows = list(zip(*(c.tolist() for c in p)))
    for i, (p0, p1, p2, p3) in enumerate(rows):
        ahead[i] = u, v
        u, v = u * p0 + v * p2, u * p1 + v * p3
        u, v = u / (u + v), v / (u + v)
    u = v = 0.5
    for i in range(s - 1, -1, -1):
        behind[i] = u, v
        p0, p1, p2, p3 = rows[i]
        u, v = p0 * u + p1 * v, p2 * u + p3 * v
        u, v = u / (u + v), v / (u + v)
    alpha = np.empty((_BLOCK, 2, s))
    u, v = ahead[:, 0], ahead[:, 1]
    for k in range(_BLOCK):
        m = step(k)
        u, v = u * m[0] + v * m[2], u * m[1] + v * m[3]
        total = u + v
        u, v = u / total, v / total
        alpha[k] = u, v
    out = np.empty((_BLOCK, s))
    u, v = behind[:, 0], behind[:, 1]
    for k in range(_BLOCK - 1, -1, -1):
        one = alpha[k, 1] * v
        out[k] = one / (alpha[k, 0] * u + one)
        m = step(k)
        u, v = m[0] * u + m[1] * v, m[2] * u + m[3] * v
        total = u + v
        u, v = u / total, v / total
    return out.T.reshape(-1)[:n]


def doc_features(marginal: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per document: 1, log(1 + expected toxic tokens), their share, the largest marginal; zeros for an empty one."""
    ends = np.cumsum(lengths)
    total = np.concatenate([[0.0], np.cumsum(marginal)])
    hits = total[ends] - total[ends - lengths]
    top = np.zeros(len(lengths))
    some = lengths > 0
    if some.any():
        top[some] = np.maximum.reduceat(marginal, (ends - lengths)[some])
    return np.stack([np.ones(len(lengths)), np.log1p(hits), hits / np.maximum(lengths, 1), top], axis=1)


def label_tokens(texts: list[list[str]], toxic: list[bool], least_docs: int = 3, odds: float = 3.0) -> list[np.ndarray]:
    """Token labels from document labels: in a toxic document, tokens whose word or word start is far likelier in toxic ones.

    The chance counts documents, with half a document added to each side; least_docs toxic documents must hold it.
    """
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    slots: dict[str, list[int]] = {}
    for words, bad in zip(texts, toxic):
        counts[bad].update({f for w in set(words) for f in slots.setdefault(w, features(w)[:3])})
    n = [max(1, toxic.count(False)), max(1, toxic.count(True))]

    def far(f: int) -> bool:
        t, c = counts[True][f], counts[False][f]
        return t >= least_docs and math.log((t + 0.5) / n[1]) - math.log((c + 0.5) / n[0]) > odds

    mark = {w: any(map(far, fs)) for w, fs in slots.items()}
    return [np.array([bad and mark[w] for w in words], bool) for words, bad in zip(texts, toxic)]


def _sequences(texts: list[list[str]], labels: list[np.ndarray], length: int, most: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """Stretches of ``length`` tokens: those that hold a toxic token and as many others, ``most`` in all; slots, labels, mask."""
    at = [(i, j) for i, w in enumerate(texts) for j in range(0, len(w), length)]
    hot = [bool(labels[i][j:j + length].any()) for i, j in at]
    rng.shuffle(order := np.arange(len(at)))
    chosen = [k for k in order if hot[k]][:most // 2] + [k for k in order if not hot[k]][:most // 2]
    x, y, m = np.zeros((len(chosen), length, 5), np.int64), np.zeros((len(chosen), length), bool), np.zeros((len(chosen), length), bool)
    for r, k in enumerate(chosen):
        i, j = at[k]
        for c, w in enumerate(texts[i][j:j + length]):
            fs = features(w)
            x[r, c, :len(fs)], m[r, c] = fs, True
        y[r, :min(length, len(texts[i]) - j)] = labels[i][j:j + length]
    return x, y, m


def fit_chain(x: np.ndarray, y: np.ndarray, m: np.ndarray, rounds: int = 60, rate: float = 0.3, decay: float = 1e-4) -> tuple[np.ndarray, ...]:
    """Maximise the conditional log-likelihood of the label sequences by AdaGrad on its exact gradient."""
    n, length = y.shape
    emit, chain, start = np.zeros(SLOTS), np.zeros((2, 2)), np.zeros(2)
    sums = [np.full_like(v, 1e-8) for v in (emit, chain, start)]
    for _ in range(rounds if n else 0):
        e = emit[x].sum(axis=2)
        a, b = np.exp(chain), np.exp(start)
        node = np.stack([np.ones_like(e), np.exp(np.clip(e, -30, 30))], axis=2)
        alpha, beta = np.empty((length, n, 2)), np.empty((length, n, 2))
        f = b * node[:, 0]
        for k in range(length):
            f = f if k == 0 else np.where(m[:, k, None], (f @ a) * node[:, k], f)
            f = f / f.sum(axis=1, keepdims=True)
            alpha[k] = f
        g = np.full((n, 2), 0.5)
        for k in range(length - 1, -1, -1):
            beta[k] = g
            if k:
                g = np.where(m[:, k, None], (g * node[:, k]) @ a.T, g)
                g = g / g.sum(axis=1, keepdims=True)
        mass = alpha * beta
        prob = (mass[:, :, 1] / mass.sum(axis=2)).T
        diff = np.where(m, y - prob, 0.0)
        ge = np.bincount(x.reshape(-1), np.repeat(diff.reshape(-1), x.shape[2]), SLOTS)
        ge[0] = 0.0
        gc = np.zeros((2, 2))
        for k in range(1, length):
            pair = alpha[k - 1][:, :, None] * a[None] * (node[:, k] * beta[k])[:, None, :]
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            on = m[:, k]
            gc -= pair[on].sum(axis=0)
            np.add.at(gc, (y[on, k - 1].astype(int), y[on, k].astype(int)), 1)
        gs = np.array([(~y[:, 0]).sum() - (1 - prob[:, 0]).sum(), y[:, 0].sum() - prob[:, 0].sum()])
        for v, s, grad in zip((emit, chain, start), sums, (ge / n - decay * emit, gc / n, gs / n)):
            s += grad**2
            v += rate * grad / np.sqrt(s)
    return emit, chain, start


def _fit_scores(f: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Weighted logistic regression with a light ridge, by Newton steps."""
    v = np.zeros(f.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(f @ v, -30, 30)))
        h = (f * (w * p * (1 - p))[:, None]).T @ f + 1e-3 * np.eye(len(v))
        v = v + np.linalg.solve(h, f.T @ (w * (y - p)) - 1e-3 * v)
    return v


def _different(rows: list, near: int = 10) -> list:
    """Rows whose text is not a near copy of an earlier row's: copies of one document must not vouch for its words."""
    prints = np.array([int.from_bytes(simhash(r["text"])) for r in rows], np.uint64)
    kept: list[int] = []
    for i in range(len(rows)):
        if not kept or np.bitwise_count(prints[kept] ^ prints[i]).min() > near:
            kept.append(i)
    return [rows[i] for i in kept]


def _fetch(rows: DataFrame, most_bytes: int) -> dict[int, str]:
    """Texts by id for the driver, ``most_bytes`` of UTF-8 together: lengths first, then the texts that fit."""
    sizes = {r["id"]: r["n"] for r in rows.groupBy("id").agg(F.max(F.octet_length("text")).alias("n")).collect()}
    order = sorted(sizes, key=lambda i: (zlib.crc32(str(i).encode()), i))
    ends = np.cumsum([sizes[i] for i in order])
    fit = order[:max(1, int(np.searchsorted(ends, most_bytes, "right")))]
    fetched = rows.filter(F.col("id").isin(fit)) if len(fit) < len(order) else rows
    return {r["id"]: r["text"] for r in fetched.groupBy("id").agg(F.min("text").alias("text")).collect()}


def train_toxicity(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
                   most_docs: int = 2400, most_stretches: int = 6000, most_bytes: int = 64 << 20, seed: int = 11) -> Crf:
    """Fit the field and the document score on at most ``most_docs`` labelled documents, a third of them toxic.

    The sample is further bounded by ``most_bytes`` of text, whole documents in the order of a hash of their id (the first is
    always in), and the field is fitted on at most ``most_stretches`` stretches of 40 tokens of the sample.

    Rows of the held-out fold are never read. The sample takes the documents with the smallest hash of their id; the
    documents' own share of toxic labels then weighs the classes. Ids are sampled first, so no text is shuffled but theirs.
    A null label or id is left out, the larger of two labels and the smaller of two texts of an id counts. Without documents of both classes the model scores every document by the share of toxic labels.
    """
    marks = (labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
             .groupBy(F.col(doc_id).cast("long").alias("id")).agg(F.max(F.col(label).cast("int")).alias("y")))
    share = marks.agg(F.avg("y"), F.count("y")).first()
    order = F.xxhash64(F.lit(seed), "id")
    chosen = {r["id"]: r["y"] for y, n in ((1, most_docs // 3), (0, most_docs - most_docs // 3)) for r in marks.filter(F.col("y") == y).orderBy(order, "id").limit(n).collect()}
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).filter("text is not null").filter(F.col("id").isin(list(chosen)))
    texts_of = _fetch(rows, most_bytes) if chosen else {}
    picked = [{"id": i, "y": y, "text": texts_of[i]} for i, y in chosen.items() if i in texts_of]
    rate = float(share[0] or 0.0)
    bias = math.log((rate * share[1] + 0.5) / ((1 - rate) * share[1] + 0.5))
    if len({r["y"] for r in picked}) < 2:
        return Crf(np.zeros(SLOTS), np.zeros((2, 2)), np.zeros(2), np.array([bias, 0, 0, 0]))
    rows = _different(sorted(picked, key=lambda r: (zlib.crc32(str(r["id"]).encode()), r["id"])))
    texts, toxic = [r["text"].lower().split() for r in rows], [r["y"] == 1 for r in rows]
    marked = label_tokens(texts, toxic)
    x, y, m = _sequences(texts, marked, 40, most_stretches, np.random.default_rng(seed))
    model = Crf(*fit_chain(x, y, m), np.zeros(4))
    lengths = np.array([len(t) for t in texts])
    target = np.array(toxic, float)
    weight = np.where(target == 1, rate / max(target.mean(), 1e-9), (1 - rate) / max(1 - target.mean(), 1e-9))
    model.doc = _fit_scores(doc_features(model.marginals(texts), lengths), target, weight)
    return model


def _score(model: Crf, texts: list[str | None], most_tokens: int = 1 << 16) -> Iterator[tuple[list[str | None], list[list[str]], np.ndarray, np.ndarray]]:
    """Groups of texts of about ``most_tokens`` tokens: texts, tokens, marginals, scores."""
    group: list[str | None] = []
    words: list[list[str]] = []
    n = 0
    for t in [*texts, ...]:
        if group and (t is ... or n >= most_tokens):
            marginal = model.marginals(words)
            yield group, words, marginal, model.doc_scores(marginal, np.array([len(w) for w in words]))
            group, words, n = [], [], 0
        if t is not ...:
            group.append(t)
            words.append((t or "").lower().split())
            n += len(words[-1])


def _spans(text: str | None, marginal: np.ndarray) -> list[dict]:
    """Runs of tokens that are likelier toxic than not, as code-point offsets."""
    hot = np.flatnonzero(marginal >= 0.5).tolist()
    if not hot:
        return []
    tokens = [m.span() for m in re.finditer(r"\S+", text or "")]
    runs: list[list[int]] = []
    for i in hot:
        if runs and i == runs[-1][1] + 1:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    return [{"begin": tokens[a][0], "end": tokens[b][1]} for a, b in runs]


def score_toxicity(docs: DataFrame, model: Crf, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, score, predicted and spans, the offending offsets (begin, end) in code points.

    Whole texts are tagged; null, blank and empty texts have no tokens and get the score of a document without any toxic
    token. Repeated rows are scored alike; an empty table gives no rows. Nothing is shuffled.
    """

    lean_workers(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, _ROWS) for whole in batches for at in range(0, whole.num_rows, _ROWS)):
            scores, spans = [], []
            for group, words, marginal, score in _score(model, b.column(1).to_pylist()):
                ends = np.cumsum([len(w) for w in words])
                spans += [_spans(t, marginal[e - len(w):e]) for t, w, e in zip(group, words, ends)]
                scores.append(score)
            score = np.concatenate(scores) if scores else np.zeros(0)
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(spans, kind)], ["doc_id", "score", "predicted", "spans"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double, predicted int, spans array<struct<begin:long,end:long>>")


def drop_toxic(docs: DataFrame, model: Crf, *, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without the documents that score ``threshold`` or more; columns stay, nothing is shuffled."""
    place = docs.columns.index(text)
    lean_workers(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, _ROWS) for whole in batches for at in range(0, whole.num_rows, _ROWS)):
            scores = [s for *_, s in _score(model, b.column(place).to_pylist())]
            yield b.filter(pa.array(np.concatenate(scores) < threshold)) if scores else b

    return docs.mapInArrow(run, docs.schema)
