"""Token counts as delta-maintained rollups with idempotent batch commits."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pre-tokenising pattern of the byte-level vocabularies, a fixed value of their format.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

KEYS = ("source", "lang", "tokenizer_version")


@lru_cache(maxsize=4)
def _encoding(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def read_ranks(path: str) -> bytes:
    """A vocabulary file, read on the driver; it goes to the tasks with the function (about 1 MB)."""
    with open(path, "rb") as f:
        return f.read()


def count_tokens(docs: DataFrame, ranks: bytes, text: str = "text", into: str = "n_tokens") -> DataFrame:
    """``docs`` without ``text`` and with the number of tokens of each whole text; null text counts 0. Nothing is shuffled."""
    others = [c for c in docs.columns if c not in (text, into)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(ranks).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(n, pa.int64())], [*others, into])

    rows = docs.select(F.col(text).cast("string").alias(text), *others)
    schema = docs.select(*others, F.lit(0).cast("long").alias(into)).schema
    return rows.mapInArrow(run, schema)


def inserts(counts: DataFrame) -> DataFrame:
    """Signed changes that add documents; counts: source, lang, tokenizer_version, n_tokens."""
    return counts.select(*KEYS, F.lit(1).alias("sign"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    """Signed changes that take documents out again, with the counts that they went in with."""
    return inserts(counts).withColumn("sign", F.lit(-1))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Signed changes that put new counts (or keys) in the place of old ones."""
    return deletes(old).union(inserts(new))


def roll(changes: DataFrame) -> DataFrame:
    """Additive totals of signed changes by source, language and tokenizer version; keys may be null. Sums combine map-side."""
    signed: Column = F.col("sign") * F.col("n_tokens")
    return changes.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("n_docs"), F.sum(signed).cast("long").alias("n_tokens"))


@dataclass(frozen=True)
class Rollup:
    """Totals kept as one small table of deltas for each committed batch under ``root``.

    A batch is committed once: its folder is complete when the writer's success mark stands, a batch that is complete is
    not written again, and one that a lost driver left half-written is replaced. So a replay changes nothing. Totals are
    sums over complete batches; keys whose documents are all gone have none. No batches give no rows. :meth:`compact` folds
    batches into one base, so that totals read it and what came since; the names of folded batches stay known.
    """

    spark: SparkSession
    root: str

    def _path(self, batch_id: str) -> str:
        if not batch_id or any(c in batch_id for c in "/\\*?[]{}="):
            raise ValueError(f"not a batch name: {batch_id!r}")
        return f"{self.root.rstrip('/')}/batch={batch_id}"

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return bool(p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p))

    def _complete(self, kind: str, mark: str) -> list[str]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(n.removeprefix(f"{kind}=") for n in names if n.startswith(f"{kind}=") and self._exists(f"{self.root.rstrip('/')}/{n}/{mark}"))

    def batches(self) -> list[str]:
        """Complete batches that have a folder of their own."""
        return self._complete("batch", "_SUCCESS")

    def _base(self) -> tuple[str | None, set[str]]:
        """The newest complete base and the names of the batches in it."""
        done = self._complete("base", "names/_SUCCESS")
        if not done:
            return None, set()
        path = f"{self.root.rstrip('/')}/base={done[-1]}"
        return path, {r["batch_id"] for r in self.spark.read.schema("batch_id string").parquet(f"{path}/names").collect()}  # one row a batch

    def compact(self) -> int:
        """Fold all complete batches into a new base; returns how many it holds. Its names are written last, so a base that a
        lost driver left half-written is not read. Batches keep their folders, which may go once no reader of the old base is left."""
        path, known = self._base()
        names = sorted(known | set(self.batches()))
        n = int(path.rpartition("=")[2]) + 1 if path else 1
        new = f"{self.root.rstrip('/')}/base={n:09d}"
        self.totals().write.mode("overwrite").parquet(f"{new}/totals")
        self.spark.createDataFrame([(b,) for b in names], "batch_id string").coalesce(1).write.mode("overwrite").parquet(f"{new}/names")
        return len(names)

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Commit a batch of signed changes; False if it was committed before."""
        path = self._path(batch_id)
        if self._exists(f"{path}/_SUCCESS") or batch_id in self._base()[1]:
            return False
        roll(changes).write.mode("overwrite").parquet(path)
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, n_docs, n_tokens."""
        base, known = self._base()
        paths = [self._path(b) for b in self.batches() if b not in known] + ([f"{base}/totals"] if base else [])
        schema = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"
        if not paths:
            return self.spark.createDataFrame([], schema)
        parts = self.spark.read.schema(schema).parquet(*paths)
        sums = parts.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.filter("n_docs <> 0 or n_tokens <> 0")


def commit_stream(rollup: Rollup, changes: DataFrame, checkpoint: str, name: str = "tokens"):
    """Feed a stream of signed changes into the totals, one commit for each micro-batch; a replayed micro-batch is skipped."""
    return (changes.writeStream.foreachBatch(lambda df, n: rollup.commit(f"{name}-{n}", df))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def versioned(counts: DataFrame, version: str) -> DataFrame:
    return counts.withColumn("tokenizer_version", F.lit(version))
