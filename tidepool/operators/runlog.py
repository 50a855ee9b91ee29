"""A log of runs as an append-only table with one writer a version, gradings stored beside it, and dated membership lists."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_EVENT = "version long, run_id string, job string, status string, at timestamp, facts string"
_MOVES = {None: {"RUNNING"}, "RUNNING": {"OK", "FAILED", "ABORTED"}}


class Conflict(RuntimeError):
    """Another writer took the version first."""


@dataclass(frozen=True)
class RunLog:
    """Runs under ``root``, a folder that all writers share. A change of state is one small Parquet table for its version.

    A version is claimed by creating its claim file, which a file system lets only one writer do; the loser gets
    :class:`Conflict`, reads again and decides again. A claim whose table was never finished is skipped by readers. A run that
    stays RUNNING was killed: nothing closes it for it.
    """

    spark: SparkSession
    root: str

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root.rstrip("/"), *parts]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self, kind: str) -> list[int]:
        path, fs = self._path(kind)
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n) for n in names if n.isdigit())

    def latest(self) -> int:
        return max(self._numbers("claims"), default=0)

    def _claim(self, version: int) -> None:
        path, fs = self._path("claims", f"{version:012d}")
        try:
            fs.create(path, False).close()
        except Exception as e:
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                raise Conflict(f"version {version} is taken") from None
            raise

    def append(self, seen: int, run_id: str, status: str, job: str | None = None, facts: dict | None = None) -> int:
        """Write the change after version ``seen``, which the caller has read; returns its version."""
        now = self.state().filter(F.col("run_id") == run_id).first()
        if status not in _MOVES.get(now["status"] if now else None, set()):
            raise ValueError(f"run {run_id} cannot go from {now['status'] if now else 'nothing'} to {status}")
        version = seen + 1
        self._claim(version)
        row = [(version, run_id, job or (now["job"] if now else None), status, datetime.now(timezone.utc), json.dumps(facts or {}, sort_keys=True, allow_nan=False))]
        self.spark.createDataFrame(row, _EVENT).coalesce(1).write.parquet(f"{self.root.rstrip('/')}/events/{version:012d}")
        return version

    def start(self, run_id: str, job: str, facts: dict | None = None) -> int:
        return self.append(self.latest(), run_id, "RUNNING", job, facts)

    def finish(self, run_id: str, status: str, metrics: dict | None = None) -> int:
        return self.append(self.latest(), run_id, status, None, metrics)

    def events(self, upto: int | None = None) -> DataFrame:
        """All changes that were finished, in order of version, or those up to one."""
        done = [v for v in self._numbers("events") if (upto is None or v <= upto) and self._path("events", f"{v:012d}", "_SUCCESS")[1].exists(self._path("events", f"{v:012d}", "_SUCCESS")[0])]
        if not done:
            return self.spark.createDataFrame([], _EVENT)
        return self.spark.read.schema(_EVENT).parquet(*[f"{self.root.rstrip('/')}/events/{v:012d}" for v in done])

    def state(self, upto: int | None = None) -> DataFrame:
        """One row a run, as of a version: run_id, job, status, started_at, finished_at, facts, metrics."""
        return replay(self.events(upto))


def replay(events: DataFrame) -> DataFrame:
    """States from changes (version, run_id, job, status, at, facts): the first RUNNING opens a run, the first end after it closes it; what fits neither is ignored."""
    opened = events.filter("status = 'RUNNING'").groupBy("run_id").agg(F.min_by(F.struct("version", "job", "at", "facts"), "version").alias("o"))
    ends = events.filter(F.col("status").isin(*sorted(_MOVES["RUNNING"]))).join(opened.select("run_id", F.col("o.version").alias("_v")), "run_id").filter(F.col("version") > F.col("_v"))
    closed = ends.groupBy("run_id").agg(F.min_by(F.struct("status", "at", "facts"), "version").alias("c"))
    return opened.join(closed, "run_id", "left").select("run_id", "o.job", F.coalesce("c.status", F.lit("RUNNING")).alias("status"), F.col("o.at").alias("started_at"), F.col("c.at").alias("finished_at"), F.col("o.facts").alias("facts"), F.col("c.facts").alias("metrics"))


def store_grading(stored: DataFrame, graded: DataFrame, run_id: str, graded_at) -> DataFrame:
    """The store (run_id, graded_at, ticker, grade) with one more run; a run that is in it already is not written twice."""
    new = graded.select(F.lit(run_id).alias("run_id"), F.lit(graded_at).cast("timestamp").alias("graded_at"), "ticker", "grade")
    return stored.unionByName(new.join(stored.select("run_id").distinct(), "run_id", "left_anti").select(stored.columns))


def latest_grades(stored: DataFrame) -> DataFrame:
    """ticker, grade, before (the grade of its run before), run_id of each name's newest grading."""
    w = Window.partitionBy("ticker").orderBy("graded_at", "run_id")
    marked = stored.withColumns({"before": F.lag("grade").over(w), "_n": F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("graded_at"), F.desc("run_id")))})
    return marked.filter("_n = 1").select("ticker", "grade", "before", "run_id")


def merge_snapshots(intervals: DataFrame, lists: DataFrame, forever: str = "9999-12-31") -> DataFrame:
    """Membership intervals (ticker, effective_from, effective_to, both ends inside) with dated lists (day, ticker) merged in.

    A name listed on a day that no interval of its holds opens one from that day on without an end. Since it then stays open,
    of all its days the first outside the stored intervals decides; lists may come in any order and twice.
    """
    days = lists.select("ticker", "day").distinct()
    held = days.join(intervals, "ticker").filter((F.col("day") >= F.col("effective_from")) & (F.col("day") <= F.col("effective_to"))).select("ticker", "day").distinct()
    new = days.join(held, ["ticker", "day"], "left_anti").groupBy("ticker").agg(F.min("day").alias("effective_from"))
    return intervals.unionByName(new.withColumn("effective_to", F.lit(forever).cast("date")).select(intervals.columns))
