"""Snapshots of tables with a manifest that must hold when they are read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Mismatch(RuntimeError):
    """A snapshot that is not what its manifest says."""


def digest(df: DataFrame) -> DataFrame:
    """One row: n and digest of a table's content, whatever the order of its rows and files.

    A row's columns, by name and with nulls told apart from texts, are hashed by md5; the hashes' halves are added up, so
    equal rows count as often as they occur, and the sums combine map-side.
    """
    cells = [F.concat(F.when(F.col(f"`{c}`").isNull(), "-").otherwise("+"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in sorted(df.columns)]
    h = F.md5(F.concat_ws("|", *cells))
    part = lambda at: F.sum(F.conv(F.substring(h, at, 12), 16, 10).cast("decimal(38,0)"))
    rows = df.agg(F.count("*").alias("n"), F.coalesce(part(1), F.lit(0)).alias("a"), F.coalesce(part(13), F.lit(0)).alias("b"))
    return rows.select("n", F.md5(F.concat_ws("|", F.col("n").cast("string"), F.col("a").cast("string"), F.col("b").cast("string"))).alias("digest"))


def write_snapshot(frames: dict[str, DataFrame], path: str, bucket: str | None = None, files: int = 8) -> DataFrame:
    """Write tables under ``path`` and, last, their manifest (table, n, digest): a snapshot without one was never finished.

    Tables with the column ``bucket`` are laid out by it in ``files`` files, each sorted, so that reads of one key skip the rest.
    """
    rows = []
    for name, df in sorted(frames.items()):
        laid = df.repartition(files, bucket).sortWithinPartitions(bucket) if bucket in df.columns else df
        laid.write.parquet(f"{path}/{name}")
        rows.append((name, *digest(df.sparkSession.read.parquet(f"{path}/{name}")).first()))
    spark = next(iter(frames.values())).sparkSession
    manifest = spark.createDataFrame(rows, "table string, n long, digest string")
    manifest.coalesce(1).write.parquet(f"{path}/_manifest_rows")
    return manifest


def load_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a snapshot, each checked against the manifest first; one changed value refuses the load."""
    out = {}
    for r in spark.read.parquet(f"{path}/_manifest_rows").collect():  # one row a table
        df = spark.read.parquet(f"{path}/{r['table']}")
        n, h = digest(df).first()
        if (n, h) != (r["n"], r["digest"]):
            raise Mismatch(f"table {r['table']} of {path} holds {n} rows with digest {h}, its manifest {r['n']} with {r['digest']}")
        out[r["table"]] = df
    return out
