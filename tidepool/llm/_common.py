"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the ASCII white space space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"

#: Prefix of every internal column, so that extra input columns cannot clash.
P = "__tp_"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where a local session names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def lean_workers(spark: SparkSession) -> None:
    """Let Python workers that start from now on give freed memory back at once: an idle worker keeps what it was given while
    later stages run in the JVM beside it. Settings of the C library and of Arrow's allocator; those that are set stay."""
    env = spark.sparkContext.environment
    for k, v in (("MALLOC_ARENA_MAX", "2"), ("MALLOC_TRIM_THRESHOLD_", "262144"), ("MALLOC_MMAP_THRESHOLD_", "262144"), ("ARROW_DEFAULT_MEMORY_POOL", "system")):
        env.setdefault(k, v)


def stage_table(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it again.

    A lost executor then costs a reread and no recomputation, and the optimiser sees the true size.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidepool-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def n_words(text: Column) -> Column:
    """Words in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for the fold that no label may be learned from: crc32 of the id as text, modulo ``folds``, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))
