"""Line dedup by site-relative frequency (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm._common import P, stage_table

#: White space that is trimmed before lines are compared.
BLANK = " \t\r\x0b\x0c"


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """128 bits that stand for a line, white space around it trimmed; null for a blank line."""
    bare = F.btrim(line, F.lit(BLANK))
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit(1), bare).alias("b")))


def boilerplate_lines(docs: DataFrame, host: Column, text: str = "text", ratio: float = 0.02, min_pages: int = 3) -> DataFrame:
    """Lines (as keys) that more than ``ratio`` of a host's pages contain, and ``min_pages`` at least.

    Returns host, key, pages and host_pages. A page is a distinct text of a host, so copies of a page count once and do not
    make each other boilerplate; a line counts once a page. Keys are counted map-side, so a hot host or line is a few
    partial counts per task. A host has at most (lines a page) / ratio such lines. A null host is a host of its own.
    """
    body = F.col(text)
    rows = docs.select(host.cast("string").alias("host"), F.xxhash64(body).alias("h1"), F.xxhash64(F.lit(1), body).alias("h2"), F.array_distinct(F.transform(_lines(body), _key)).alias("keys"))
    pages = stage_table(rows.groupBy("host", "h1", "h2").agg(F.first("keys").alias("keys")).select("host", "keys"))
    total = pages.groupBy(F.col("host").alias("t_host")).agg(F.count("*").alias("host_pages"))
    seen = (pages.select("host", F.explode("keys").alias("key")).filter("key is not null")
            .groupBy("host", "key").agg(F.count("*").alias("pages")).filter(F.col("pages") >= min_pages))
    return (seen.join(total, F.col("host").eqNullSafe(F.col("t_host")))
            .filter(F.col("pages") > F.col("host_pages") * F.lit(ratio)).select("host", "key", "pages", "host_pages"))


def drop_boilerplate(docs: DataFrame, *, host: Column, doc_id: str = "doc_id", text: str = "text", ratio: float = 0.02,
                     min_pages: int = 3, dropped: str | None = None, most_keys: int = 100_000, most_a_host: int = 256) -> DataFrame:
    """``docs`` with the lines that exceed their host's boilerplate ratio taken out of ``text``; rows and columns stay.

    dropped names a column for the number of lines dropped. Blank lines stay; a null text stays null and drops nothing;
    repeated rows are one page, and all of them lose its lines; an empty table stays empty. Only keys are counted. Up to
    ``most_keys`` of them (16 bytes each), and ``most_a_host`` for one host, are broadcast as one list a host, and no text is
    shuffled; beyond that the keys to drop go to the documents that hold them by id. Both give the same rows.
    """
    site = host.cast("string")
    bad = stage_table(boilerplate_lines(docs, host, text, ratio, min_pages).select(F.col("host").alias("b_host"), F.col("key").alias("b_key")))
    lists = bad.groupBy(F.col("b_host").alias(f"{P}host")).agg(F.collect_list("b_key").alias(f"{P}bad"))
    n = lists.agg(F.sum(F.size(f"{P}bad")), F.max(F.size(f"{P}bad"))).first()
    rows = docs.withColumn(f"{P}site", site)
    if (n[0] or 0) <= most_keys and (n[1] or 0) <= most_a_host:
        rows = rows.join(F.broadcast(lists), F.col(f"{P}site").eqNullSafe(F.col(f"{P}host")), "left")
    else:
        held = docs.select(F.col(doc_id).alias("id"), site.alias("host"), F.explode(F.array_distinct(F.transform(_lines(F.col(text)), _key))).alias("key"))
        hits = (held.join(bad, F.col("host").eqNullSafe(F.col("b_host")) & (F.col("key") == F.col("b_key")))
                .groupBy(F.col("id").alias(f"{P}id"), F.col("host").alias(f"{P}host")).agg(F.collect_set("key").alias(f"{P}bad")))
        rows = rows.join(hits, F.col(doc_id).eqNullSafe(F.col(f"{P}id")) & F.col(f"{P}site").eqNullSafe(F.col(f"{P}host")), "left")
    lines, bad_here = _lines(F.col(text)), F.col(f"{P}bad")
    kept = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(bad_here, _key(x)), F.lit(False)))
    rows = rows.withColumn(f"{P}kept", F.when(bad_here.isNotNull(), kept))
    gone = F.coalesce(F.size(lines) - F.size(f"{P}kept"), F.lit(0)).cast("long")
    new = F.when(gone > 0, F.array_join(f"{P}kept", "\n")).otherwise(F.col(text))
    return rows.select(*[new.alias(text) if c == text else F.col(c) for c in docs.columns], *([gone.alias(dropped)] if dropped else []))
