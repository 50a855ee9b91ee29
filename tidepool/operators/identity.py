"""Who a row is about: constituent lists, names that were never resolved, labels for display, and tables cut to a universe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def constituents(listed: DataFrame, suffix: str = ".NS") -> DataFrame:
    """ticker, company, industry of an index list whose headers may differ in case and spaces.

    Every column that is read must be there: a renamed one would leave names without an industry and no error. Rows without a
    symbol go.
    """
    named = listed.toDF(*[c.strip().lower().replace(" ", "_") for c in listed.columns])
    missing = [c for c in ("symbol", "company_name", "industry") if c not in named.columns]
    if missing:
        raise ValueError(f"the list lacks {missing}; it has {named.columns}")
    symbol = F.btrim(F.col("symbol").cast("string"))
    return named.filter(symbol != "").select(F.concat(symbol, F.lit(suffix)).alias("ticker"), F.btrim("company_name").alias("company"), F.btrim("industry").alias("industry"))


def unresolved(ticker: Column, company: Column) -> Column:
    """True where the company's name is missing or only its symbol, so that a search for it would find next to nothing."""
    name = F.btrim(F.coalesce(company, F.lit("")))
    return (name == "") | (F.upper(name) == F.upper(F.substring_index(ticker, ".", 1)))


def tri_state(x: Column) -> Column:
    """A stored number as true or false; null and NaN stay unknown."""
    return F.when(x.isNotNull() & ~F.isnan(x.cast("double")), x != 0)


def verdict(grade: Column) -> Column:
    """The grade under its published name; null for anything that is no grade."""
    return F.when(grade == "STRONG", "APPROVED").when(grade == "WEAK", "FLAGGED").when(grade == "INSUFFICIENT", "REJECTED")


def benchmark_name(benchmark: Column, names: dict[str, str], own: str = "EW-LOO:") -> Column:
    """A benchmark for display: peers of an industry, the rest of the universe, a named index, or the id itself."""
    rest = F.substring(benchmark, len(own) + 1, 1 << 30)
    known = F.try_element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), benchmark) if names else F.lit(None)
    return (F.when(benchmark == f"{own}MARKET", "the rest of the universe (equal-weighted)").when(F.startswith(benchmark, F.lit(own)), F.concat(rest, F.lit(" peers (equal-weighted)")))
            .otherwise(F.coalesce(known, benchmark)))


def clean_tables(frames: dict[str, DataFrame], universe: DataFrame, key: str = "ticker") -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables without the rows of names outside the universe, and (table, kept, dropped); tables without the key stay whole.

    An empty universe would empty every table and is refused.
    """
    if universe.isEmpty():
        raise ValueError("the universe is empty: refused")
    held = universe.select(key).distinct()
    kept = {n: df.join(held, key, "left_semi") if key in df.columns else df for n, df in frames.items()}
    rows = []
    for n, df in sorted(frames.items()):
        marked = df.join(held.withColumn("_in", F.lit(1)), key, "left") if key in df.columns else df.withColumn("_in", F.lit(1))
        rows.append(marked.agg(F.lit(n).alias("table"), F.count("_in").alias("kept"), (F.count("*") - F.count("_in")).alias("dropped")))
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return kept, out
