"""Text and JSON expressions: identities, names, numbers, answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Company suffixes that do not name a company.
SUFFIXES = ("limited", "ltd", "corporation", "corp", "company", "co", "incorporated", "inc", "plc", "llc")
#: Fixed value: query parameters that only track.
TRACKING = r"[?&](utm_[^=]+|fbclid|gclid|ref|source)=[^&]*"


def article_identity(url: Column, title: Column) -> Column:
    """sha256 of the lower-cased address without tracking parameters, fragment and trailing ? or &; of the title without one."""
    bare = F.regexp_replace(F.btrim(F.coalesce(url, F.lit(""))), f"(?i){TRACKING}", "")
    bare = F.lower(F.regexp_replace(F.substring_index(bare, "#", 1), r"[?&]+$", ""))
    name = F.regexp_replace(F.lower(F.btrim(F.coalesce(title, F.lit("")))), r"\s+", " ")
    return F.sha2(F.when(bare != "", bare).otherwise(name), 256)


def core_name(company: Column) -> Column:
    return F.btrim(F.regexp_replace(company, rf"(?i)\b({'|'.join(SUFFIXES)})\b\.?", ""))


def clean_label(x: Column) -> Column:
    """Trimmed; words that stand for nothing become null."""
    t = F.btrim(x)
    return F.when(~F.lower(t).isin("", "unknown", "nan", "none", "null"), t)


def parse_number(x: Column) -> Column:
    """A number with thousands commas; null where it is none or not finite."""
    v = F.expr("1") * F.regexp_replace(x, ",", "").try_cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def matches_alias(title: Column, alias: Column) -> Column:
    """Whether the alias stands as whole words in the title; an all-capital alias must match in case."""
    flat = lambda x: F.concat(F.lit(" "), F.regexp_replace(x, "[^A-Za-z0-9]+", " "), F.lit(" "))
    exact = F.instr(flat(title), flat(alias)) > 0
    return F.when(alias == F.upper(alias), exact).otherwise(F.instr(F.lower(flat(title)), F.lower(flat(alias))) > 0)


def strip_reasoning(text: Column) -> Column:
    """Drop closed and unclosed reasoning blocks."""
    return F.btrim(F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"(?s)<think>.*", ""))


def extract_json(text: Column) -> Column:
    """The JSON object inside one optional code fence; null if it is none."""
    body = F.btrim(F.regexp_replace(F.btrim(text), r"(?s)^```[a-z]*\n?(.*?)```$", "$1"))
    return F.when(body.startswith("{") & F.get_json_object(body, "$").isNotNull(), body)


def months_spanned(start: Column, end: Column) -> Column:
    months = F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month"))
    return F.when(start <= end, F.transform(months, lambda d: F.date_format(d, "yyyy-MM")))


def number_or_null(x: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)
