"""Secret scans by a trigram inverted index (DataFrame functions only)."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm._common import P, stage_table


@dataclass(frozen=True)
class Rule:
    """kind; pattern (syntax that Java and Python share); least length of ``group``; whether the case of letters counts."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False
    base: bool = False


RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20, base=True),
    Rule("hex", r"[0-9a-f]+", 24, base=True),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)

#: Alternatives beyond which a stretch of a pattern counts as unknown.
MOST = 64

#: Trigrams that one number holds as bits.
_BITS = 62

#: Trigrams of an alternative that the index is asked for; fewer only make more candidates to verify.
LONGEST = 6


def _literals(items) -> list[list[str]]:
    """For every alternative of a parsed pattern the literal stretches that each match must hold, lower-cased."""
    ways: list[list[str]] = [[""]]

    def cut() -> None:  # what follows is not next to what came before
        for way in ways:
            if way[-1]:
                way.append("")

    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            options = [[chr(arg).lower()]]
        elif name == "SUBPATTERN":
            options = _literals(arg[3])
        elif name == "BRANCH":
            options = [way for branch in arg[1] for way in _literals(branch)]
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            options = [[chr(a).lower()] for _, a in arg]
        elif name == "MAX_REPEAT" and arg[0] == 0 and arg[1] == 1:
            options = [[""], *_literals(arg[2])]
        elif name == "MAX_REPEAT" and arg[0] >= 1:
            options = None  # at least once: what it starts with follows, then anything
            first = _literals(arg[2])
            if len(ways) * len(first) <= MOST:
                ways = [[*w[:-1], w[-1] + o[0], *o[1:]] for w, o in product(ways, first)]
        else:
            options = None
        if options is None or len(ways) * len(options) > MOST:
            cut()
        else:
            ways = [[*w[:-1], w[-1] + o[0], *o[1:]] for w, o in product(ways, options)]
    return ways


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """The Boolean trigram query of a pattern, an OR of ANDs; None if some alternative has no mandatory trigram.

    An alternative that asks for more than another one goes, and ``LONGEST`` trigrams of a long one are enough.
    """
    ways = {frozenset(s[i:i + 3] for s in way for i in range(len(s) - 2)) for way in _literals(re._parser.parse(pattern))}
    if not all(ways):
        return None
    short = {frozenset(sorted(w)[:LONGEST]) for w in ways if not any(v < w for v in ways)}
    return sorted(short, key=sorted)


def postings(docs: DataFrame, trigrams: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The inverted index ``(trigram, doc)`` over whole texts, for the trigrams that the queries name (letters in lower case)."""
    low = docs.select(F.col(doc_id).alias("doc"), F.lower(F.col(text)).alias("low"))
    held = F.filter(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)]), lambda x: x.isNotNull())
    return low.select(F.explode(held).alias("trigram"), "doc")


def candidates(index: DataFrame, trigrams: list[str], queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """Intersect the postings: one row per document that satisfies a query, with the kinds to verify.

    The lists of a document meet as bits of a few numbers, so the intersection is one map-side combined aggregation.
    """
    place = {t: i for i, t in enumerate(trigrams)}
    words = range(-(-len(trigrams) // _BITS))
    bits = index.groupBy("doc").agg(*[F.bit_or(F.expr(f"case when trigram div {_BITS} = {w} then shiftleft(1L, trigram % {_BITS}) else 0L end")).alias(f"bits{w}") for w in words])

    def has(way: frozenset[str]) -> Column:
        masks = {w: sum(1 << place[t] % _BITS for t in way if place[t] // _BITS == w) for w in words}
        return reduce(Column.__and__, [F.col(f"bits{w}").bitwiseAND(F.lit(m)) == F.lit(m) for w, m in masks.items() if m])

    def met(ways: list[frozenset[str]]) -> Column:
        return reduce(Column.__or__, [has(way) for way in ways])

    return bits.select("doc", *[met(q).alias(k) for k, q in queries.items()]).filter(reduce(Column.__or__, [F.col(k) for k in queries]))


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Leftmost non-overlapping matches as structs (start, rank, kind, end), in code points; those below the rule's length go."""
    pattern = F.lit(("(?i)" if rule.any_case else "") + rule.pattern)
    # equal to the plain pattern less its short matches, since a class's runs are maximal; far fewer matches to make
    if rule.least > 1 and rule.group == 0 and re.fullmatch(r"\[[^\]]*\]\+", rule.pattern):
        pattern = F.lit(f"{rule.pattern[:-1]}{{{rule.least},}}")
    found, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    sized = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    parts = F.zip_with(F.arrays_zip(found.alias("m"), sized.alias("g")), F.slice(gaps, F.lit(1), F.size(found)),
                       lambda x, gap: F.struct(F.length(gap).alias("gap"), F.length(x["m"]).alias("len"), F.length(x["g"]).alias("sized")))
    empty = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(s: Column, p: Column) -> Column:
        begin = s["at"] + p["gap"]
        one = F.array(F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), (begin + p["len"]).alias("end")))
        return F.struct((begin + p["len"]).alias("at"), F.when(p["sized"] >= rule.least, F.concat(s["out"], one)).otherwise(s["out"]).alias("out"))

    return F.when(F.rlike(text, pattern), F.aggregate(parts, start, step)["out"]).otherwise(empty)


def scan_secrets(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: doc_id and spans, an array of (start, rank, kind, end) by start, then rule.

    Rules with mandatory trigrams are verified in the documents that the index gives; the others scan every text.
    A null or empty text has no spans; repeated rows and null ids are scanned alike; an empty table gives no rows.
    """
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    trigrams = sorted({t for q in queries.values() for way in q for t in way})
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias(f"{P}text"))
    if queries:
        hits = stage_table(candidates(postings(docs, trigrams, doc_id, text), trigrams, queries)).withColumnRenamed("doc", f"{P}doc")
        rows = rows.join(hits, F.col("doc_id").eqNullSafe(F.col(f"{P}doc")), "left")
    spans = [F.when(F.coalesce(F.col(r.kind), F.lit(False)), _spans(F.col(f"{P}text"), r, i)) if r.kind in queries else _spans(F.col(f"{P}text"), r, i)
             for i, r in enumerate(rules)]
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    return rows.select("doc_id", F.array_sort(F.flatten(F.array(*[F.coalesce(s, none) for s in spans]))).alias("spans"))


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span replaced by ``mark``; overlapping spans give one mark each stretch."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(s: Column, x: Column) -> Column:
        fresh = x["start"] >= s["at"]
        gap = F.substring(text, s["at"] + 1, x["start"] - s["at"])
        return F.struct(F.when(fresh, F.concat(s["out"], gap, F.lit(mark))).otherwise(s["out"]).alias("out"), F.greatest(s["at"], x["end"]).alias("at"))

    return F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
