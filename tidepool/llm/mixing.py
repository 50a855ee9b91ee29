"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm._common import P, n_words, stage_table


def source_targets(sizes: DataFrame, weights: Sequence[float], max_repeat: float, share: float) -> DataFrame:
    """Targets per source from ``(source, z)``: ``share`` of all sizes by weight, none above ``max_repeat`` times its size.

    Resharing the excess until no target is above its limit is water filling: in order of limit / weight a prefix of the
    sources stays at its limit and the rest share what is left by weight. Returns source, n (rank by code point, null
    last), z and target. One row per source; the table of sources is metadata and fits one task.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    per = (sizes.withColumn("n", F.row_number().over(order))
           .withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("n") - 1) % len(weights) + 1))
           .withColumn("cap", F.col("z") * F.lit(float(max_repeat)))
           .withColumn("total", F.sum("z").over(Window.partitionBy()) * F.lit(float(share))))
    fill = Window.orderBy(F.col("cap") / F.col("w"), "n")
    before = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (F.col("total") - before) / after)
    per = per.withColumn("level", F.first(F.when(F.col("cap") > F.col("level") * F.col("w"), F.col("level")), True)
                         .over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return per.select("source", "n", "z", F.coalesce(F.least("cap", F.col("level") * F.col("w")), F.col("cap")).alias("target"))


def _uniform(*parts: Column) -> Column:
    """A reproducible uniform number in [0, 1) for these parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(2**53))


def _left_quota(node: Column, level: int, seed: int) -> Column:
    """Blocks of each source that go to a node's left child: a multivariate-hypergeometric draw of half the node's blocks.

    Source by source, block by block, a block goes left with chance (still needed) / (still there), which gives exactly
    that distribution and exact sums.
    """
    total = F.aggregate("quota", F.lit(0).cast("long"), lambda s, q: s + q)

    def one_source(state: Column, item: Column) -> Column:
        def one_block(s: Column, t: Column) -> Column:
            left = (_uniform(F.lit(seed), F.lit(level), node, item["i"], t) * s["pop"] < s["need"]).cast("long")
            return F.struct((s["pop"] - 1).alias("pop"), (s["need"] - left).alias("need"))

        at = F.struct(state["pop"].alias("pop"), state["need"].alias("need"))
        end = F.when(item["q"] > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), item["q"]), at, one_block)).otherwise(at)
        return F.struct(end["pop"].alias("pop"), end["need"].alias("need"),
                        F.concat(state["out"], F.array(state["need"] - end["need"])).alias("out"))

    items = F.transform("quota", lambda q, i: F.struct(i.alias("i"), q.alias("q")))
    start = F.struct(total.alias("pop"), F.floor((total + 1) / 2).cast("long").alias("need"), F.array().cast("array<long>").alias("out"))
    return F.aggregate(items, start, one_source)["out"]


def splitting_tree(quotas: DataFrame, depth: int, seed: int) -> DataFrame:
    """Split exact quotas of blocks among 2**depth shards: ``(n, q)`` rows in, ``(n, upto)`` out.

    quotas: source rank n from 1 without gaps, its number of blocks q. upto: for every shard, the blocks of this source in
    the shards up to it. Only counts travel, never blocks.
    """
    tree = quotas.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "q"))), lambda x: x["q"]).alias("quota"))
    tree = tree.select(F.lit(0).cast("long").alias("node"), "quota")
    for level in range(depth):
        halves = tree.select("node", "quota", _left_quota(F.col("node"), level, seed).alias("left"))
        tree = halves.select(F.explode(F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("quota")),
            F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("quota", "left", lambda q, x: q - x).alias("quota")),
        )).alias("x")).select("x.*")
    leaves = tree.select("node", F.posexplode("quota").alias("i", "q"))
    upto = leaves.withColumn("upto", F.sum("q").over(Window.partitionBy("i").orderBy("node")))
    return upto.groupBy((F.col("i") + 1).alias("n")).agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "upto"))), lambda x: x["upto"]).alias("upto"))


def _order_hash(doc_id: Column, source: Column, text: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), doc_id, source, text)


def _key(source: Column) -> Column:
    """A source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def _beginning(rows: DataFrame, needs: DataFrame, first_bits: int, then_bits: int = 18) -> DataFrame:
    """For each source the longest beginning of its rows, in hash order, whose sizes sum to ``need`` at most.

    rows: k, h, size; needs: k, need. Returns k, cut (rows with h up to it are in) and gap (what is missing); sources
    without rows or need are absent. Sums of 2**first_bits stretches of the order are windowed, then those of 2**then_bits
    stretches of the one at the border, then the rows of one of these, about one in 2**27: nothing that grows with a source
    is sorted in one task. Rows with one h go together.
    """
    by = Window.partitionBy("k")
    bits, known = 0, needs.filter("need > 0").select("k", "need", F.lit(0).cast("double").alias("before"))
    inside = rows
    for step in (first_bits, then_bits):
        bits += step
        stretch = F.shiftright("h", 64 - bits)
        sums = inside.groupBy("k", stretch.alias("b")).agg(F.sum("size").alias("s")).join(known.select("k", "need", "before"), "k")
        upto = sums.withColumn("upto", F.col("before") + F.sum("s").over(by.orderBy("b")))
        # the first stretch that does not fit; where all fit, one past the last
        over = F.min(F.when(F.col("upto") > F.col("need"), F.struct("b", (F.col("upto") - F.col("s")).alias("before"))))
        at = upto.groupBy("k", "need").agg(over.alias("o"), F.max("upto").alias("all"))
        known = stage_table(at.select("k", "need", F.coalesce("o.before", "all").cast("double").alias("before"), F.col("o.b").alias("b")))
        inside = inside.join(known.select("k", "b"), "k").filter(stretch == F.col("b")).select("k", "h", "size")
    one = inside.groupBy("k", "h").agg(F.sum("size").alias("s")).join(known, "k")
    upto = one.withColumn("upto", F.col("before") + F.sum("s").over(by.orderBy("h"))).filter("upto <= need")
    last = upto.groupBy("k").agg(F.max("h").alias("last"), F.max("upto").alias("got"))
    cut = F.when(F.col("b").isNull(), F.lit(2**63 - 1)).otherwise(F.coalesce("last", F.shiftleft("b", 64 - bits) - 1))
    return stage_table(known.join(last, "k", "left").select("k", cut.alias("cut"), (F.col("need") - F.coalesce("got", "before")).alias("gap")))


def _fill(rows: DataFrame, gaps: DataFrame) -> DataFrame:
    """Single documents that bring each source's sum nearer to its target: k, extras to add and drops to leave out (order hashes).

    rows: k, h, size and taken (already in); gaps: k, gap. One document of each size is offered, the first in hash order. From
    the largest size down each that fits is added. What is still missing may then be overshot by the next larger document, if
    leaving out taken ones, from the largest down, brings the sum nearer than before. A source has as many offers as
    sizes, whatever the number of its documents.
    """
    near = rows.join(gaps.filter("gap > 0"), "k").filter("size > 0")
    first = near.groupBy("k", "taken", "size").agg(F.min("h").alias("h"))
    offers = near.join(first, ["k", "taken", "size", "h"]).groupBy("k", "gap", "taken", "h").agg(F.sum("size").alias("s"))  # rows with one h go together
    one = F.struct("s", "h")
    lists = offers.groupBy("k", "gap").agg(F.reverse(F.array_sort(F.collect_list(F.when(~F.col("taken"), one)))).alias("add"),
                                           F.reverse(F.array_sort(F.collect_list(F.when(F.col("taken"), one)))).alias("drop"))

    def greedy(items: str, room: Column) -> Column:
        start = F.struct(room.cast("double").alias("room"), F.array().cast("array<long>").alias("out"))

        def take(state: Column, x: Column) -> Column:
            fits = x["s"] <= state["room"]
            return F.struct(F.when(fits, state["room"] - x["s"]).otherwise(state["room"]).alias("room"),
                            F.when(fits, F.concat(state["out"], F.array(x["h"]))).otherwise(state["out"]).alias("out"))

        return F.aggregate(items, start, take)

    took = lists.withColumn("t", greedy("add", F.col("gap")))
    over = F.array_min(F.filter("add", lambda x: (x["s"] > F.col("t.room")) & ~F.array_contains("t.out", x["h"])))
    took = took.withColumn("over", over).withColumn("d", greedy("drop", F.coalesce(F.col("over.s") - F.col("t.room"), F.lit(0.0))))
    better = F.col("over").isNotNull() & (F.col("d.room") < F.col("t.room"))
    return took.select("k", F.when(better, F.concat("t.out", F.array("over.h"))).otherwise(F.col("t.out")).alias("extras"),
                       F.when(better, F.col("d.out")).otherwise(F.array().cast("array<long>")).alias("drops"))


def mix_plan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (5, 2, 1),
             max_repeat: float = 3.0, share: float = 1.0, block_bits: int = 9, shard_bits: int = 5, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """Plan a mix of whole documents; returns ``(sizes, blocks)``, both written to the shared folder.

    Each source is permuted by a hash of id, source and text and cut into 2**block_bits blocks of that order. A target of
    k.f times the source's size takes all its blocks k times, and once more the beginning of the order that fits the
    fraction f; past the first document that does not fit it goes on with the smaller ones, and single documents settle what
    is then missing (:func:`_fill`). The (block, pass) units with taken documents are the exact quotas that the splitting tree deals to
    2**shard_bits shards; a source's units are permuted before they are dealt. A document is taken by the shards that drew
    its block.

    sizes: doc, k, size, h (order hash), block. blocks: per source (k) and block z, target, passes, what of the last pass is
    taken (cut, small and cut2, extras, drops) and shards (shard of each pass).
    Rows that share id, source and text are taken together; null text has size 0; null source is a source of its own, the
    last. An empty table gives empty plans. Hot sources are spread over their blocks; only sums are windowed.
    """
    src = F.col(source).cast("string")
    h = _order_hash(F.col(doc_id), src, F.col(text), seed)
    sizes = stage_table(docs.select(F.col(doc_id).alias("doc"), src.alias("source"), _key(src).alias("k"), n_words(F.col(text)).alias("size"), h.alias("h"))
                        .withColumn("block", F.shiftright("h", 64 - block_bits)))
    per_block = stage_table(sizes.groupBy("source", "k", "block").agg(F.sum("size").alias("bz")))
    per = source_targets(per_block.groupBy("source").agg(F.sum("bz").alias("z")), weights, max_repeat, share).withColumn("k", _key(F.col("source")))
    per = per.withColumn("passes", F.when(F.col("z") > 0, F.least(F.floor(F.col("target") / F.col("z") + 1e-12), F.lit(int(max_repeat)))).otherwise(0).cast("long"))
    rest = F.when(F.col("passes") >= max_repeat, 0.0).otherwise(F.greatest(F.col("target") - F.col("passes") * F.col("z"), F.lit(0.0)))
    per = stage_table(per.select("k", "n", "z", "target", "passes", rest.alias("need")))

    units = sizes.select("k", "h", "size")
    one = _beginning(units, per, block_bits).withColumnsRenamed({"gap": "small"})
    after = units.join(one, "k").filter("h > cut")
    two = _beginning(after.filter("size > 0 and size <= small").select("k", "h", "size"), one.select("k", F.col("small").alias("need")), block_bits).withColumnRenamed("cut", "cut2")
    cuts = stage_table(one.join(two, "k", "left").select("k", "cut", "small", "cut2", F.coalesce("gap", "small").alias("gap")))
    taken = (F.col("h") <= F.col("cut")) | F.coalesce((F.col("h") <= F.col("cut2")) & (F.col("size") <= F.col("small")), F.lit(False))
    extras = _fill(units.join(cuts.drop("gap"), "k").select("k", "h", "size", taken.alias("taken")), cuts.select("k", "gap"))
    block_of = lambda x: F.shiftright(x, 64 - block_bits)
    yes = lambda c: F.coalesce(c, F.lit(False))
    last = yes(F.col("block") <= block_of("cut")) | yes(F.col("block") <= block_of("cut2")) | yes(F.exists("extras", lambda x: block_of(x) == F.col("block")))
    plan = (per_block.select("k", "block").join(per.drop("need"), "k").join(cuts.drop("gap"), "k", "left").join(extras, "k", "left")
            .withColumn("units", F.col("passes") + last.cast("long")))
    plan = stage_table(plan)

    units = plan.filter("units > 0").select("block", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("units"))).alias("turn"))
    units = units.withColumn("rank", F.row_number().over(Window.partitionBy("n").orderBy(F.xxhash64(F.lit(seed + 1), "n", "block", "turn"), "block", "turn")))
    quotas = plan.groupBy("n").agg(F.sum("units").alias("q"))
    tree = stage_table(splitting_tree(quotas, shard_bits, seed))
    dealt = (units.join(tree, "n").withColumn("shard", F.size(F.filter("upto", lambda u: u < F.col("rank"))))
             .groupBy(F.col("n").alias("d_n"), F.col("block").alias("d_block"))
             .agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "shard"))), lambda x: x["shard"]).alias("shards")))
    blocks = plan.join(dealt, (F.col("n") == F.col("d_n")) & (F.col("block") == F.col("d_block")), "left").drop("d_n", "d_block")
    return sizes, stage_table(blocks)


_PLAN = ("k", "block", "n", "z", "target", "passes", "cut", "small", "cut2", "extras", "drops", "units", "shards")


def _with_plan(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Join rows that carry internal k, block, h and size columns with their block's plan; adds the shards that took each row."""
    plan = blocks.select(*[F.col(c).alias(f"{P}p_{c}") for c in _PLAN])
    rows = rows.join(plan, (F.col(f"{P}k") == F.col(f"{P}p_k")) & (F.col(f"{P}block") == F.col(f"{P}p_block")))
    h, p = F.col(f"{P}h"), lambda c: F.col(f"{P}p_{c}")
    yes = lambda c: F.coalesce(c, F.lit(False))
    last = (h <= p("cut")) | yes((h <= p("cut2")) & (F.col(f"{P}size") <= p("small")) & (F.col(f"{P}size") > 0)) | yes(F.array_contains(p("extras"), h))
    times = p("passes") + yes(last & ~yes(F.array_contains(p("drops"), h))).cast("long")
    return rows.withColumn(f"{P}took", F.slice(F.coalesce(p("shards"), F.array().cast("array<int>")), F.lit(1), times.cast("int")))


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, repeats counted) and shards (shard of each take).

    Null text counts 0 words and takes none; see :func:`mix_plan` for ties, repeats, null sources and empty tables.
    """
    sizes, blocks = mix_plan(docs, **options)
    rows = sizes.select(F.col("doc").alias("doc_id"), *[F.col(c).alias(f"{P}{c}") for c in ("k", "h", "block", "size")])
    took, size = F.col(f"{P}took"), F.col(f"{P}size")
    return _with_plan(rows, blocks).select("doc_id", size.alias("size"), F.col(f"{P}p_z").alias("source_size"), F.col(f"{P}p_target").alias("target"),
                                           (size * F.size(took)).alias("taken"), took.alias("shards"))


def mix_documents(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", block_bits: int = 9, seed: int = 17,
                  shard_col: str | None = None, files_per_shard: int = 8, **options) -> DataFrame:
    """The mixed rows themselves: every document as often as the mix takes it, with the columns of ``docs``.

    Texts travel once, to their shard (cut by hash into ``files_per_shard`` parts, so a large shard is no single task), where
    they are shuffled locally: sorted by a hash of the document and the number of the take. shard_col adds the output
    shard. Reruns and recomputed tasks agree.
    """
    _, blocks = mix_plan(docs, doc_id=doc_id, source=source, text=text, block_bits=block_bits, seed=seed, **options)
    src = F.col(source).cast("string")
    h = _order_hash(F.col(doc_id), src, F.col(text), seed)
    rows = docs.withColumns({f"{P}k": _key(src), f"{P}h": h, f"{P}block": F.shiftright(h, 64 - block_bits), f"{P}size": n_words(F.col(text))})
    rows = _with_plan(rows, blocks).select(*docs.columns, f"{P}h", F.posexplode(f"{P}took").alias(f"{P}turn", f"{P}shard"))
    rows = rows.withColumn(f"{P}order", F.xxhash64(F.lit(seed + 2), f"{P}h", f"{P}turn"))
    rows = rows.repartition(f"{P}shard", F.pmod(f"{P}order", F.lit(files_per_shard))).sortWithinPartitions(f"{P}shard", f"{P}order")
    return rows.select(*docs.columns, *([F.col(f"{P}shard").alias(shard_col)] if shard_col else []))


def write_mix(docs: DataFrame, path: str, **options) -> None:
    """Write the mix of ``docs`` as one folder per shard, its rows in their local shuffle's order."""
    mix_documents(docs, shard_col="shard", **options).write.partitionBy("shard").parquet(path)
