"""Grades of a whole panel: partial pooling by restricted maximum likelihood inside every bootstrap replicate, multiplicity
control over the names, and one statement in place of many where the names cannot be told apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.operators import inference, statistics
from tidepool.operators.comparators import positive_chance
from tidepool.operators.pooling import written

# fixed values of the grading -----------------------------------------------------------------------------------------

ROUNDS, TOLERANCE = 200, 1e-12  # of the fixed point
ZERO = 1e-6  # heterogeneity at or below it is none
LEAST_FOLDS = 3  # with an ordering, for a name to be graded
ALPHA = 0.10  # family-wise level, and the share of false discoveries
LIKELY = 0.90  # posterior chance of a positive effect
BREAK_EVEN = 0.00512363994209475  # rank correlation that pays for the trades


def reml(effects: Column) -> Column:
    """Between-name variance by restricted maximum likelihood from an array of structs (x, v): effects and sampling variances.

    The fixed point w = 1 / (v + tau2), mu = sum(w x) / sum(w), tau2 = max(0, sum(w^2 ((x - mu)^2 + 1 / sum(w) - v)) / sum(w^2))
    from max(0, var(x) - mean(v)), in one expression: a replicate is a row and all replicates run side by side. 0 below two effects.
    """
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, e: s + f(e))
    n = F.size(effects)
    mean = total(effects, lambda e: e["x"]) / F.nullif(n, F.lit(0))
    spread = F.transform(F.array(mean), lambda m: total(effects, lambda e: (e["x"] - m) * (e["x"] - m)))[0] / F.nullif(n - 1, F.lit(0))
    start = F.greatest(spread - total(effects, lambda e: e["v"]) / F.nullif(n, F.lit(0)), F.lit(0.0))

    def step(t: Column) -> Column:
        sums = F.aggregate(effects, F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("wx"), F.lit(0.0).alias("ww")), lambda s, e: F.struct(
            (s["w"] + 1 / (e["v"] + t)).alias("w"), (s["wx"] + e["x"] / (e["v"] + t)).alias("wx"), (s["ww"] + 1 / ((e["v"] + t) * (e["v"] + t))).alias("ww")))
        top = lambda s: total(effects, lambda e: ((e["x"] - s["wx"] / s["w"]) * (e["x"] - s["wx"] / s["w"]) + 1 / s["w"] - e["v"]) / ((e["v"] + t) * (e["v"] + t)))
        return F.transform(F.array(sums), lambda s: F.greatest(top(s) / s["ww"], F.lit(0.0)))[0]

    def move(s: Column, _) -> Column:
        new = F.transform(F.array(step(s["t"])), lambda x: F.struct(x.alias("t"), (F.abs(x - s["t"]) < TOLERANCE).alias("done")))[0]
        return F.when(s["done"], s).otherwise(new)

    found = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(start.alias("t"), F.lit(False).alias("done")), move)["t"]
    return F.when(n >= 2, found).otherwise(0.0)


def pool(effects: DataFrame, keys: list[str], x: str = "x", v: str = "v") -> DataFrame:
    """keys, k, tau2, mu, mu_var, q: one empirical-Bayes pass for each key over its effects (one row a name; others go).

    mu is the mean weighted by 1 / (v + tau2) and mu_var the inverse of the weights' sum; q is Cochran's, with weights 1 / v.
    """
    ok = F.col(x).isNotNull() & ~F.isnan(x) & (F.col(v) > 0) & ~F.isnan(v)
    own = effects.filter(ok).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(v).cast("double").alias("v")))).alias("_e"))  # one entry a name
    own = own.withColumn("tau2", reml(F.col("_e")))
    sums = lambda a, t: F.aggregate(a, F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("wx"), F.lit(0.0).alias("wxx")), lambda s, e: F.struct(
        (s["w"] + 1 / (e["v"] + t)).alias("w"), (s["wx"] + e["x"] / (e["v"] + t)).alias("wx"), (s["wxx"] + e["x"] * e["x"] / (e["v"] + t)).alias("wxx")))
    own = own.withColumns({"_s": sums(F.col("_e"), F.col("tau2")), "_z": sums(F.col("_e"), F.lit(0.0)), "k": F.size("_e")})
    many = F.col("k") >= 2
    return own.select(*keys, "k", "tau2", F.when(many, F.col("_s.wx") / F.col("_s.w")).alias("mu"), F.when(many, 1 / F.col("_s.w")).alias("mu_var"), (F.col("_z.wxx") - F.col("_z.wx") * F.col("_z.wx") / F.col("_z.w")).alias("q"))


def degenerate(tau2: Column, q: Column, k: Column) -> Column:
    """True where the names cannot be told apart: no heterogeneity, or no more dispersion than sampling alone gives."""
    return (tau2 <= ZERO) | ((k > 1) & (q <= k - 1))


def posterior(x: Column, v: Column, mu: Column, mu_var: Column, tau2: Column) -> Column:
    """Struct of b, theta and var: the shrunk effect, and its variance with the part that the estimated mean adds, b^2 mu_var
    (without it every name would be certain where tau2 is 0)."""
    b = F.when(v + tau2 > 0, v / F.nullif(v + tau2, F.lit(0.0))).otherwise(1.0)
    naive = F.when(v + tau2 > 0, v * tau2 / F.nullif(v + tau2, F.lit(0.0))).otherwise(0.0)
    return F.struct(b.alias("b"), (b * mu + (1 - b) * x).alias("theta"), (naive + b * b * mu_var).alias("var"))


def name_effects(fold_means: DataFrame, keys: list[str]) -> DataFrame:
    """keys, folds, x (mean over folds), v (their sample variance over their number, null below two): ``fold_means`` has mean a row a fold."""
    return fold_means.groupBy(*keys).agg(F.count("mean").alias("folds"), F.avg("mean").alias("x"), F.when(F.count("mean") >= 2, F.var_samp("mean") / F.count("mean")).alias("v"))


def _grade(signed: bool, significant: Column, theta: Column, chance: Column, bar: Column) -> Column:
    likely = chance >= LIKELY
    if signed:
        return F.when(significant & (theta < 0), "ANTI_SIGNAL").when(significant & (theta > 0), F.when(likely & (theta >= bar), "STRONG").otherwise("WEAK")).when(likely, "WEAK").otherwise("INSUFFICIENT")
    return F.when(significant & (theta > bar) & likely, "STRONG").when((theta > 0) & likely, "WEAK").otherwise("INSUFFICIENT")


def grade_by_pooling(effects: DataFrame, break_even: float = BREAK_EVEN, q: float = ALPHA) -> DataFrame:
    """ticker, theta, b, p_positive, p_two_sided, significant, grade from one effect and variance a name (ticker, x, v).

    The older grading: heterogeneity by moments, shrinkage to the fixed-effect mean, step-up control of false discoveries over
    the names that could be measured, and four grades, among them ANTI_SIGNAL for orderings that are reliably backwards. Names
    without an effect or variance are INSUFFICIENT and no part of the family.
    """
    ok = F.col("x").isNotNull() & (F.col("v") > 0)
    some = effects.filter(ok)
    whole = statistics.dersimonian_laird(some, "x", "v").select("mean", "tau2").join(some.agg((1 / F.sum(1 / F.col("v"))).alias("mu_var")))  # one row
    rows = some.join(whole).withColumn("_p", posterior(F.col("x"), F.col("v"), F.col("mean"), F.col("mu_var"), F.col("tau2")))
    rows = rows.select("ticker", F.col("_p.theta").alias("theta"), F.col("_p.b").alias("b"), F.when(F.col("_p.var") > 0, positive_chance(F.col("_p.theta"), F.col("_p.var"))).alias("p_positive"))
    rows = rows.withColumn("p_two_sided", 2 * F.least(F.col("p_positive"), 1 - F.col("p_positive")))
    tested = statistics.benjamini_hochberg(rows, "p_two_sided", q).withColumn("grade", _grade(True, F.col("significant"), F.col("theta"), F.col("p_positive"), F.lit(break_even)))
    out = effects.select("ticker").join(tested, "ticker", "left")
    return out.withColumns({"grade": F.coalesce("grade", F.lit("INSUFFICIENT")), "significant": F.coalesce("significant", F.lit(False))})


def grade_panel(products: DataFrame, *, x: str = "product", replicates: int = 1000, block: int = 30, seed: int = 7, break_even: float = BREAK_EVEN, alpha: float = ALPHA, tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(names, panel) of rank products (fold, ticker, date, x), whose mean over dates is a name's rank correlation in a fold.

    Whole date blocks are resampled jointly within folds, and every replicate runs the whole pooling, so the spread of its mean
    is that of the pipeline. A name's variance is that of its replicates; where they do not spread, that between its folds
    (``source`` fold). Products and effects of replicates are written once and read again. Names need three folds. Family-wise control is Romano and Wolf's on studentised, centred replicates;
    step-up masks by Benjamini-Hochberg and Benjamini-Yekutieli stand beside it.

    names: ticker, folds, x, v, source, theta, b, p_positive, boot_p, rw_p, bh, by, grade. panel: one row with names, usable,
    mu, se_boot, z, tau2, tau2_dl, q, degenerate, strong, weak, insufficient. Replicates are rows; nothing but single-row
    tables and one row a name meet in one task.
    """
    products = written(products.select("fold", "ticker", "date", x))
    real = name_effects(products.groupBy("fold", "ticker").agg(F.avg(x).alias("mean")), ["ticker"])
    boot = inference.block_bootstrap_means(products.select("fold", "ticker", "date", F.col(x).alias("_x")), "_x", replicates, block, seed, tasks)
    again = written(name_effects(boot, ["replicate", "ticker"]))
    mus = pool(again, ["replicate"])
    spread = again.groupBy("ticker").agg(F.var_samp("x").alias("_bv"))
    names = real.join(spread, "ticker", "left").withColumn("_ok", F.col("_bv") > 0)
    names = names.select("ticker", "folds", "x", F.when(F.col("_ok"), F.col("_bv")).otherwise(F.col("v")).alias("v"), F.when(F.col("_ok"), "bootstrap").otherwise("fold").alias("source"))
    names = names.withColumn("usable", F.coalesce((F.col("folds") >= LEAST_FOLDS) & F.col("x").isNotNull() & (F.col("v") > 0), F.lit(False)))
    names = written(names)  # one row a name
    some = names.filter("usable")
    one = pool(some.withColumn("_all", F.lit(1)), ["_all"]).select("k", "tau2", "mu", "mu_var", "q")  # one row
    stats = some.select("ticker", (F.col("x") / F.sqrt("v")).alias("t"))
    centred = again.select("ticker", "replicate", F.col("x").alias("_b")).join(some.select("ticker", "x", "v"), "ticker")
    family = inference.romano_wolf(stats, centred.select("ticker", "replicate", ((F.col("_b") - F.col("x")) / F.sqrt("v")).alias("bt")), "ticker").select("ticker", F.col("p_adjusted").alias("rw_p"))
    own_p = centred.groupBy("ticker").agg(F.avg((F.col("_b") - F.col("x") >= F.col("x")).cast("double")).alias("boot_p"))
    masks = own_p
    for name, dependent in (("bh", False), ("by", True)):
        masks = statistics.benjamini_hochberg(masks, "boot_p", alpha, dependent).withColumnRenamed("significant", name)
    rows = some.join(one).withColumn("_p", posterior(F.col("x"), F.col("v"), F.col("mu"), F.col("mu_var"), F.col("tau2"))).join(family, "ticker", "left").join(masks, "ticker", "left")
    theta, chance = F.col("_p.theta"), F.when(F.col("_p.var") > 0, positive_chance(F.col("_p.theta"), F.col("_p.var")))
    graded = rows.select("ticker", theta.alias("theta"), F.col("_p.b").alias("b"), chance.alias("p_positive"), "boot_p", "rw_p", "bh", "by").withColumn(
        "grade", _grade(False, F.coalesce(F.col("rw_p") <= alpha, F.lit(False)), F.col("theta"), F.col("p_positive"), F.lit(break_even)))
    names = names.drop("usable").join(graded, "ticker", "left").withColumns({"grade": F.coalesce("grade", F.lit("INSUFFICIENT")), "bh": F.coalesce("bh", F.lit(False)), "by": F.coalesce("by", F.lit(False))})
    count = lambda g: F.sum((F.col("grade") == g).cast("long")).alias(g.lower())
    counts = names.agg(F.count("*").alias("names"), count("STRONG"), count("WEAK"), count("INSUFFICIENT"))  # one row
    se = mus.agg(F.stddev_samp("mu").alias("se_boot"))  # one row
    moments = statistics.dersimonian_laird(some, "x", "v").select(F.col("tau2").alias("tau2_dl"))  # one row
    panel = counts.join(se).join(one, how="left", on=F.lit(True)).join(moments, how="left", on=F.lit(True))
    return names, panel.select("names", F.coalesce("k", F.lit(0)).alias("usable"), "mu", "se_boot", (F.col("mu") / F.nullif("se_boot", F.lit(0.0))).alias("z"), "tau2", "tau2_dl", "q",
                               F.coalesce(degenerate(F.col("tau2"), F.col("q"), F.col("k")), F.lit(True)).alias("degenerate"), "strong", "weak", "insufficient")


def headline(panel: DataFrame) -> DataFrame:
    """``panel`` with text: one statement on the panel where its names cannot be told apart, else how many survive."""
    f = F.format_string
    none = F.lit("No name can be graded: none has enough folds with an ordering.")
    same = f("The names cannot be told apart: one mean of %+.5f (bootstrap se %.5f, z %+.2f) stands for all %d.", "mu", "se_boot", "z", "usable")
    apart = f("%d of %d names survive at level %.2f; mean %+.5f (bootstrap se %.5f, z %+.2f).", F.col("strong"), F.col("usable"), F.lit(ALPHA), F.col("mu"), F.col("se_boot"), F.col("z"))
    return panel.withColumn("text", F.when(F.col("usable") == 0, none).when(F.col("degenerate"), same).otherwise(apart))


def clean_up_counts(names: DataFrame, before: DataFrame) -> DataFrame:
    """before, after, n: names by their grade in two gradings (ticker, grade); those missing on one side count as null."""
    old, new = before.select("ticker", F.col("grade").alias("before")), names.select("ticker", F.col("grade").alias("after"))
    return old.join(new, "ticker", "full").groupBy("before", "after").agg(F.count("*").alias("n"))


def ranked_products(rows: DataFrame, y: str, pred: str, least: int = 10) -> DataFrame:
    """fold, ticker, date, product of cross-sectional unit ranks of both sides; dates with fewer names than ``least`` go, never filled from others."""
    from tidepool.operators import crosssection as xs

    some = rows.filter(F.col(y).isNotNull() & F.col(pred).isNotNull()).withColumn("_n", F.count("*").over(Window.partitionBy("date"))).filter(F.col("_n") >= least)
    ranked = xs.unit_rank(xs.unit_rank(some, pred, "_p"), y, "_t")
    return statistics.rank_product(ranked, "_t", "_p").select("fold", "ticker", "date", "product")
