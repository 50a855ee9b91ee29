"""Connected components of a link table by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm._common import stage_table


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands the smallest node near it to its larger neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node ties itself and its smaller neighbours to the smallest of them (u > v in every row)."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    rest = edges.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Return ``(node, component)`` for every node that reaches a smaller one; component is the smallest node reachable.

    links: two long columns; self links, repeats and null ends are ignored. Nodes that are absent, the smallest of a
    component and those without links, are their own components.
    The rounds are logarithmic in the diameter; each is written to the shared folder, so the plan stays short
    and a lost executor costs one round. The groups are only aggregated (min) and joined, never gathered.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    edges = stage_table(links.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
                        .filter(x.isNotNull() & y.isNotNull() & (x != y)).distinct())
    mark = None
    for _ in range(max_rounds):
        edges = stage_table(_small_star(_large_star(edges)))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def named_components(nodes: DataFrame, parts: DataFrame, node: str, name: str) -> DataFrame:
    """``nodes`` with component_id: the smallest name of a node's component, null where none of its nodes has one.

    parts: (node, component) of :func:`connected_components`; nodes that it leaves out are their own components.
    """
    placed = nodes.join(parts.select(F.col("node").alias("__n"), F.col("component").alias("__c")), F.col(node) == F.col("__n"), "left").withColumn("__c", F.coalesce("__c", node)).drop("__n")
    names = placed.groupBy(F.col("__c").alias("__k")).agg(F.min(name).alias("component_id"))
    return placed.join(names, F.col("__c") == F.col("__k")).drop("__c", "__k")
