"""Connected components of a graph given as pairs, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.session import cut_lineage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 40) -> DataFrame:
    """(node, component) of every node of ``edges``; a component is named by its least node.

    Alternates large-star and small-star steps (Kiveris et al., 2014): a round is two aggregations and joins over the
    edges, and the number of rounds grows with the logarithm of the longest chain.  Edges are written to the checkpoint
    folder each round; nothing but one counter per round comes to the driver.  Null ends and loops are dropped; an empty
    graph gives no rows; parallel edges count once.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct()
    e = cut_lineage(e)
    for _ in range(max_rounds):
        new = cut_lineage(_small_star(_large_star(e)))
        same = new.join(e, ["u", "v"], "left_anti").isEmpty() and e.join(new, ["u", "v"], "left_anti").isEmpty()
        e = new
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy(F.col("u").alias("c")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
    out = both.join(low, both["u"] == low["c"]).where("v > c").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
    j = e.join(low, e["u"] == low["c"])
    out = j.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("c").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct()
