"""Connected components of a link table by alternating large-star and small-star steps, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evimatch.llm.tables import Scratch, has_rows


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest node of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch, name: str = "cc", most: int = 60) -> DataFrame:
    """edges (u, v), any orderable type -> (node, label): label is the smallest node that can be reached.

    Nodes without a link do not appear.  An empty link table gives an empty result.  Links from a node to itself are ignored.
    """
    now = scratch.table(edges.select("u", "v").where("u <> v").distinct(), f"{name}-0")
    print_of = None
    for i in range(1, most):
        if i == 1 and not has_rows(now):
            break
        now = scratch.table(_small_star(_large_star(now)), f"{name}-{i}")
        scratch.drop(f"{name}-{i - 1}")
        got = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if got == print_of:
            break
        print_of = got
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots)
