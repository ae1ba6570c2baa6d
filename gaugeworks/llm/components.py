"""Connected components of an edge table, by rounds of joins; nothing about nodes or edges reaches the driver but whether rounds go on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.workspace import Workspace


def components(edges: DataFrame, work: Workspace, name: str = "components") -> DataFrame:
    """node, label (the smallest node of its component) for every node of an edge (a, b: long).

    Alternating large-star and small-star rounds: the edges always describe the same components and end as
    stars around the smallest node, after a number of rounds that grows with the logarithm of the size. The smallest
    neighbours are written before they are joined, so that the planner can split the edges of a node that very many share."""
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    pairs = work.keep(pairs, f"{name}-0")
    k = 0
    while not _are_stars(pairs):
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: each larger neighbour joins the smallest of the node and its neighbours
        low = work.keep(both.groupBy("u").agg(F.min("v").alias("low")), f"{name}-low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.least("low", "u").alias("v"))
        large = work.keep(large.distinct(), f"{name}-large")  # read twice
        # small star: each smaller neighbour, and the node itself, joins the smallest neighbour
        low = work.keep(large.groupBy("u").agg(F.min("v").alias("low")), f"{name}-lower")
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("low").alias("v")), F.struct("u", F.col("low").alias("v")))).alias("e"))
        nxt = work.keep(small.select("e.u", "e.v").where("u <> v").distinct(), f"{name}-{k + 1}")
        work.drop(f"{name}-{k}", f"{name}-low", f"{name}-large", f"{name}-lower")
        pairs, k = nxt, k + 1
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("label")).union(pairs.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _are_stars(pairs: DataFrame) -> bool:
    """Whether every node is either a centre or has one edge, to its centre."""
    ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).union(pairs.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where(F.col("out") + F.col("in") > 1).where("out > 0").isEmpty()
