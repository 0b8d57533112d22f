"""Connected components of links between numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import written


def _stars(links: DataFrame) -> DataFrame:
    """Hang the larger neighbours of every node on its least neighbour or itself."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").distinct()


def _chains(links: DataFrame) -> DataFrame:
    """Hang every node and its smaller neighbours on the least of them."""
    least = links.groupBy(F.col("v").alias("n")).agg(F.min("u").alias("m"))
    moved = links.join(least, F.col("v") == F.col("n")).select("m", F.col("u").alias("v"))
    roots = least.select("m", F.col("n").alias("v"))
    return moved.where("v <> m").union(roots).select(F.col("m").alias("u"), "v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every number in the links; the least member names a component.

    Alternating large and small stars: each round keeps components and roughly squares
    the shrinking of paths, no node's neighbours are ever gathered, and every round is
    written, so lineage stays short. Links to itself are kept as lone nodes; rows with a
    null are ignored; no links give no rows.
    """
    pairs = links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
    pairs = written(pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct(), "links")
    at, seen = pairs.where("u <> v"), None
    while True:
        at = written(_chains(_stars(at)), "stars")
        mark = tuple(at.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen = mark
    lone = pairs.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("component"))
    tied = at.select(F.col("v").alias("node"), F.col("u").alias("component"))
    tops = at.select(F.col("u").alias("node"), F.col("u").alias("component"))
    return tied.union(tops).union(lone).groupBy("node").agg(F.min("component").alias("component"))
