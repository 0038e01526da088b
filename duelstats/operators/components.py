"""Connected components by alternating stars (Kiveris et al., "Connected components in MapReduce and beyond", 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from duelstats.session import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node points to one centre and no centre points on."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("in")), F.struct(F.col("b").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("in"))))
    nodes = edges.select(ends.alias("e")).groupBy("e.n").agg(F.sum("e.out").alias("out"), F.max("e.in").alias("in"))
    return nodes.where((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("in") > 0))).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """Label every node of the edges (a, b) with the smallest node of its component: (node, component).

    Rounds grow with the logarithm of the graph; every round is one aggregation and one equi join per star.
    """
    pairs = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    state = cut(pairs.distinct())
    while not _is_stars(state):
        state = cut(_small_star(_large_star(state)))
    roots = state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
