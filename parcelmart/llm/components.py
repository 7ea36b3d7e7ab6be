"""Connected components of a graph given as pairs, in rounds of written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelmart.llm.texts import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: neighbours of a node are linked to the smallest of them (and the node itself).

    Large: the neighbours greater than the node; small: those less, and the node.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        linked = both.join(least, "u").where("v > u").select(F.col("v").alias("b"), F.col("m").alias("a"))
    else:
        both = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        linked = both.join(least, "u").select(F.col("v").alias("b"), F.col("m").alias("a")).unionByName(
            least.select(F.col("u").alias("b"), F.col("m").alias("a")))
    return linked.where("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a < b, both long): root is the smallest node that can be reached.

    Alternates large-star and small-star steps until the pairs stay the same; the number of rounds grows with the
    logarithm of the longest path. A node with very many neighbours is summed before it is
    shuffled, and its join can be split. Every round is a written table, so a lost executor repeats one round.
    """
    mark = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")]
    edges = written(edges, "edges")
    state = edges.agg(*mark).first()
    while state["n"]:
        edges = written(_star(_star(edges, True), False), "edges")
        before, state = state, edges.agg(*mark).first()
        if before == state:
            break
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        edges.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()
