"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.tables import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp) for every node of the edges (a, b) that is not the smallest of its component; comp is the smallest.

    Large stars hang a node's larger neighbours on its smallest one, small stars its smaller neighbours; both keep the
    components and after about log n rounds only stars are left. A node with very many edges is a minimum that is
    pre-aggregated in the tasks, and a join between two written tables, whose large partitions Spark splits.
    """
    stars = scratch.save(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _all_stars(stars):
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = scratch.save(both.groupBy("a").agg(F.min("b").alias("low")))
        stars = scratch.save(
            both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.least("low", "a").alias("b"))
            .where("a != b").distinct()
        )
        low = scratch.save(stars.groupBy("a").agg(F.min("b").alias("low")))
        stars = scratch.save(
            stars.join(low, "a").where("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
            .union(low.select("a", F.col("low").alias("b"))).distinct()
        )
    return stars.select(F.col("a").alias("node"), F.col("b").alias("comp"))


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one smaller node, on which only others hang."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(
        edges.select("b", F.lit(0), F.lit(1)))
    counted = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return counted.where("below > 1 or below = 1 and above = 1").isEmpty()
