"""Points in leaves of bounded size, and the leaves that a search can reach.

A table of points is cut along its widest axis into up to ``FAN`` parts, and every part that is still too large is cut again
along its own. The cuts of a level are one small row for each part, so a level is a join and a shuffle whatever the number of
leaves, and nothing is collected. Searches go down the same tree: a group of points reaches the boxes its bound allows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from millrace.session import write_and_read

ROWS = 2_048  # points of a leaf, about; only equal points can be more
FAN = 64
ROOT = "0"


def dimensions(points: DataFrame, vector: str = "_v") -> int:
    """Components of the vectors; an error if they differ, are missing or not numbers."""
    broken = F.col(vector).isNull() | F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    low, high, bad = points.agg(F.min(F.size(vector)), F.max(F.size(vector)), F.count_if(broken)).first()
    if bad:
        raise ValueError(f"{bad} vectors are null or have components that are null or not numbers; fill or filter them first")
    if low != high:
        raise ValueError(f"vectors have from {low} to {high} components")
    return high or 0


def extent(points: DataFrame, dims: int, keys: Sequence[str], *more: Column) -> DataFrame:
    """(keys, n, lo, hi) and further aggregates of groups of points."""
    return points.groupBy(*keys).agg(
        F.count("*").alias("n"), F.array(*[F.min(F.col("_v")[i]) for i in range(dims)]).alias("lo"),
        F.array(*[F.max(F.col("_v")[i]) for i in range(dims)]).alias("hi"), *more,
    )


@dataclass(frozen=True)
class Leaves:
    """Points with a column ``_leaf``, the cuts of each level, and all nodes (node, parent, leaf, n, lo, hi, more)."""

    points: DataFrame
    cuts: list[DataFrame]
    nodes: DataFrame
    dims: int

    @classmethod
    def build(cls, points: DataFrame, dims: int, rows: int = ROWS, least: str | None = None) -> Leaves:
        """``points`` have an array column ``_v``. ``least`` names a column whose minimum every node keeps."""
        placed, cuts = write_and_read(points.withColumn("_leaf", F.lit(ROOT))), []
        while True:
            width = F.zip_with("hi", "lo", lambda h, l: h - l)
            large = extent(placed, dims, ["_leaf"]).filter((F.col("n") > rows) & (F.array_max(width) > 0))
            large = large.withColumn("_axis", F.array_position(width, F.array_max(width)).cast("int")).select(
                "_leaf", "_axis", F.element_at("lo", F.col("_axis")).alias("_low"), F.element_at("hi", F.col("_axis")).alias("_high"),
                F.least(F.lit(FAN), F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n") / rows)))).cast("int").alias("_parts"),
            )
            large = write_and_read(large)
            if large.isEmpty():
                break
            value = placed.join(large, "_leaf").select("_leaf", F.element_at("_v", F.col("_axis")).alias("_x"))
            ranks = value.groupBy("_leaf").agg(F.percentile_approx("_x", [i / FAN for i in range(1, FAN)], 1_000).alias("_all"))
            step = (F.lit(FAN) / F.col("_parts")).cast("int")
            chosen = F.array_distinct(F.filter("_all", lambda x, i: ((i + 1) % step == 0) & (x < F.col("_high"))))
            middle = F.array(F.col("_low") + (F.col("_high") - F.col("_low")) / 2)
            level = write_and_read(large.join(ranks, "_leaf").select(
                "_leaf", "_axis", F.when(F.size(chosen) > 0, chosen).otherwise(middle).alias("_cuts")))
            cuts.append(level)
            placed = write_and_read(_down(placed, level))
        more = [F.min(least).alias("least")] if least else []
        stats = write_and_read(extent(placed, dims, ["_leaf"], *more))
        path = F.split("_leaf", "/")
        up = F.transform(F.sequence(F.lit(1), F.size(path)), lambda i: F.array_join(F.slice(path, F.lit(1), i), "/"))
        nodes = stats.withColumn("node", F.explode(up)).groupBy("node").agg(
            F.sum("n").alias("n"), F.array(*[F.min(F.col("lo")[i]) for i in range(dims)]).alias("lo"),
            F.array(*[F.max(F.col("hi")[i]) for i in range(dims)]).alias("hi"),
            F.max(F.col("node") == F.col("_leaf")).alias("leaf"), *[F.min("least").alias("least")] * bool(least),
        ).withColumn("parent", F.regexp_extract("node", "^(.*)/[^/]*$", 1))
        return cls(placed, cuts, write_and_read(nodes), dims)

    def place(self, others: DataFrame) -> DataFrame:
        """Other points in the leaf their place belongs to. A leaf may be missing there: then none of the tree's points lies
        in that part."""
        placed = others.withColumn("_leaf", F.lit(ROOT))
        for level in self.cuts:
            placed = write_and_read(_down(placed, level))
        return placed

    def reached(self, groups: DataFrame, allowed: Callable[[Column], Column]) -> DataFrame:
        """(_leaf, _cell): for every group (_leaf, lo, hi and what ``allowed`` needs) the leaves of this tree whose box it
        reaches. ``allowed`` gets the squared gap between the two boxes; columns of a node are named ``node_``."""
        kids = self.nodes.select(*[F.col(c).alias(f"node_{c}") for c in self.nodes.columns])
        own = groups.columns
        gap = squared_gap(F.col("lo"), F.col("hi"), F.col("node_lo"), F.col("node_hi"))
        front, found = groups.withColumn("node_parent", F.lit("")), []
        for _ in range(len(self.cuts) + 1):
            met = write_and_read(front.join(kids, "node_parent").filter(allowed(gap)))
            found.append(met.filter("node_leaf").select("_leaf", F.col("node_node").alias("_cell")))
            front = met.filter("not node_leaf").select(*own, F.col("node_node").alias("node_parent"))
        out = found[0]
        for more in found[1:]:
            out = out.union(more)
        return out

    def boxes(self) -> DataFrame:
        """(_cell, box_lo, box_hi, ...) of the leaves."""
        leaves = self.nodes.filter("leaf").drop("leaf", "parent").withColumnRenamed("node", "_cell")
        return leaves.select("_cell", *[F.col(c).alias(f"box_{c}") for c in leaves.columns if c != "_cell"])


def _down(placed: DataFrame, level: DataFrame) -> DataFrame:
    part = F.size(F.filter("_cuts", lambda cut: cut < F.element_at("_v", F.col("_axis"))))
    leaf = F.when(F.col("_cuts").isNull(), F.col("_leaf")).otherwise(F.concat_ws("/", "_leaf", part.cast("string")))
    return placed.join(level, "_leaf", "left").withColumn("_leaf", leaf).drop("_axis", "_cuts")


def squared_gap(alo: Column, ahi: Column, blo: Column, bhi: Column) -> Column:
    """Squared distance between two boxes; 0 where they overlap."""
    under = F.zip_with(alo, bhi, lambda x, y: x - y)
    over = F.zip_with(blo, ahi, lambda x, y: x - y)
    apart = F.zip_with(under, over, lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return F.aggregate(apart, F.lit(0.0), lambda total, x: total + x * x)


def squared_reach(v: Column, lo: Column, hi: Column) -> Column:
    """Squared distance from a point to the farthest corner of a box."""
    far = F.zip_with(F.zip_with(v, lo, lambda x, y: F.abs(x - y)), F.zip_with(hi, v, lambda x, y: F.abs(x - y)), lambda x, y: F.greatest(x, y))
    return F.aggregate(far, F.lit(0.0), lambda total, x: total + x * x)
