"""Exact nearest neighbours in two rounds over leaves of bounded size.

The points are in leaves (see ``leaves``). A query first meets the leaf of its own place, which gives a true distance of its
k-th neighbour so far; with that bound it goes down the tree and meets the other leaves whose boxes are near enough.

In many dimensions every box is near enough, so vectors of more than ``WIDE`` components meet in blocks instead: a matrix product
in single precision rules pairs out, the others get their distance in double precision, and a task hands on no more
than the k closest of what it saw.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from millrace.operators.blocks import BLOCK, block_pairs, packed_vectors, pair_blocks
from millrace.operators.leaves import Leaves, dimensions, extent, squared_gap, squared_reach
from millrace.session import write_and_read

VECTOR = T.ArrayType(T.DoubleType())
DIGITS = 9  # distances equal to this many digits count as ties
TIE = 2 * 10.0**-DIGITS  # what rounds to the k-th distance is no farther than this behind it
WIDE = 16  # components up to which leaves are searched


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``a`` to all rows of ``b``."""
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        total += (a[:, j, None] - b[None, :, j]) ** 2
    return np.sqrt(total)


def stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def batches(n: int, width: int, cells: int = 2_000_000) -> Iterator[slice]:
    """Row slices small enough for a ``rows x width`` matrix."""
    step = max(1, cells // max(width, 1))
    for start in range(0, n, step):
        yield slice(start, start + step)


def k_smallest(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` smallest entries per row, earlier columns first among equals."""
    if d.shape[1] > k:
        limit = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
        rows, cols = np.nonzero(d <= limit)
    else:
        rows, cols = np.nonzero(np.isfinite(d) | np.isinf(d))
    order = np.lexsort((cols, d[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[place < k], cols[place < k]


def nearest(
    queries: DataFrame, points: DataFrame, k: int, query_id: str, point_id: str, vector: str,
    exclude_same: bool = False, block: int = BLOCK,
) -> DataFrame:
    """(query_id, neighbour, distance, rank): the ``k`` closest points per query, lower id first among ties.

    ``vector`` is an array<double> column of both frames; null vectors, null components and different lengths are an error.
    ``exclude_same`` leaves out the point whose id equals the query's. ``block`` is the number of rows of a leaf and of what
    meets in one task.
    """
    q_type, p_type = queries.schema[query_id].dataType, points.schema[point_id].dataType
    wanted = k + 1 if exclude_same else k
    q = write_and_read(queries.select(F.col(query_id).alias("_q"), F.col(vector).cast("array<double>").alias("_v")))
    p = write_and_read(points.select(F.col(point_id).alias("_p"), F.col(vector).cast("array<double>").alias("_v")))
    pair_schema = T.StructType([T.StructField("_q", q_type), T.StructField("_p", p_type)]).add("distance", "double")
    if p.isEmpty() or q.isEmpty():
        schema = T.StructType([T.StructField(query_id, q_type), T.StructField("neighbour", p_type)])
        return queries.sparkSession.createDataFrame([], schema.add("distance", "double").add("rank", "integer"))
    dims = dimensions(p.select("_v").union(q.select("_v")))
    # Of exactly equal points only the lowest ids can be neighbours; the rank filter runs before the shuffle too.
    copies = W.partitionBy("_v").orderBy("_p")
    p = p.withColumn("_c", F.row_number().over(copies)).filter(F.col("_c") <= wanted).drop("_c")
    if dims > WIDE:
        return _ranked(_by_blocks(q, p, wanted, pair_schema, block), k, query_id, exclude_same)
    tree = Leaves.build(p, dims, block)

    def closest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            b = b.sort_values("_p")
            p_ids, q_ids = b["_p"].to_numpy(), a["_q"].to_numpy()
            x, y = stack(a["_v"]), stack(b["_v"])
            for s in batches(len(x), len(y)):
                d = distances(x[s], y)
                rows, cols = k_smallest(np.round(d, DIGITS), wanted)
                out.append(pd.DataFrame({"_q": q_ids[s][rows], "_p": p_ids[cols], "distance": d[rows, cols]}))
        return pd.concat(out) if out else pd.DataFrame({"_q": [], "_p": [], "distance": []})

    def met(asked: DataFrame) -> DataFrame:
        """The closest points of leaves to queries (_q, _v, _cell)."""
        held = tree.points.select("_p", "_v", F.col("_leaf").alias("_cell"))
        left, right = pair_blocks(asked, held, ["_cell"], "_q", "_p", block)
        keys = ["_cell", "_lb", "_rb"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(closest, pair_schema)

    placed = tree.place(q)
    found = met(placed.withColumnRenamed("_leaf", "_cell"))
    if tree.cuts:
        found = write_and_read(found)
        found = found.unionByName(met(write_and_read(_routed(tree, placed, found, wanted, dims))))
    return _ranked(found, k, query_id, exclude_same)


def _ranked(found: DataFrame, k: int, query_id: str, exclude_same: bool) -> DataFrame:
    if exclude_same:
        found = found.filter(F.col("_q") != F.col("_p"))
    rank = F.row_number().over(W.partitionBy("_q").orderBy(F.round("distance", DIGITS), "_p"))
    found = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return found.select(F.col("_q").alias(query_id), F.col("_p").alias("neighbour"), "distance", "rank")


class _Closest:
    """The closest points so far of a block of queries."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, wanted: int):
        self.ids, self.x, self.wanted = ids, x, wanted
        self.bound = np.full(len(x), np.inf)
        self.found, self.pending = [], 0

    def meet(self, ids: np.ndarray, y: np.ndarray) -> None:
        """Single precision rules out, double precision decides."""
        a, b = self.x - self.x.mean(axis=0), y - self.x.mean(axis=0)
        scale = max(np.abs(a).max(), np.abs(b).max()) or 1.0
        a, b = (a / scale).astype("f4"), (b / scale).astype("f4")
        aa, bb = (a * a).sum(axis=1, keepdims=True), (b * b).sum(axis=1, keepdims=True)
        slack = (a.shape[1] + 8) * np.finfo("f4").eps * float(aa.max() + bb.max())
        a, b = np.hstack([-2 * a, aa, np.ones_like(aa)]), np.hstack([b, np.ones_like(bb), bb]).T
        for s in batches(len(a), len(y), 500_000):
            squared, far = a[s] @ b, self.bound[s] / scale
            if len(y) > self.wanted and np.isinf(far).any():
                kth = np.partition(squared, self.wanted - 1, axis=1)[:, self.wanted - 1]
                far = np.minimum(far, np.sqrt(np.maximum(kth, 0) + slack))
            limit = ((far + TIE / scale) ** 2 + 2 * slack).astype("f4")
            cells = np.flatnonzero(squared <= limit[:, None])
            if len(cells):
                r, c = s.start + cells // len(y), cells % len(y)
                d = np.zeros(len(r))
                for j in range(y.shape[1]):
                    d += (self.x[r, j] - y[c, j]) ** 2
                d = np.sqrt(d)
                near = d <= self.bound[r] + TIE
                self.found.append(pd.DataFrame({"_r": r[near], "_p": ids[c[near]], "distance": d[near]}))
                self.pending += int(near.sum())
        if self.pending > len(self.x) * self.wanted // 2:
            self.keep()

    def keep(self) -> None:
        if self.pending:
            both = pd.concat(self.found)
            both = both.assign(_d=both["distance"].round(DIGITS)).sort_values(["_r", "_d", "_p"])
            place = both.groupby("_r").cumcount().to_numpy()
            kth = both[place == self.wanted - 1]
            self.bound[kth["_r"]] = kth["distance"]
            self.found, self.pending = [both[place < self.wanted].drop(columns="_d")], 0

    def best(self) -> pd.DataFrame:
        self.keep()
        out = pd.concat(self.found)
        return pd.DataFrame({"_q": self.ids[out["_r"]], "_p": out["_p"].to_numpy(), "distance": out["distance"].to_numpy()})


def _by_blocks(q: DataFrame, p: DataFrame, wanted: int, schema: T.StructType, block: int) -> DataFrame:
    """(_q, _p, distance): for every query the closest ``wanted`` points of each share of the points that one task goes through."""
    left, right = (packed_vectors(side.repartition(max(1, -(-side.count() // block))), [c], block) for side, c in ((q, "_q"), (p, "_p")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, at = None, None
        for pdf in frames:
            for r in pdf.itertuples():
                if r.block_a != at:
                    if held:
                        yield held.best()
                    ids = np.array(list(r.q_a))
                    held, at = _Closest(ids, np.frombuffer(r.v_a).reshape(len(ids), -1), wanted), r.block_a
                ids = np.array(list(r.p_b))
                held.meet(ids, np.frombuffer(r.v_b).reshape(len(ids), -1))
        if held:
            yield held.best()

    return block_pairs(left.withColumnRenamed("_q", "q"), right.withColumnRenamed("_p", "p")).mapInPandas(run, schema)


def _routed(tree: Leaves, placed: DataFrame, found: DataFrame, wanted: int, dims: int) -> DataFrame:
    """(_q, _v, _cell) for the leaves other than a query's own that may hold one of its neighbours.

    A query that met fewer points than wanted is bound by the farthest corner of the smallest part of the tree around its place
    that holds enough; without such a part every leaf is near."""
    place = F.row_number().over(W.partitionBy("_q").orderBy("distance"))
    kth = found.withColumn("_r", place).filter(F.col("_r") == wanted).select("_q", F.col("distance").alias("_kth"))
    known = write_and_read(placed.join(kth, "_q", "left"))
    path = F.split("_leaf", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(path)), lambda i: F.array_join(F.slice(path, F.lit(1), i), "/"))
    ample = tree.nodes.filter(F.col("n") >= wanted).select("node", "lo", "hi")
    corner = F.struct((-F.length("node")).alias("_at"), F.sqrt(squared_reach(F.col("_v"), F.col("lo"), F.col("hi"))).alias("_far"))
    around = known.filter("_kth is null").select("_q", "_v", F.explode(up).alias("node")).join(ample, "node").groupBy("_q").agg(
        F.min(corner).alias("_corner"))
    far = F.coalesce("_kth", "_corner._far", F.lit(float("inf")))
    slack = F.lit(2 * 10.0**-DIGITS)  # what rounds to the k-th distance is a tie
    bound = write_and_read(known.join(around, "_q", "left").select("_q", "_v", "_leaf", (far * (1 + 1e-9) + slack).alias("_bound")))
    groups = extent(bound, dims, ["_leaf"], F.max("_bound").alias("_bound"))
    pairs = write_and_read(tree.reached(groups, lambda gap: F.sqrt(gap) <= F.col("_bound")).filter("_leaf <> _cell"))
    gap = squared_gap(F.col("_v"), F.col("_v"), F.col("box_lo"), F.col("box_hi"))
    near = bound.join(pairs, "_leaf").join(tree.boxes(), "_cell").filter(F.sqrt(gap) <= F.col("_bound"))
    return near.select("_q", "_v", "_cell")


def unit_vector(c):
    """(array scaled to length 1, so that Euclidean order equals cosine order; whether it has a length at all)."""
    x = F.transform(c, lambda v: v.cast("double"))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v * v))
    # a variable of an outer lambda: inside the inner one the length would be summed again for every component
    return F.transform(F.array(norm), lambda n: F.transform(x, lambda v: F.coalesce(F.try_divide(v, n), v)))[0], norm > 0


def nearest_cosine(
    queries: DataFrame, points: DataFrame, k: int, query_id: str, point_id: str, vector: str,
    exclude_same: bool = False, block: int = BLOCK,
) -> DataFrame:
    """(query_id, neighbour, score, rank) by cosine; ``score = 1 - cosine distance``.

    A vector of zeros, as of a blank text, has the score 0 with every other one: such points come in with that score, lowest ids
    first, and such queries get the lowest ids. Null vectors and null components are an error.
    """
    unit, nonzero = unit_vector(F.col(vector))
    q = write_and_read(queries.select(query_id, unit.alias(vector), F.coalesce(nonzero, F.lit(True)).alias("_some")))
    p = write_and_read(points.select(point_id, unit.alias(vector), F.coalesce(nonzero, F.lit(True)).alias("_some")))
    out = nearest(q.filter("_some"), p.filter("_some"), k, query_id, point_id, vector, exclude_same, block)
    score = F.lit(1.0) - F.col("distance") * F.col("distance") / 2
    scored = out.select(F.col(query_id).alias("_q"), "neighbour", score.alias("score"))

    def lowest(frame: DataFrame) -> DataFrame:  # k + 1 ids in one row
        return frame.select(point_id).orderBy(point_id).limit(k + 1).agg(F.collect_list(point_id).alias("_ids"))

    blank = p.filter("not _some")
    for side, ids in ((q.filter("_some"), lowest(blank)), (q.filter("not _some"), lowest(p))):
        zero = side.select(F.col(query_id).alias("_q"), F.explode(ids.scalar()).alias("neighbour")).withColumn("score", F.lit(0.0))
        scored = scored.unionByName(zero)
    if exclude_same:
        scored = scored.filter(F.col("_q") != F.col("neighbour"))
    rank = F.row_number().over(W.partitionBy("_q").orderBy(F.desc(F.round("score", DIGITS)), "neighbour"))
    ranked = scored.withColumn("rank", rank).filter(F.col("rank") <= k)
    return ranked.select(F.col("_q").alias(query_id), "neighbour", "score", "rank")
