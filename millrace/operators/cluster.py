"""Clustering and its evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import product
from math import floor, sqrt

import numpy as np
import pandas as pd
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from millrace.operators.blocks import BLOCK, TURN, block_pairs, packed_vectors, pair_blocks, salted_lookup, shuffled
from millrace.operators.leaves import ROWS, Leaves, dimensions, extent, squared_gap
from millrace.operators.neighbours import VECTOR, batches, distances, stack
from millrace.operators.ordering import ordered_index
from millrace.session import cut_lineage, write_and_read

MAX_CLUSTERS = 4_096
NOISE = -1


# --- k-means ----------------------------------------------------------------------------------------------

def kmeans(
    df: DataFrame, features: Sequence[str], k: int = 4, restarts: int = 10, seed: int = 24, rounds: int = 100
) -> tuple[DataFrame, DataFrame]:
    """(labelled rows, centres): of all restarts the one with the lowest sum of squared distances. The rows get ``cluster``;
    centres are (cluster, features, size, cost), in order of their features.

    All restarts go through the table together: a scan assigns every row to the nearest centre of each restart and returns
    one row of partial sums for each centre and task, so the table is read once a round whatever their number. Equal rows are
    one row of that table, with their number. A restart whose
    assignment has settled leaves the scans. Its first centres are drawn from all rows, one a scan, the next one always with a
    probability in proportion to the squared distance to those there are. Rows whose features are null or not numbers are an
    error. With fewer than ``k`` different rows there are fewer centres.
    """
    spark, d = df.sparkSession, len(features)
    vector = F.array(*[F.col(f).cast("double") for f in features])
    # equal rows are one with their number: rounds go over the different rows only
    counted = df.select(vector.alias("_v")).groupBy("_v").agg(F.count("*").alias("_n"))
    rows = write_and_read(counted.withColumn("_h", F.xxhash64("_v")))
    dimensions(rows)
    live = {i: np.zeros((0, d)) for i in range(restarts)}
    for _ in range(k):
        for r in _drawn(rows, live, d, seed).collect():  # one row a restart; none if all rows are centres
            live[r["restart"]] = np.vstack([live[r["restart"]], r["best"]["_v"]])
    if not all(map(len, live.values())):
        centres = spark.createDataFrame([], _centre_schema(features))
        return df.withColumn("cluster", F.lit(None).cast("int")), centres
    best: tuple[float, int, np.ndarray, np.ndarray, np.ndarray] | None = None
    for turn in range(rounds):
        sums = {i: np.zeros((len(c), d + 2)) for i, c in live.items()}
        for r in _partial_sums(rows, live, d).collect():  # one row a restart and centre
            sums[r["restart"]][r["cluster"]] = [r["n"], r["cost"], *r["total"]]
        for i, s in sums.items():
            moved = np.where(s[:, :1] > 0, s[:, 2:] / np.maximum(s[:, :1], 1), live[i])
            settled = np.allclose(moved, live[i], rtol=1e-12, atol=0) or turn == rounds - 1
            if settled:
                cost = float(s[:, 1].sum())
                if best is None or (cost, i) < best[:2]:
                    best = cost, i, live[i], s[:, 0], s[:, 1]
                del live[i]
            else:
                live[i] = moved
        if not live:
            break
    _, _, centre, size, cost = best
    order = np.lexsort(centre.T[::-1])
    centre, size, cost = centre[order], size[order], cost[order]
    gaps = [sum(((F.col(f).cast("double") - F.lit(float(x))) ** 2 for f, x in zip(features, c)), F.lit(0.0)) for c in centre]
    labelled = df.withColumn("_gaps", F.array(*gaps)).withColumn(
        "cluster", (F.array_position("_gaps", F.array_min("_gaps")) - 1).cast("int")).drop("_gaps")
    table = [(i, *map(float, c), int(n), float(x)) for i, (c, n, x) in enumerate(zip(centre, size, cost))]
    return labelled, spark.createDataFrame(table, _centre_schema(features))


def _centre_schema(features: Sequence[str]) -> str:
    return "cluster int, " + ", ".join(f"`{f}` double" for f in features) + ", size long, cost double"


def _drawn(rows: DataFrame, centres: dict[int, np.ndarray], d: int, seed: int) -> DataFrame:
    """(restart, best): for every restart a row drawn from all, with a probability in proportion to its number and its squared
    distance to the nearest of the restart's centres; ``best`` has its features ``_v``.

    Every row waits a time with an exponential distribution of that rate, made from a hash of its features, and the first one is
    drawn. A task returns its first rows alone, and which is first of all does not depend on the tasks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first: dict[int, tuple[float, list[float]]] = {}
        for pdf in frames:
            for s in batches(len(pdf), max(map(len, centres.values()))):
                v, n, hashed = stack(pdf["_v"].iloc[s]), pdf["_n"].to_numpy()[s].astype(float), pdf["_h"].to_numpy()[s].astype("u8")
                for i, c in centres.items():
                    rate = n * (distances(v, c).min(axis=1) ** 2 if len(c) else 1.0)
                    wait = np.full(len(v), np.inf)
                    np.divide(-np.log(_uniform(hashed, seed, i, len(c))), rate, out=wait, where=rate > 0)
                    at = int(wait.argmin())
                    found = float(wait[at]), v[at].tolist()
                    if np.isfinite(found[0]) and (i not in first or found < first[i]):
                        first[i] = found
        yield pd.DataFrame([(i, *found) for i, found in first.items()], columns=["restart", "wait", "_v"])

    parts = rows.mapInPandas(run, "restart int, wait double, _v array<double>")
    return parts.groupBy("restart").agg(F.min(F.struct("wait", "_v")).alias("best"))


def _uniform(hashed: np.ndarray, *keys: int) -> np.ndarray:
    """Draws between 0 and 1 from hashes, others for other keys."""
    salt = np.random.SeedSequence(keys).generate_state(1, "u8")[0]
    x = hashed ^ salt
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53) + 1 / (1 << 54)


def _partial_sums(rows: DataFrame, centres: dict[int, np.ndarray], d: int) -> DataFrame:
    """(restart, cluster, n, cost, total) over all rows, ``_n`` of each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {i: np.zeros((len(c), d + 2)) for i, c in centres.items()}
        for pdf in frames:
            for s in batches(len(pdf), max(map(len, centres.values()))):
                v, n = stack(pdf["_v"].iloc[s]), pdf["_n"].to_numpy()[s].astype(float)
                for i, c in centres.items():
                    gap = distances(v, c)
                    near = gap.argmin(axis=1)
                    cost = gap[np.arange(len(v)), near] ** 2
                    for j, column in enumerate((n, n * cost, *(n * v.T))):
                        sums[i][:, j] += np.bincount(near, column, len(c))
        out = [(i, j, int(row[0]), row[1], row[2:].tolist()) for i, s in sums.items() for j, row in enumerate(s) if row[0]]
        yield pd.DataFrame(out, columns=["restart", "cluster", "n", "cost", "total"])

    parts = rows.mapInPandas(run, "restart int, cluster int, n long, cost double, total array<double>")
    totals = F.array(*[F.sum(F.col("total")[j]) for j in range(d)]).alias("total")
    return parts.groupBy("restart", "cluster").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), totals)


# --- hierarchical -----------------------------------------------------------------------------------------

def ward_merges(centres: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, float, int]]:
    """(left, right, height, size) of Ward's method on weighted centroids; node ``m + i`` is merge ``i``.

    Every row keeps its cheapest partner; a merge looks again only at rows whose partner it took."""
    m = len(centres)
    ids = np.arange(m)
    points, weight = centres.astype(float).copy(), sizes.astype(float).copy()
    cost = np.stack([_ward(points, weight, points[i], weight[i]) for i in range(m)]) if m else np.zeros((0, 0))
    np.fill_diagonal(cost, np.inf)
    partner = cost.argmin(axis=1) if m else np.zeros(0, int)
    merges = []
    for step in range(m - 1):
        rows = np.arange(m)
        i = int(cost[rows, partner].argmin())
        a, b = sorted((i, int(partner[i])))
        height, total = sqrt(cost[a, b]), weight[a] + weight[b]
        left, right = sorted((int(ids[a]), int(ids[b])))
        merges.append((left, right, height, int(total)))
        points[a] = (points[a] * weight[a] + points[b] * weight[b]) / total
        weight[a], ids[a] = total, m + step
        weight[b] = np.inf
        cost[b, :], cost[:, b] = np.inf, np.inf
        fresh = np.where(np.isinf(weight), np.inf, _ward(points, np.where(np.isinf(weight), 1.0, weight), points[a], total))
        fresh[a] = np.inf
        cost[a, :], cost[:, a] = fresh, fresh
        again = np.flatnonzero(((partner == a) | (partner == b)) & np.isfinite(weight))
        partner[again] = cost[again].argmin(axis=1)
        partner[a] = fresh.argmin()
        closer = fresh < cost[rows, partner]
        partner[closer] = a
    return merges


def _ward(points: np.ndarray, weight: np.ndarray, point: np.ndarray, own: float) -> np.ndarray:
    """Squared Ward distances of clusters to one; the same bits whichever of two clusters is asked."""
    gap = np.zeros(len(points))
    for j in range(points.shape[1]):
        gap += (points[:, j] - point[j]) ** 2
    return 2 * gap * (weight * own) / (weight + own)


FINISH = 2_048  # clusters that one task merges to the end
NUMBER = 1 << 40  # cluster ids: round of the merge times this, plus the lowest leaf


def hierarchical(
    df: DataFrame, features: Sequence[str], id: str, k: int = 4, finish: int = FINISH, rows: int = ROWS
) -> tuple[DataFrame, DataFrame]:
    """(labelled rows, merge table) of Ward clustering: the rows with ``cluster``, numbered by their lowest row in order of
    ``id``, and (step, left, right, height, size) of all n - 1 merges; leaves are numbered in order of ``id``, merge i is node
    n + i. ``ward_table`` gives the merges alone, without the rounds that label the rows.
    """
    numbered, spots, tree, n, table = _ward_tree(df, features, id, finish, rows)
    several = spots.count()
    if several >= k:  # merges of equal rows come first and are all below the cut, so equal rows share a cluster
        leaves = spots.select(F.col("c").alias("node"), F.col("rep").alias("low"), "_v")
        kept = tree.filter((F.col("place") >= n - several) & (F.col("place") < n - k))
    else:
        leaves = numbered.select(F.col("leaf").alias("node"), F.col("leaf").alias("low"), "_id")
        kept = tree.filter(F.col("place") < n - k)
    found = leaves.join(shuffled(_roots(kept)), "node", "left").withColumn("root", F.coalesce("root", "node"))
    found = write_and_read(found.drop("node"))
    order = ordered_index(found.groupBy("root").agg(F.min("low").alias("_low")), ["_low"], "cluster")
    label = found.join(order.select("root", F.col("cluster").cast("int").alias("cluster")), "root").drop("root", "low")
    if several >= k:
        vector = F.array(*[F.col(f).cast("double") for f in features])
        labelled = df.withColumn("_v", vector).join(write_and_read(label), "_v").drop("_v")
    else:
        labelled = df.join(write_and_read(label.withColumnRenamed("_id", id)), id)
    return labelled.select(*df.columns, "cluster"), write_and_read(table)


def _roots(kept: DataFrame) -> DataFrame:
    """(node, root): for every node merged in ``kept`` the last merge above it. Each round a node takes the place its own place has
    reached, so the rounds are the logarithm of the tree's depth."""
    up = write_and_read(kept.select(F.explode(F.array("a", "b")).alias("node"), F.col("c").alias("root")))
    while True:
        above = up.select(F.col("node").alias("root"), F.col("root").alias("_root"))
        up = write_and_read(up.join(shuffled(above), "root", "left").select(
            "node", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("_moved")))
        if up.filter("_moved").isEmpty():
            return up.drop("_moved")
        up = up.drop("_moved")


def ward_table(df: DataFrame, features: Sequence[str], id: str, finish: int = FINISH, rows: int = ROWS) -> DataFrame:
    """(step, left, right, height, size): the merge table of ``hierarchical``."""
    return _ward_tree(df, features, id, finish, rows)[-1]


def _ward_tree(
    df: DataFrame, features: Sequence[str], id: str, finish: int, rows: int
) -> tuple[DataFrame, DataFrame, DataFrame, int, DataFrame]:
    """The rows numbered in order of ``id``, the different rows as clusters of their equals, the merges in order, the number of rows, and
    the merge table.

    Ward distances never fall below those of what was merged, so clusters that are each other's nearest can be merged at once
    without changing the tree: a round finds every cluster's nearest one and merges all such pairs, and the merges are put in
    order of height at the end. Equal rows are merged first, at height 0. The nearest cluster is first looked for among the
    clusters of the same leaf of a tree over the centroids, then in leaves that may hold a nearer one. Once ``finish`` clusters
    are left, one task does the remaining merges; the result does not depend on it.
    """
    spark = df.sparkSession
    vector = F.array(*[F.col(f).cast("double") for f in features])
    numbered = ordered_index(df.select(F.col(id).alias("_id"), vector.alias("_v")), ["_id"], "leaf")
    dims = dimensions(numbered)
    spots = write_and_read(numbered.groupBy("_v").agg(F.count("*").alias("w"), F.min("leaf").alias("rep"), F.max("leaf").alias("last")))
    n, same = spots.agg(F.coalesce(F.sum("w"), F.lit(0)), F.coalesce(F.max("w"), F.lit(0))).first()
    merges = [_equal_rows(numbered, spots)] if same > 1 else []
    alone = F.col("w") == 1
    live = spots.select(
        F.when(alone, F.col("rep")).otherwise(-F.col("last") - 1).alias("c"), "rep", F.col("w").cast("double").alias("w"),
        F.lit(0.0).alias("h"), "_v")
    live, count, step = write_and_read(live), spots.count(), 1
    alike = live
    while count > max(finish, 1):
        found = write_and_read(_mutual(live, dims, rows, step))
        merges.append(found.select("c", "a", "b", "height", F.col("w").cast("long").alias("size"), F.lit(step).cast("long").alias("step"), F.col("rep").alias("tie")))
        gone = found.select(F.explode(F.array("a", "b")).alias("c"))
        live = write_and_read(live.join(shuffled(gone), "c", "left_anti").unionByName(found.select("c", "rep", "w", F.col("height").alias("h"), "_v")))
        count, step = live.count(), step + 1
    if count > 1:
        merges.append(_rest(live, step))
    schema = "c long, a long, b long, height double, size long, step long, tie long"
    found = spark.createDataFrame([], schema)
    for part in merges:
        found = found.unionByName(part)
    tree = write_and_read(ordered_index(write_and_read(found), ["height", "step", "tie"], "place"))
    names = tree.select(F.col("c").alias("_c"), (F.col("place") + n).alias("_node"))
    table = tree
    for side in ("a", "b"):
        node = names.withColumnsRenamed({"_c": side, "_node": f"_{side}"})
        table = table.join(shuffled(node), side, "left").withColumn(f"_{side}", F.coalesce(f"_{side}", side))
    table = table.select(
        F.col("place").alias("step"), F.least("_a", "_b").alias("left"), F.greatest("_a", "_b").alias("right"), "height", "size")
    return numbered, alike, tree, n, table


def _equal_rows(numbered: DataFrame, spots: DataFrame) -> DataFrame:
    """Merges of equal rows, one more row at a time. A position in one order of all rows stands in for a window over a group,
    which may hold any share of the table."""
    several = numbered.join(shuffled(spots.filter("w > 1")), "_v")
    placed = write_and_read(ordered_index(several.select("_v", "leaf", "rep"), ["_v", "leaf"], "_at"))
    start = placed.groupBy("rep").agg(F.min("_at").alias("_start"))
    before = placed.select((F.col("_at") + 1).alias("_at"), F.col("leaf").alias("_before"))
    ranked = placed.join(shuffled(write_and_read(start)), "rep").filter("_at > _start").join(shuffled(before), "_at")
    size = F.col("_at") - F.col("_start") + 1
    return ranked.select(
        (-F.col("leaf") - 1).alias("c"), F.when(size == 2, F.col("rep")).otherwise(-F.col("_before") - 1).alias("a"),
        F.col("leaf").alias("b"), F.lit(0.0).alias("height"), size.alias("size"), F.lit(0).cast("long").alias("step"), F.col("_at").alias("tie"))


def _mutual(live: DataFrame, dims: int, rows: int, step: int) -> DataFrame:
    """(c, a, b, height, rep, w, _v) of the pairs of clusters that are each other's nearest. A height that rounds below one of a
    merge inside (``h``) takes that, so that merges follow those they contain."""
    tree = Leaves.build(live, dims, rows, least="w")
    schema = "c long, other long, cost double"

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        """The cheapest partner in ``b`` of every cluster in ``a``; of equal ones the pair with the lowest ids."""
        out = {"c": [], "other": [], "cost": []}
        if len(a) and len(b):
            b = b.sort_values("c")
            points, weight, ids = stack(b["_v"]), b["w"].to_numpy(), b["c"].to_numpy()
            for c, w, v in zip(a["c"], a["w"], stack(a["_v"])):
                cost = np.where(ids == c, np.inf, _ward(points, weight, v, w))
                i = int(cost.argmin())
                if np.isfinite(cost[i]):
                    out["c"].append(c), out["other"].append(ids[i]), out["cost"].append(cost[i])
        return pd.DataFrame(out).astype({"c": "int64", "other": "int64", "cost": "float64"})

    own = write_and_read(tree.points.groupBy("_leaf").applyInPandas(lambda pdf: best(pdf, pdf), schema))
    far = _in_other_leaves(tree, own, best, schema) if tree.cuts else own.limit(0)
    order = F.struct("cost", F.least("c", "other"), F.greatest("c", "other"), "other")
    nearest = write_and_read(own.unionByName(far).groupBy("c").agg(F.min(order).alias("_best")).select("c", "_best.other", "_best.cost"))
    back = nearest.select(F.col("c").alias("other"), F.col("other").alias("c"))
    mutual = nearest.join(shuffled(back), ["c", "other"]).filter("c < other").select(F.col("c").alias("a"), F.col("other").alias("b"), "cost")
    for side in ("a", "b"):
        ends = live.select(F.col("c").alias(side), *[F.col(x).alias(f"{x}_{side}") for x in ("rep", "w", "h", "_v")])
        mutual = mutual.join(shuffled(ends), side)
    total = F.col("w_a") + F.col("w_b")
    centre = F.zip_with("_v_a", "_v_b", lambda x, y: (x * F.col("w_a") + y * F.col("w_b")) / total)
    rep = F.least("rep_a", "rep_b")
    return mutual.select(
        (F.lit(step) * F.lit(NUMBER) + rep).alias("c"), "a", "b", F.greatest(F.sqrt("cost"), "h_a", "h_b").alias("height"),
        rep.alias("rep"), total.alias("w"), centre.alias("_v"))


def _in_other_leaves(tree: Leaves, own: DataFrame, best: Callable, schema: str) -> DataFrame:
    """The best partners in the leaves that may hold a cheaper one than a cluster's own leaf."""
    known = write_and_read(tree.points.join(shuffled(own.select("c", "cost")), "c", "left").withColumn("cost", F.coalesce("cost", F.lit(float("inf")))))
    groups = extent(known, tree.dims, ["_leaf"], F.max("cost").alias("cost"), F.min("w").alias("w"))
    slack = 1 + 1e-9

    def least_cost(gap: Column, w: Column, other: Column) -> Column:
        return 2 * gap * (w * other) / (w + other)

    pairs = tree.reached(groups, lambda gap: least_cost(gap, F.col("w"), F.col("node_least")) <= F.col("cost") * slack)
    near = least_cost(squared_gap(F.col("_v"), F.col("_v"), F.col("box_lo"), F.col("box_hi")), F.col("w"), F.col("box_least"))
    routed = shuffled(known).join(write_and_read(pairs).filter("_leaf <> _cell"), "_leaf").join(tree.boxes(), "_cell").filter(
        near <= F.col("cost") * slack).select("c", "w", "_v", "_cell")
    left, right = pair_blocks(write_and_read(routed), tree.points.select("c", "w", "_v", F.col("_leaf").alias("_cell")), ["_cell"], "c", "c")
    keys = ["_cell", "_lb", "_rb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, schema)


def _rest(live: DataFrame, step: int) -> DataFrame:
    """The remaining merges, of few clusters, in one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        ids, reps, heights = pdf["c"].tolist(), pdf["rep"].tolist(), pdf["h"].tolist()
        out = []
        for i, (left, right, height, size) in enumerate(ward_merges(stack(pdf["_v"]), pdf["w"].to_numpy())):
            rep = min(reps[left], reps[right])
            ids.append((step + i) * NUMBER + rep)
            reps.append(rep)
            heights.append(max(height, heights[left], heights[right]))
            out.append((ids[-1], ids[left], ids[right], heights[-1], size, step + i, rep))
        return pd.DataFrame(out, columns=["c", "a", "b", "height", "size", "step", "tie"])

    schema = "c long, a long, b long, height double, size long, step long, tie long"
    return live.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, schema)


# --- DBSCAN -----------------------------------------------------------------------------------------------

def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, comp): smallest node of each connected component, by neighbour minimum and pointer jumping."""
    edges = cut_lineage(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = nodes.select("node", F.col("node").alias("comp"))
    while True:
        ends = labels.withColumnsRenamed({"node": "b", "comp": "_c"})
        heard = edges.join(shuffled(ends), "b").groupBy(F.col("a").alias("node")).agg(F.min("_c").alias("_heard"))
        lower = labels.join(shuffled(heard), "node", "left").select(
            "node", F.col("comp").alias("_old"), F.least("comp", "_heard").alias("comp")
        )
        jump = lower.select(F.col("node").alias("comp"), F.col("comp").alias("_next"))
        moved = lower.join(shuffled(jump), "comp").select("node", "_old", F.col("_next").alias("comp"))
        moved = write_and_read(moved)
        labels = moved.select("node", "comp")
        if moved.filter(F.col("_old") != F.col("comp")).limit(1).count() == 0:
            return labels


def dbscan(df: DataFrame, id: str, features: Sequence[str], eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """(id, cluster, core). Noise is -1; clusters are numbered by their lowest core id; a border point joins the
    lowest-numbered cluster in reach; a neighbour is at most ``eps`` away and every point counts itself.

    Points fall in cells so small that all points of one cell, and of cells that share a face, are neighbours.
    A cell with ``min_samples`` points is therefore all core without comparing anything, and its points are
    connected as one unit. Only points of thin cells look for neighbours, and two cells whose boxes leave it
    open whether they touch are compared point by point only if nothing else connects them already.
    """
    d = len(features)
    side = eps / (2 * sqrt(d)) * (1 - 1e-9)
    per_block = floor(2 * sqrt(d)) + 1  # cells per coarse block edge; a block edge is at least eps long
    axes = min(d, 3)
    xs = [f"_x{i}" for i in range(d)]
    cell = [F.floor(F.col(f) / side).cast("long") for f in features]
    base = df.select(
        F.col(id).alias("_id"),
        *[F.col(f).cast("double").alias(x) for f, x in zip(features, xs)],
        F.concat_ws(",", *cell).alias("_fine"),
        *[F.floor(cell[i] / per_block).cast("long").alias(f"_g{i}") for i in range(axes)],
    )
    base = cut_lineage(base)
    grid = [f"_g{i}" for i in range(axes)]
    steps = F.array(*[F.struct(*[F.lit(o).alias(f"o{i}") for i, o in enumerate(offset)])
                      for offset in product((-1, 0, 1), repeat=axes)])

    def around(frame):
        near = frame.withColumn("_o", F.explode(steps))
        return near.withColumn("_at", F.concat_ws(",", *[F.col(g) + F.col("_o")[f"o{i}"] for i, g in enumerate(grid)]))

    def home(frame):
        return frame.withColumn("_at", F.concat_ws(",", *grid))

    def gap(left, right):
        return sum(((F.col(f"{left}{x}") - F.col(f"{right}{x}")) ** 2 for x in xs), F.lit(0.0))

    def meet(left, right):
        """Pairs within eps, columns prefixed l / r."""
        left = around(left).drop("_o", *grid)
        right = home(right).drop(*grid)
        left = left.withColumnsRenamed({c: f"l{c}" for c in left.columns if c != "_at"})
        right = right.withColumnsRenamed({c: f"r{c}" for c in right.columns if c != "_at"})
        left, right = pair_blocks(left, right, ["_at"], "l_id", "r_id")
        return left.join(right, ["_at", "_lb", "_rb"]).filter(gap("l", "r") <= eps * eps)

    # Thin cells, found without gathering the full ones: at most min_samples rows per cell pass the rank filter.
    by_cell = W.partitionBy("_fine")
    few = base.withColumn("_n", F.row_number().over(by_cell.orderBy("_id"))).filter(F.col("_n") <= min_samples)
    thin = cut_lineage(few.withColumn("_n", F.max("_n").over(by_cell)).filter(F.col("_n") < min_samples).drop("_n"))
    counts = meet(thin.select("_id", *xs, *grid), base.select("_id", *xs, *grid)).groupBy(F.col("l_id").alias("_id"))
    thin_core = counts.count().filter(F.col("count") >= min_samples).select("_id")
    other = cut_lineage(thin.join(thin_core, "_id", "left_anti"))
    core = base.join(other.select("_id"), "_id", "left_anti")

    boxes = core.groupBy("_fine", *grid).agg(
        F.count("*").alias("_size"), F.min("_id").alias("_first"),
        *[f(x).alias(f"{n}{x}") for x in xs for n, f in (("lo", F.min), ("hi", F.max))],
    )
    boxes = cut_lineage(boxes)
    left = around(boxes).drop("_o", *grid)
    right = home(boxes).drop(*grid)
    left = left.withColumnsRenamed({c: f"l{c}" for c in left.columns if c != "_at"})
    right = right.withColumnsRenamed({c: f"r{c}" for c in right.columns if c != "_at"})
    left, right = pair_blocks(left, right, ["_at"], "l_fine", "r_fine")

    def far(x):
        return F.greatest(F.abs(F.col(f"lhi{x}") - F.col(f"rlo{x}")), F.abs(F.col(f"rhi{x}") - F.col(f"llo{x}")))

    def close(x):
        return F.greatest(F.col(f"llo{x}") - F.col(f"rhi{x}"), F.col(f"rlo{x}") - F.col(f"lhi{x}"), F.lit(0.0))

    squared = lambda part: sum((part(x) ** 2 for x in xs), F.lit(0.0))
    touching = left.join(right, ["_at", "_lb", "_rb"]).filter(F.col("l_fine") < F.col("r_fine"))
    # The lower bound is widened by a rounding error, the upper one narrowed: neither may decide a tie.
    touching = touching.select(
        F.col("l_fine").alias("a"), F.col("r_fine").alias("b"), squared(far).alias("_far"), squared(close).alias("_close")
    ).filter(F.col("_close") <= eps * eps * (1 + 1e-9))
    touching = cut_lineage(touching)
    sure = F.col("_far") <= eps * eps * (1 - 1e-9)
    nodes = boxes.select(F.col("_fine").alias("node"))
    first = components(touching.filter(sure).select("a", "b"), nodes)
    side_a = first.withColumnsRenamed({"node": "a", "comp": "_ca"})
    side_b = first.withColumnsRenamed({"node": "b", "comp": "_cb"})
    unsure = touching.filter(~sure).join(side_a, "a").join(side_b, "b").filter(F.col("_ca") != F.col("_cb"))
    unsure = cut_lineage(unsure.select("a", "b", "_ca", "_cb"))
    la = unsure.join(core.select(F.col("_fine").alias("a"), F.col("_id").alias("l_id"),
                                 *[F.col(x).alias(f"l{x}") for x in xs]), "a")
    rb = unsure.select("a", "b").join(core.select(F.col("_fine").alias("b"), F.col("_id").alias("r_id"),
                                                  *[F.col(x).alias(f"r{x}") for x in xs]), "b")
    la, rb = pair_blocks(la, rb, ["a", "b"], "l_id", "r_id")
    linked = la.join(rb, ["a", "b", "_lb", "_rb"]).filter(gap("l", "r") <= eps * eps)
    linked = linked.select(F.col("_ca").alias("a"), F.col("_cb").alias("b")).distinct()
    second = components(linked, first.select(F.col("comp").alias("node")).distinct())
    merged = first.join(second.select(F.col("node").alias("comp"), F.col("comp").alias("_root")), "comp")
    cells = boxes.join(merged.select(F.col("node").alias("_fine"), "_root"), "_fine")
    order = cells.groupBy("_root").agg(F.min("_first").alias("_lowest"))
    order = ordered_index(order, ["_lowest"], "_number").select("_root", F.col("_number").cast("int").alias("cluster"))
    cells = cut_lineage(cells.join(order, "_root").select("_fine", "_size", "cluster"))

    labelled = salted_lookup(core, cells, "_fine", "_size", "_id")
    reach = meet(other.select("_id", *xs, *grid), labelled.select("_id", "cluster", *xs, *grid))
    border = reach.groupBy(F.col("l_id").alias("_id")).agg(F.min("rcluster").alias("cluster"))
    rest = other.join(border, "_id", "left").select(
        F.col("_id").alias(id), F.coalesce("cluster", F.lit(NOISE)).alias("cluster"), F.lit(0).alias("core")
    )
    return labelled.select(F.col("_id").alias(id), "cluster", F.lit(1).alias("core")).unionByName(rest)


def cluster_counts(df: DataFrame, label: str = "cluster") -> DataFrame:
    """(n_clusters, n_noise), noise not being a cluster."""
    return df.agg(
        F.count_distinct(F.when(F.col(label) != NOISE, F.col(label))).alias("n_clusters"),
        F.count_if(F.col(label) == NOISE).alias("n_noise"),
    )


def cluster_sizes(df: DataFrame, label: str = "cluster") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("size"))


# --- silhouette -------------------------------------------------------------------------------------------

PAIRS = 128  # tasks that the pairs of blocks are dealt to, or more
CELLS = 256  # clusters whose sums a task holds for a block at a time
TILE = 256  # rows and columns of the distances made at a time
CLOSE = 1e-4  # squared distances below this share of the vectors' own squares are taken from the differences


def distance_sums(x: np.ndarray, y: np.ndarray, start: np.ndarray, start_x: np.ndarray | None = None) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    """For all rows of ``x`` the sums of their Euclidean distances to the runs of rows of ``y`` that begin at ``start``; with
    ``start_x`` also those of all rows of ``y`` to the runs of ``x``, from the same distances. They are made in tiles that stay in a
    core's cache. A matrix product gives the squares; where little is left of them it would be rounding, and the differences are taken."""
    middle = x.mean(axis=0)
    a, b = x - middle, y - middle
    aa, bb = (a * a).sum(axis=1, keepdims=True), (b * b).sum(axis=1, keepdims=True)
    close = CLOSE * (aa.max() + bb.max())
    left, right = np.hstack([-2 * a, aa, np.ones_like(aa)]), np.hstack([b, np.ones_like(bb), bb])
    name_x, name_y = (np.searchsorted(s, np.arange(len(v)), "right") - 1 for s, v in ((np.zeros(1) if start_x is None else start_x, x), (start, y)))
    rows = np.zeros((len(x), len(start)))
    columns = None if start_x is None else np.zeros((len(y), len(start_x)))
    for i in range(0, len(x), TILE):
        for j in range(0, len(y), TILE):
            squared = left[i : i + TILE] @ right[j : j + TILE].T
            cells = np.flatnonzero(squared <= close)
            if len(cells):
                r, c = i + cells // squared.shape[1], j + cells % squared.shape[1]
                exact = np.zeros(len(cells))
                for k in range(x.shape[1]):
                    exact += (x[r, k] - y[c, k]) ** 2
                squared.ravel()[cells] = exact
            gap = np.sqrt(squared, out=squared)
            for out, at, own, names, turned in ((rows, i, name_y, j, gap), (columns, j, name_x, i, gap.T)):
                if out is not None:
                    run = own[names : names + turned.shape[1]]
                    first, last = run[0], run[-1] + 1
                    if last - first == 1:
                        out[at : at + TILE, first] += turned @ np.ones(len(run))
                    else:
                        begun = np.searchsorted(run, np.arange(first, last))
                        out[at : at + TILE, first:last] += np.add.reduceat(turned, begun, axis=1)
    return rows if start_x is None else (rows, columns)


def silhouette_samples(
    df: DataFrame, id: str, vector: str, label: str, block: int = BLOCK, max_clusters: int = MAX_CLUSTERS
) -> DataFrame:
    """(id, label, silhouette) on Euclidean distance; single-member clusters give 0.

    A point's mean distance to a cluster lies between its distance to the centroid and the root mean squared
    distance, both known from the centroids. Points are packed in blocks in order of their label; a block meets only blocks of its own
    clusters and of those that can still be the nearest other one of a point in it. Two blocks meet once, and their distances, which
    come from matrix products, count for the points of both; a task returns one sum for each point of its left block and cluster of
    all the blocks it went through, and for each point of those and cluster of the left one. With more than ``max_clusters`` clusters
    the centroids are not sent out and every block is visited.
    """
    id_type, label_type = df.schema[id].dataType, df.schema[label].dataType
    rows = write_and_read(df.select(
        F.col(id).alias("_id"), F.col(label).alias("_k"), F.col(vector).cast("array<double>").alias("_v")
    ))
    one = rows.select("_v").first()
    dims = len(one["_v"]) if one else 0
    square = F.aggregate("_v", F.lit(0.0), lambda s, x: s + x * x)
    stats = write_and_read(rows.groupBy("_k").agg(
        F.count("*").alias("n"), F.avg(square).alias("sq"),
        F.array(*[F.avg(F.col("_v")[i]) for i in range(dims)]).alias("mean"),
    ))
    known = stats.limit(max_clusters + 1).collect()  # bounded by max_clusters
    pruned = 0 < len(known) <= max_clusters
    parts = max(1, -(-rows.count() // block))
    dealt = rows.repartitionByRange(parts, "_k", F.xxhash64("_id")).sortWithinPartitions("_k")
    blocks = packed_vectors(dealt, ["_id", "_k"], block).withColumn("cells", F.array_distinct("_k"))
    near = blocks
    if pruned:
        known = sorted(known, key=lambda r: r["_k"])
        keys = np.array([r["_k"] for r in known])
        centre = np.array([r["mean"] for r in known])
        spread = np.array([max(r["sq"] - sum(x * x for x in r["mean"]), 0.0) for r in known])

        @F.pandas_udf(T.ArrayType(label_type))
        def candidates(labels: pd.Series, vectors: pd.Series) -> pd.Series:
            """The clusters that points of a block are in or can be nearest to."""
            out = []
            for k, v in zip(labels, vectors):
                x, reached = np.frombuffer(v).reshape(len(k), -1), np.zeros(len(keys), bool)
                for s in batches(len(x), len(keys)):
                    low = distances(x[s], centre)
                    own = np.array(list(k[s]))[:, None] == keys[None, :]
                    high = np.where(own, np.inf, np.sqrt(low**2 + spread))
                    reached |= (own | (low <= high.min(axis=1, keepdims=True) + 1e-9 * (1 + low))).any(axis=0)
                out.append(keys[reached].tolist())
            return pd.Series(out)

        near = write_and_read(blocks.withColumn("wanted", candidates("_k", "v")))
    near = near.withColumnsRenamed({"_id": "id", "_k": "k"})
    apart = F.col("block_a") - F.col("block_b")
    # one of (a, b) and (b, a), dealt evenly over the tasks
    meets = (apart == 0) | ((apart < 0) == (F.pmod(F.xxhash64(F.least("block_a", "block_b"), F.greatest("block_a", "block_b")), F.lit(2)) == 0))
    if pruned:
        meets &= F.arrays_overlap("wanted_a", "cells_b") | F.arrays_overlap("wanted_b", "cells_a")
    pairs = block_pairs(near, near, meets, max(1, min(TURN, near.count() ** 2 // PAIRS)))
    met = pairs.select(*[f"{c}_{side}" for c in ("block", "id", "k", "v", *["wanted"] * pruned) for side in "ab"])

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, {}

        def total(ids: np.ndarray, own: np.ndarray, found: dict) -> Iterator[pd.DataFrame]:
            for name, value in found.items():
                yield pd.DataFrame({"_id": ids, "_own": own, "_k": name, "_sum": value})

        def runs(labels: np.ndarray, wanted: Sequence | None) -> tuple[list, np.ndarray, np.ndarray]:
            """The labels, where each begins, and which are wanted."""
            names, start = np.unique(labels, return_index=True)
            return names.tolist(), start, np.ones(len(names), bool) if wanted is None else np.isin(names, np.array(list(wanted)))

        def some(v: np.ndarray, labels: np.ndarray, names: list, asked: np.ndarray) -> tuple[np.ndarray, list, np.ndarray]:
            """The rows of the labels asked for, those labels and where each begins."""
            chosen = np.array(names)[asked]
            rows = np.isin(labels, chosen)
            return v[rows], chosen.tolist(), np.searchsorted(labels[rows], chosen)

        for pdf in frames:
            for r in pdf.itertuples():
                if r.block_a != at:
                    if held:
                        yield from total(ids, own, held)
                    at, held = r.block_a, {}
                    ids, own = np.array(list(r.id_a)), np.array(list(r.k_a))
                    x = np.frombuffer(r.v_a).reshape(len(ids), -1)
                other = np.array(list(r.k_b))
                y = np.frombuffer(r.v_b).reshape(len(other), -1)
                names, start, asked = runs(other, r.wanted_a if pruned else None)
                names_a, start_a, asked_a = runs(own, r.wanted_b if pruned else None)
                gained, back = [], []
                if r.block_b == at or not asked_a.any():
                    y, chosen, start = some(y, other, names, asked)
                    gained = zip(chosen, distance_sums(x, y, start).T)
                elif not asked.any():
                    x_b, chosen, start_a = some(x, own, names_a, asked_a)
                    back = zip(chosen, distance_sums(y, x_b, start_a).T)
                else:
                    rows, columns = distance_sums(x, y, start, start_a)
                    gained = [(n, v) for n, v, ask in zip(names, rows.T, asked) if ask]
                    back = [(n, v) for n, v, ask in zip(names_a, columns.T, asked_a) if ask]
                for name, value in gained:
                    held[name] = held[name] + value if name in held else value
                yield from total(np.array(list(r.id_b)), other, dict(back))
                if len(held) > CELLS:
                    yield from total(ids, own, held)
                    held = {}
        if held:
            yield from total(ids, own, held)

    schema = T.StructType([T.StructField("_id", id_type), T.StructField("_own", label_type)]).add("_k", label_type).add("_sum", "double")
    parts = met.mapInPandas(sums, schema)
    totals = parts.groupBy("_id", "_own", "_k").agg(F.sum("_sum").alias("_sum"))
    totals = totals.join(stats.select("_k", "n"), "_k")
    mine = F.col("_k") == F.col("_own")
    ab = totals.groupBy("_id", "_own").agg(
        F.max(F.when(mine, F.try_divide(F.col("_sum"), F.col("n") - 1))).alias("a"),
        F.min(F.when(~mine, F.col("_sum") / F.col("n"))).alias("b"),
    )
    # No a: the only member of its cluster. No b: there is only one cluster and the score is undefined.
    value = F.when(F.col("b").isNull(), None).when(F.col("a").isNull(), 0.0).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    )
    return ab.select(F.col("_id").alias(id), F.col("_own").alias(label), value.alias("silhouette"))


def silhouette(df: DataFrame, id: str, vector: str, label: str, block: int = BLOCK) -> DataFrame:
    """Mean silhouette; NULL with fewer than two clusters. Work grows with the square of cluster sizes; see
    ``silhouette_squared`` for the linear-time score on squared distance."""
    return silhouette_samples(df, id, vector, label, block).agg(F.avg("silhouette").alias("silhouette"))


def silhouette_squared(df: DataFrame, vector: str, label: str) -> float:
    """Spark's own score, on squared Euclidean distance."""
    rows = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("_f"), F.col(label).cast("int").alias("_k"))
    return ClusteringEvaluator(featuresCol="_f", predictionCol="_k").evaluate(rows)


