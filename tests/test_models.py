"""Neighbours, clustering and regression against brute force."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import functions as F

from millrace.operators import cluster, features, neighbours, regress
from millrace.plans import models


def vectors(spark, x, label=None):
    pdf = pd.DataFrame({"id": np.arange(len(x)), "vec": [list(map(float, r)) for r in x]})
    if label is not None:
        pdf["label"] = label
    return spark.createDataFrame(pdf)


def brute_nearest(q, p, k, skip_same):
    out = set()
    for i, a in enumerate(q):
        d = np.round(np.sqrt(((p - a) ** 2).sum(axis=1)), 9)
        order = [j for j in sorted(range(len(p)), key=lambda j: (d[j], j)) if not (skip_same and j == i)]
        out |= {(i, j, r + 1) for r, j in enumerate(order[:k])}
    return out


@pytest.mark.parametrize("block", [4096, 24, 5])
def test_nearest_equals_brute_force(spark, block):
    """In one leaf, in many, and in leaves with fewer points than are wanted."""
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(150, 3)), np.zeros((60, 3)), rng.integers(0, 3, (60, 3))])  # a third are copies
    df = vectors(spark, x)
    got = neighbours.nearest(df, df, 4, "id", "id", "vec", exclude_same=True, block=block)
    assert {(r["id"], r["neighbour"], r["rank"]) for r in got.collect()} == brute_nearest(x, x, 4, True)


def test_kmeans_reads_equal_rows_once(spark, monkeypatch):
    """Rounds go over different rows; sizes and centres are those of all rows."""
    seen, sums = [], cluster._partial_sums
    monkeypatch.setattr(cluster, "_partial_sums", lambda rows, *a: seen.append(rows.count()) or sums(rows, *a))
    x = [0.0] * 300 + [1.0] * 100 + [10.0] * 50 + [12.0] * 150
    labelled, centres = cluster.kmeans(spark.createDataFrame([(i, v) for i, v in enumerate(x)], "id int, a double"), ["a"], k=2, restarts=4)
    assert set(seen) == {4}
    assert [(round(r["a"], 9), r["size"]) for r in centres.orderBy("cluster").collect()] == [(0.25, 400), (11.5, 200)]
    assert labelled.count() == 600


def test_nearest_of_queries_outside(spark):
    """Queries far from all points and in parts without points."""
    rng = np.random.default_rng(11)
    x, y = rng.normal(size=(120, 2)), rng.normal(size=(25, 2)) * 40
    got = neighbours.nearest(vectors(spark, y), vectors(spark, x), 7, "id", "id", "vec", block=10)
    assert {(r["id"], r["neighbour"], r["rank"]) for r in got.collect()} == brute_nearest(y, x, 7, False)


def test_cosine_of_blank_vectors(spark):
    """Blank vectors score 0 with all others, lowest ids first; in many leaves."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(60, 3))
    x[::7] = 0
    df = vectors(spark, x)
    length = np.linalg.norm(x, axis=1)
    score = (x @ x.T) / np.where(length > 0, length, 1)[:, None] / np.where(length > 0, length, 1)[None]
    want = set()
    for i in range(60):
        best = sorted((j for j in range(60) if j != i), key=lambda j: (-round(score[i, j], 9), j))[:40]
        want |= {(i, j, rank, round(score[i, j], 6) + 0.0) for rank, j in enumerate(best, 1)}
    for block in (4096, 12):
        got = neighbours.nearest_cosine(df, df, 40, "id", "id", "vec", exclude_same=True, block=block).collect()
        assert {(r["id"], r["neighbour"], r["rank"], round(r["score"], 6) + 0.0) for r in got} == want


@pytest.mark.parametrize("block", [4096, 16])
def test_many_dimensions_meet_in_blocks(spark, block):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(size=(90, 24)), np.zeros((3, 24))]) + 1e3  # far from the origin, with copies
    x[40:44] = x[7]
    df = vectors(spark, x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = {(i, j, rank) for i in range(93) for rank, j in enumerate(
        sorted((j for j in range(93) if j != i), key=lambda j: (round(d[i, j], 9), j))[:4], 1)}
    got = neighbours.nearest(df, df, 4, "id", "id", "vec", exclude_same=True, block=block)
    rows = got.collect()
    assert {(r["id"], r["neighbour"], r["rank"]) for r in rows} == want
    assert all(r["distance"] == pytest.approx(d[r["id"], r["neighbour"]], abs=1e-9) for r in rows)


def test_a_task_hands_on_the_closest_of_all_its_blocks(spark):
    df = vectors(spark, np.random.default_rng(9).normal(size=(200, 20))).select(F.col("id").alias("_q"), F.col("vec").alias("_v"))
    pairs = neighbours._by_blocks(df, df.withColumnRenamed("_q", "_p"), 3, "_q long, _p long, distance double", 20)
    assert pairs.count() == 200 * 3  # not three for each of the ten blocks


def test_length_of_a_vector_is_summed_once(spark):
    """Once a component took over a minute for this vector."""
    df = spark.createDataFrame([(1, [2.0] * 40_000)], "id long, vec array<double>").checkpoint()
    start = time.perf_counter()
    unit, some = df.select(*[c.alias(n) for c, n in zip(neighbours.unit_vector(F.col("vec")), ("unit", "some"))]).first()
    assert some and unit[-1] == pytest.approx(0.005) and time.perf_counter() - start < 20


@pytest.mark.parametrize("bad", [None, [1.0, None], [1.0, float("nan")], [1.0]])
def test_broken_vectors_are_an_error(spark, bad):
    df = spark.createDataFrame([(1, [0.5, 0.5]), (2, bad)], "id long, vec array<double>")
    for search in (neighbours.nearest, neighbours.nearest_cosine):
        with pytest.raises(ValueError, match="vectors"):
            search(df, df, 1, "id", "id", "vec").collect()


def test_nearest_with_few_points(spark):
    df = vectors(spark, np.array([[0.0, 0.0], [1.0, 0.0]]))
    got = neighbours.nearest(df, df, 5, "id", "id", "vec")
    assert got.count() == 4


def brute_silhouette(x, label):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    out = []
    for i in range(len(x)):
        same = (label == label[i]) & (np.arange(len(x)) != i)
        if not same.any():
            out.append(0.0)
            continue
        a = d[i, same].mean()
        b = min(d[i, label == k].mean() for k in set(label) - {label[i]})
        out.append((b - a) / max(a, b))
    return np.array(out)


@pytest.mark.parametrize("block,limit", [(4096, 4096), (20, 4096), (20, 2)])
def test_silhouette_equals_brute_force(spark, block, limit):
    rng = np.random.default_rng(2)
    label = rng.integers(0, 6, 140)
    label[0] = 77  # single member
    x = rng.normal(size=(140, 2)) + label[:, None] * 1.5
    got = cluster.silhouette_samples(vectors(spark, x, label), "id", "vec", "label", block, limit).orderBy("id").collect()
    assert np.allclose([r["silhouette"] for r in got], brute_silhouette(x, label))


def test_silhouette_of_copies_far_from_the_origin(spark):
    rng = np.random.default_rng(4)
    label = np.repeat([0, 1, 2], 40)
    x = 1e5 + rng.normal(size=(120, 30)) + label[:, None]
    x[:40:2], x[40:80:3] = x[0], x[0]  # equal rows, in two clusters
    got = cluster.silhouette_samples(vectors(spark, x, label), "id", "vec", "label", 25).orderBy("id").collect()
    assert np.allclose([r["silhouette"] for r in got], brute_silhouette(x, label), atol=1e-9)
    same = cluster.silhouette_samples(vectors(spark, np.full((30, 3), 0.1), np.arange(30) % 2), "id", "vec", "label", 7)
    assert [r["silhouette"] for r in same.collect()] == [0.0] * 30
    mean = cluster.silhouette(vectors(spark, x, label), "id", "vec", "label", 25).first()[0]
    assert mean == pytest.approx(brute_silhouette(x, label).mean(), abs=1e-9)
    sums = cluster.distance_sums(x[:5], x, np.array([0, 40, 80]))  # one sum for a point and cluster, not one for each block
    assert np.allclose(sums, [[np.linalg.norm(x[i] - x[j : j + 40], axis=1).sum() for j in (0, 40, 80)] for i in range(5)])


def test_distances_of_two_blocks_count_for_both():
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(300, 5)), rng.normal(size=(700, 5))
    start, start_x = np.array([0, 10, 400]), np.array([0, 1, 2, 290])
    rows, columns = cluster.distance_sums(x, y, start, start_x)
    gap = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
    assert np.allclose(rows, np.add.reduceat(gap, start, axis=1)) and np.allclose(columns, np.add.reduceat(gap, start_x, axis=0).T)


@pytest.mark.parametrize("limit", [4096, 2])
def test_silhouette_of_blocks_of_several_small_clusters(spark, limit):
    rng = np.random.default_rng(8)
    label = rng.integers(0, 40, 300)
    x = rng.normal(size=(300, 2)) * 0.3 + np.stack([label % 7, label // 7], axis=1)  # blocks want some clusters of each other, or of one side only
    got = cluster.silhouette_samples(vectors(spark, x, label), "id", "vec", "label", 30, limit).orderBy("id").collect()
    assert np.allclose([r["silhouette"] for r in got], brute_silhouette(x, label))


def test_silhouette_undefined_for_one_cluster(spark):
    df = vectors(spark, np.eye(3), np.zeros(3, dtype=int))
    assert cluster.silhouette(df, "id", "vec", "label").first()[0] is None


def test_rounds_of_merges_send_no_rows_through_the_driver(spark):
    rows = [(i, i, 1.0, 0.0, [float(i % 97), float(i % 89)]) for i in range(300)]
    live = spark.createDataFrame(rows, "c long, rep long, w double, h double, _v array<double>")
    found = cluster._mutual(live, 2, 50, 1)
    assert found.count() > 0
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().toString()


def brute_dbscan(x, eps, need):
    d2 = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    near = d2 <= eps * eps
    core = near.sum(axis=1) >= need
    label = np.full(len(x), -1)
    number = 0
    for i in range(len(x)):
        if core[i] and label[i] == -1:
            queue = [i]
            label[i] = number
            while queue:
                for j in np.nonzero(near[queue.pop()] & core & (label == -1))[0]:
                    label[j] = number
                    queue.append(j)
            number += 1
    for i in np.nonzero(~core)[0]:
        reach = label[near[i] & core]
        if len(reach):
            label[i] = reach.min()
    return label, core


@pytest.mark.parametrize("dims,eps,need", [(2, 0.5, 5), (1, 0.1, 3), (4, 0.9, 4), (2, 0.0625, 2)])
def test_dbscan_equals_brute_force(spark, dims, eps, need):
    rng = np.random.default_rng(dims)
    parts = [rng.normal(size=(70, dims)) * 0.4 + c for c in (0, 3)] + [rng.uniform(-2, 5, (60, dims))]
    parts += [np.full((80, dims), 1.5), rng.integers(0, 3, (20, dims)) * eps]  # copies, and ties at exactly eps
    x = rng.permutation(np.vstack(parts).round(4))
    names = [f"f{i}" for i in range(dims)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(id=np.arange(len(x)))).repartition(5)
    label, core = brute_dbscan(x, eps, need)
    got = cluster.dbscan(df, "id", names, eps, need).orderBy("id").collect()
    assert [r["cluster"] for r in got] == list(label)
    assert [r["core"] for r in got] == list(core.astype(int))


def test_ward_exact_on_small_data(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(24, 2)) + np.repeat([[0, 0], [6, 0], [0, 6], [6, 6]], 6, axis=0)
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(id=np.arange(24)))
    labelled, merges = cluster.hierarchical(df, ["a", "b"], "id", k=4)
    got = [r["cluster"] for r in labelled.orderBy("id").collect()]
    assert got == list(np.repeat([0, 1, 2, 3], 6))
    heights = [r["height"] for r in merges.orderBy("step").collect()]
    assert len(heights) == 23 and heights == sorted(heights)
    # Ward heights sum (squared, halved) to the total sum of squares.
    assert np.isclose(sum(h * h for h in heights) / 2, ((x - x.mean(axis=0)) ** 2).sum())


def brute_ward(x):
    """(left, right, height, size) by looking at all pairs of clusters before every merge; leaves are rows."""
    live = {i: (p.astype(float), 1) for i, p in enumerate(x)}
    merges = []
    while len(live) > 1:
        ids = sorted(live)
        centre, size = np.array([live[i][0] for i in ids]), np.array([live[i][1] for i in ids], float)
        gap = ((centre[:, None] - centre[None]) ** 2).sum(axis=2)
        cost = 2 * gap * size[:, None] * size[None] / (size[:, None] + size[None])
        cost[np.tril_indices(len(ids))] = np.inf
        i, j = divmod(int(cost.argmin()), len(ids))
        (p, a), (q, b) = live.pop(ids[i]), live.pop(ids[j])
        live[len(x) + len(merges)] = ((p * a + q * b) / (a + b), a + b)
        merges.append((ids[i], ids[j], float(np.sqrt(cost[i, j])), a + b))
    return merges


def brute_labels(merges, n, k):
    """Clusters after n - k merges, numbered by their lowest row."""
    parent = list(range(n + len(merges)))
    for i, (a, b, *_) in enumerate(merges[: max(0, n - k)]):
        parent[a] = parent[b] = n + i
    numbers = {}
    out = []
    for i in range(n):
        while parent[i] != i:
            i = parent[i]
        out.append(numbers.setdefault(i, len(numbers)))
    return out


@pytest.mark.parametrize(("n", "dims", "finish", "rows"), [(3, 2, 2_048, 2_048), (257, 3, 2_048, 2_048), (200, 2, 80, 32), (60, 4, 12, 2_048)])
def test_ward_equals_all_pairs(spark, n, dims, finish, rows):
    """The tree does not depend on where one task takes over, nor on the size of leaves."""
    x = np.random.default_rng(n).normal(size=(n, dims)) * np.arange(1, dims + 1)
    names = [f"f{i}" for i in range(dims)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(id=np.arange(n) * 3)).repartition(4)
    labelled, merges = cluster.hierarchical(df, names, "id", k=3, finish=finish, rows=rows)
    got = merges.orderBy("step").collect()
    want = brute_ward(x)
    assert [(r.step, r.left, r.right, r.size) for r in got] == [(i, a, b, s) for i, (a, b, _, s) in enumerate(want)]
    assert np.allclose([r.height for r in got], [h for _, _, h, _ in want])
    labels = [r.cluster for r in labelled.orderBy("id").collect()]
    assert labels == brute_labels(want, n, 3)


def test_ward_of_equal_rows(spark):
    """A third of the rows is equal, some others are in pairs: those merge first, at height 0, one by one."""
    x = np.random.default_rng(4).normal(size=(90, 2))
    x[::3], x[1], x[5] = 0.25, x[2], x[4]
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(id=np.arange(90)))
    labelled, merges = cluster.hierarchical(df, ["a", "b"], "id", k=5, finish=30)
    got = merges.orderBy("step").collect()
    assert len(got) == 89 and [r.height for r in got[:31]] == [0.0] * 31 and got[31].height > 0
    assert np.isclose(sum(r.height**2 for r in got) / 2, ((x - x.mean(axis=0)) ** 2).sum())
    assert np.allclose([r.height for r in got], [h for _, _, h, _ in brute_ward(x)])
    children = [c for r in got for c in (r.left, r.right)]
    assert sorted(children) == list(range(178)) and all(max(r.left, r.right) < 90 + r.step for r in got)
    assert labelled.select("cluster").distinct().count() == 5 and labelled.count() == 90


@pytest.mark.parametrize("k", [3, 6, 45])
def test_ward_labels_follow_the_merges(spark, monkeypatch, k):
    """A chain of 40 different values, of which most are equal rows too: labels are those of all but the last k - 1 merges, and
    need few rounds, whatever the depth of the tree and the number of rows."""
    values = [2.0 ** i for i in range(40) for _ in range(1 + i * 7 % 5)]
    n = len(values)
    df = spark.createDataFrame([(i * 3, v) for i, v in enumerate(values)], "id long, a double").repartition(3)
    written, write = [], cluster.write_and_read
    roots = cluster._roots
    monkeypatch.setattr(cluster, "components", None)

    def counted(kept):
        monkeypatch.setattr(cluster, "write_and_read", lambda d: written.append(d) or write(d))
        out = roots(kept)
        monkeypatch.setattr(cluster, "write_and_read", write)
        return out

    monkeypatch.setattr(cluster, "_roots", counted)
    labelled, merges = cluster.hierarchical(df, ["a"], "id", k=k)
    assert 2 <= len(written) <= 9
    groups = {i: [i] for i in range(n)}
    for m in merges.orderBy("step").limit(n - k).collect():
        groups[n + m.step] = groups.pop(m.left) + groups.pop(m.right)
    want = {i: label for label, rows in enumerate(sorted(map(sorted, groups.values()))) for i in rows}
    assert len(groups) == k and {r.id // 3: r.cluster for r in labelled.collect()} == want


def test_ward_table_labels_no_rows(spark, monkeypatch):
    """The merges alone need none of the rounds that go through all rows for their clusters."""
    x = np.random.default_rng(7).normal(size=(60, 2))
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(id=np.arange(60)))
    monkeypatch.setattr(cluster, "components", lambda *a: pytest.fail("labels were looked for"))
    merges = cluster.ward_table(df, ["a", "b"], "id").orderBy("step").collect()
    assert [(r.left, r.right, r.size) for r in merges] == [(a, b, s) for a, b, _, s in brute_ward(x)]
    assert models.linkage.__code__.co_names.count("hierarchical") == models.linkage_total.__code__.co_names.count("hierarchical") == 0


def test_ward_of_few_or_broken_rows(spark):
    empty = spark.createDataFrame([], "id long, a double")
    assert [d.count() for d in cluster.hierarchical(empty, ["a"], "id")] == [0, 0]
    one = spark.createDataFrame([(7, 1.0)], "id long, a double")
    labelled, merges = cluster.hierarchical(one, ["a"], "id")
    assert labelled.first().cluster == 0 and merges.count() == 0
    with pytest.raises(ValueError, match="null"):
        cluster.hierarchical(spark.createDataFrame([(1, None), (2, 2.0)], "id long, a double"), ["a"], "id")


def test_kmeans_takes_the_best_restart(spark):
    """On separated groups the best of all restarts has the least possible cost: that of the groups' own centres."""
    rng = np.random.default_rng(9)
    spots = np.array([[0, 0], [8, 1], [1, 9], [9, 9], [4, 4]])
    x = rng.normal(size=(200, 2)) * 0.3 + np.repeat(spots, 40, axis=0)
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(id=np.arange(200), cluster_note="x"))
    results = []
    for parts in (1, 7):
        labelled, centres = cluster.kmeans(df.repartition(parts), ["a", "b"], k=5)
        results.append(([tuple(r) for r in centres.orderBy("cluster").collect()], [r.cluster for r in labelled.orderBy("id").collect()]))
    (rows, labels), (again, same) = results
    assert labels == same and np.allclose(rows, again)
    means = sorted(x[i : i + 40].mean(axis=0).tolist() for i in range(0, 200, 40))
    assert np.allclose([r[1:3] for r in rows], means) and [r[3] for r in rows] == [40] * 5
    cost = sum(((x[i : i + 40] - x[i : i + 40].mean(axis=0)) ** 2).sum() for i in range(0, 200, 40))
    assert np.isclose(sum(r[4] for r in rows), cost)


def test_kmeans_draws_first_centres_from_all_rows(spark):
    """Two single rows far from 20,000 others: centres that all begin among the others never part them."""
    rows = spark.range(20_002).select("id", F.when(F.col("id") < 20_000, F.col("id") / 20_000).otherwise(1_000.0).alias("a"),
                                      F.when(F.col("id") == 20_001, 200.0).otherwise(0.0).alias("b"))
    labelled, centres = cluster.kmeans(rows, ["a", "b"], k=3, restarts=3)
    assert [r["size"] for r in centres.orderBy("cluster").collect()] == [20_000, 1, 1]
    assert labelled.filter("id >= 20000").orderBy("id").select("cluster").collect() == [(1,), (2,)]


def test_kmeans_draws_in_proportion(spark):
    """A row is drawn with its number times its squared distance, whatever the partitions."""
    rows = spark.createDataFrame([([0.0], 5), ([1.0], 8), ([2.0], 1), ([4.0], 1)], "_v array<double>, _n long").withColumn("_h", F.xxhash64("_v"))
    centres = {i: np.array([[0.0]]) for i in range(4_000)}
    draws = [{r["restart"]: r["best"]["_v"][0] for r in cluster._drawn(rows.repartition(parts), centres, 1, 7).collect()} for parts in (1, 3)]
    assert draws[0] == draws[1] and len(draws[0]) == 4_000
    shares = [sum(x == v for x in draws[0].values()) / 4_000 for v in (0.0, 1.0, 2.0, 4.0)]
    assert np.allclose(shares, [0, 8 / 28, 4 / 28, 16 / 28], atol=0.03)


def test_kmeans_of_few_or_broken_rows(spark):
    rows = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, 5.0)], "id long, a double")
    labelled, centres = cluster.kmeans(rows, ["a"], k=4)
    assert [tuple(r) for r in centres.orderBy("cluster").collect()] == [(0, 2.0, 2, 0.0), (1, 5.0, 1, 0.0)]
    assert [r.cluster for r in labelled.orderBy("id").collect()] == [0, 0, 1]
    with pytest.raises(ValueError, match="null"):
        cluster.kmeans(spark.createDataFrame([(1, None)], "id long, a double"), ["a"])
    labelled, centres = cluster.kmeans(rows.limit(0), ["a"])
    assert labelled.count() == 0 and centres.count() == 0


def test_kmeans_finds_separate_groups(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(90, 2)) * 0.2 + np.repeat([[0, 0], [5, 0], [0, 5]], 30, axis=0)
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(id=np.arange(90)))
    labelled, centres = cluster.kmeans(df, ["a", "b"], k=3, restarts=3)
    assert labelled.groupBy(F.floor(F.col("id") / 30), "cluster").count().count() == 3 and centres.count() == 3
    score = cluster.silhouette_squared(labelled.withColumn("v", F.array("a", "b")), "v", "cluster")
    assert 0.9 < score <= 1


def test_pca_equals_numpy(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 4)) @ rng.normal(size=(4, 4)) + 3
    names = list("abcd")
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(id=np.arange(60)))
    projection = features.pca(df, names, 0.9)
    _, s, axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    ratio = s**2 / (s**2).sum()
    k = int(np.searchsorted(np.cumsum(ratio), 0.9, side="right")) + 1
    assert len(projection.ratios) == k and np.allclose(projection.ratios, ratio[:k])
    signs = np.sign(axes[np.arange(4), np.abs(axes).argmax(axis=1)])
    want = (x - x.mean(axis=0)) @ (axes * signs[:, None]).T[:, :k]
    got = projection.transform(df).orderBy("id").select(*[f"pc{i + 1}" for i in range(k)]).toPandas().to_numpy()
    assert np.allclose(got, want)


@pytest.fixture(scope="module")
def curve(spark):
    rng = np.random.default_rng(11)
    x = rng.uniform(-2, 2, (500, 2))
    y = np.sin(x[:, 0] * 2) * 3 + x[:, 1]
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(id=np.arange(500), y=y))
    df = features.hash_split(df, "id", 0.4)
    return df.filter("side = 'train'"), df.filter("side = 'test'")


@pytest.mark.parametrize("name,options,least", [
    ("linear", {}, 0.2), ("knn", {}, 0.9), ("tree", {}, 0.9), ("forest", {"trees": 20}, 0.8), ("rbf", {"c": 100}, 0.9),
    ("gbt", {"rounds": 15}, 0.8),
])
def test_models_beat_the_mean(curve, name, options, least):
    out = regress.predict_with(name, *curve, ["a", "b"], "y", "id", **options)
    assert regress.regression_metrics(out, "actual", "prediction").first()["r2"] > least


def test_linear_equals_closed_form(curve):
    train, test = (f.orderBy("id").toPandas() for f in curve)
    a = np.column_stack([train[["a", "b"]], np.ones(len(train))])
    w = np.linalg.lstsq(a, train["y"], rcond=None)[0]
    got = regress.predict_with("linear", *curve, ["a", "b"], "y", "id").orderBy("id").toPandas()
    assert np.allclose(got["prediction"], np.column_stack([test[["a", "b"]], np.ones(len(test))]) @ w)


def test_importances_and_saved_model(spark, curve, tmp_path):
    model = regress.fit_tree_model("forest", curve[0], ["a", "b"], "y", trees=10)
    table = regress.feature_importance(spark, model, ["a", "b"]).collect()
    assert table[-1]["feature"] == "a" and np.isclose(sum(r["importance"] for r in table), 1)
    regress.save_model(model, str(tmp_path / "m"))
    again = regress.load_model(RandomForestRegressionModel, str(tmp_path / "m"))
    assert again.featureImportances == model.featureImportances
    assert regress.feature_importance(spark, object(), ["a"]).count() == 0


def test_metrics_without_variation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0)], "y double, p double")
    row = regress.regression_metrics(df, "y", "p").first()
    assert row["mae"] == 1.0 and row["r2"] is None
    line = regress.identity_line(df, "p").first()
    assert (line["low"], line["high"]) == (0.0, 2.0)


def test_scales_invert_and_normalise(spark):
    df = spark.createDataFrame([(float(i), 5.0) for i in range(7)], "x double, c double")
    scale = features.MinMaxScale.fit(df, "x")
    back = df.select("x", scale.inverse(scale.scaled(F.col("x"))).alias("y")).collect()
    assert all(abs(r["x"] - r["y"]) < 1e-12 for r in back)
    row = features.StandardScale.fit(df, ["x", "c"]).transform(df).agg(
        F.avg("x"), F.stddev_pop("x"), F.max("c")).first()
    assert np.allclose(list(row), [0, 1, 0])


def test_boosting_reads_equal_rows_once(spark):
    """Rows of equal features go into the rounds as one with their number; predictions are those of a fit on all rows."""
    noise = np.random.default_rng(8).normal(0, 1, 240)  # without noise, splits tie and rounding decides
    rows = [(i, float(i % 5), float(i % 4), float(3 * (i % 5) - 2 * (i % 4) + noise[i])) for i in range(240)]
    train = spark.createDataFrame(rows, "id long, a double, b double, y double")
    grouped = regress._grouped(train, ["a", "b"], "y")
    assert grouped.count() == 20 and grouped.agg(F.sum("_n")).first()[0] == 240
    options = {"rounds": 6, "depth": 3}
    want, _ = regress._fit_predict(regress.boosted("y", **options), train, train, ["a", "b"], "y")
    want = {r["id"]: r["prediction"] for r in want.collect()}
    got = regress.predict_with("gbt", train, train, ["a", "b"], "y", "id", **options).collect()
    assert {r["id"]: r["prediction"] for r in got} == pytest.approx(want)
