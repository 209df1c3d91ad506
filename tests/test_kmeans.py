"""Multi-start K-Means engine (M-02)."""

import numpy as np
import pytest

from marketlens.operators.kmeans import assign_clusters, multi_start_kmeans


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(0)
    means = np.array([[0, 0, 0], [5, 5, 0], [0, 5, 5], [5, 0, 5]], dtype=float)
    pts = np.vstack([m + rng.normal(scale=0.7, size=(150, 3)) for m in means])
    rows = [(f"id{i}", *map(float, p)) for i, p in enumerate(pts)]
    df = spark.createDataFrame(rows, "id string, a double, b double, c double").repartition(4).cache()
    df.count()
    return df, pts


def test_lloyd_fixed_point_and_inertia(spark, blobs):
    df, pts = blobs
    fit = multi_start_kmeans(df, ["a", "b", "c"], "id", k=4, restarts=5, seed=42, tol=1e-10)
    centers = np.array(fit.centers)
    labels = ((pts[:, None, :] - centers[None]) ** 2).sum(-1).argmin(1)
    for c in range(4):
        assert np.allclose(centers[c], pts[labels == c].mean(axis=0), atol=1e-6)
    inertia = ((pts - centers[labels]) ** 2).sum()
    assert fit.inertia == pytest.approx(inertia, rel=1e-9)
    assert fit.inertia == min(fit.all_inertia)
    got = sorted(tuple(np.round(c)) for c in centers)
    assert got == sorted(tuple(m) for m in [(0, 0, 0), (5, 5, 0), (0, 5, 5), (5, 0, 5)])


def test_deterministic(spark, blobs):
    df, _ = blobs
    a = multi_start_kmeans(df, ["a", "b", "c"], "id", k=4, restarts=3, seed=7)
    b = multi_start_kmeans(df.repartition(3), ["a", "b", "c"], "id", k=4, restarts=3, seed=7)
    assert np.allclose(a.centers, b.centers) and a.restart == b.restart


def test_not_worse_than_spark_ml(spark, blobs):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    df, _ = blobs
    vec = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    ml = KMeans(k=4, seed=42, maxIter=300, tol=1e-6).fit(vec).summary.trainingCost
    fit = multi_start_kmeans(df, ["a", "b", "c"], "id", k=4, restarts=10, seed=42)
    assert fit.inertia <= ml * (1 + 1e-6)


def test_assign_clusters_nearest(spark, blobs):
    df, pts = blobs
    centers = [[0.0, 0.0, 0.0], [5.0, 5.0, 0.0], [0.0, 5.0, 5.0], [5.0, 0.0, 5.0]]
    got = {r.id: r.cluster for r in assign_clusters(df, ["a", "b", "c"], centers).collect()}
    exp = ((pts[:, None, :] - np.array(centers)[None]) ** 2).sum(-1).argmin(1)
    assert [got[f"id{i}"] for i in range(len(pts))] == list(exp)


def test_fewer_distinct_points_than_k(spark):
    df = spark.createDataFrame([(f"i{i}", 1.0, 1.0, 1.0) for i in range(5)] + [("j", 2.0, 2.0, 2.0)],
                               "id string, a double, b double, c double")
    fit = multi_start_kmeans(df, ["a", "b", "c"], "id", k=4, restarts=2)
    assert fit.inertia == pytest.approx(0.0)


def test_fit_does_not_depend_on_partitioning(spark, blobs):
    df, _ = blobs
    a = multi_start_kmeans(df, ["a", "b", "c"], "id", k=4, restarts=3, seed=11)
    b = multi_start_kmeans(df.repartition(13), ["a", "b", "c"], "id", k=4, restarts=3, seed=11)
    assert a.restart == b.restart and a.iterations == b.iterations
    assert np.allclose(a.centers, b.centers, atol=1e-12)
    assert a.inertia == pytest.approx(b.inertia, rel=1e-12)


def _plain_sums(x, centres):
    """Counts, sums and costs of the points nearest to each centre, by comparing all."""
    far = ((x[:, None] - centres) ** 2).sum(axis=2)
    own = far.argmin(axis=1)
    k = len(centres)
    return np.bincount(own, minlength=k), np.array([x[own == c].sum(axis=0) for c in range(k)]), np.array([far[own == c, c].sum() for c in range(k)])


@pytest.mark.parametrize("kind", ["normal", "lattice", "one value", "two values", "line"])
def test_tree_sums_equal_plain_ones(kind):
    from marketlens.functions.kdtree import CentreSums, Tree, add_nearest

    rng = np.random.default_rng(4)
    x = {"normal": rng.normal(size=(5000, 3)), "lattice": rng.integers(0, 4, (3000, 3)).astype(float), "one value": np.ones((700, 3)),
         "two values": rng.integers(0, 2, (700, 1)) * np.ones((1, 3)), "line": np.column_stack([np.arange(900.0), np.zeros(900), np.zeros(900)])}[kind]
    tree = Tree.build(x, np.arange(len(x)))
    again = Tree.unpack(**tree.pack(), dims=3)
    assert sorted(again.keys.tolist()) == list(range(len(x))) and (x[again.keys] == again.points).all()
    centres = np.stack([x[rng.integers(0, len(x), 4)] + rng.normal(scale=s, size=(4, 3)) for s in (0, 0.01, 1, 100)])  # equal centres and ties too
    sums = CentreSums.zeros(4, 4, 3)
    add_nearest(again, centres, sums)
    for r in range(4):
        count, total, cost = _plain_sums(x, centres[r])
        assert sums.count[r].tolist() == count.tolist()
        assert np.allclose(sums.total[r], total, rtol=1e-9, atol=1e-9) and np.allclose(sums.cost[r], cost, rtol=1e-9, atol=1e-7)


def test_tree_looks_at_few_points():
    from marketlens.functions.kdtree import CentreSums, Tree, add_nearest

    x = np.random.default_rng(8).normal(size=(60_000, 3))
    sums = CentreSums.zeros(1, 4, 3)
    add_nearest(Tree.build(x, np.arange(len(x))), np.array([[[3.0, 0, 0], [-3, 0, 0], [0, 3, 0], [0, -3, 0]]]), sums)
    assert sums.count.sum() == len(x) and sums.compared < 0.4 * len(x)


def test_every_step_is_plain_lloyd(spark, blobs):
    from marketlens.operators.kmeans import lloyd_step, point_trees

    df, pts = blobs
    trees = point_trees(df, ["a", "b", "c"], "id").persist()
    own = np.array([pts[:4], pts[100:104]])
    plain = own.copy()
    for _ in range(4):
        own, _ = lloyd_step(trees, own)
        for r in range(2):
            count, total, _ = _plain_sums(pts, plain[r])
            plain[r] = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], plain[r])
        assert np.allclose(own, plain, atol=1e-9)
    trees.unpersist()
