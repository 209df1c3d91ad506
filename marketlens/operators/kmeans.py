"""Multi-start K-Means on k-d trees of the customer table (M-02 engine).

All restarts advance together, one job a step. The points are put into k-d
trees once, inside the tasks (``functions.kdtree``): a row of the tree table is
a tree of up to 65,536 points. Then

* seeding (k-means++) draws, per restart, the next centre with probability
  proportional to the squared distance to the nearest chosen one, by
  exponential race keys ``-ln(u) / D^2``: each partition keeps its minimum per
  restart and ``min_by`` merges them (exact weighted sampling);
* a Lloyd step walks the trees with the filtering rule: nodes whose box lies
  nearest to one centre add their summary, only points of leaves on a boundary
  are compared. A partition returns at most restarts x k partial sums, which a
  small aggregate merges;
* a restart stops when its total squared centre shift is at most
  ``tol x mean feature variance`` (empty clusters keep their centre);
* the restart with the lowest within-cluster sum of squares wins; costs
  within ``TIE_TOLERANCE`` (relative) of the lowest count as ties, won by
  the earliest restart, so the pick does not depend on partitioning.

Random numbers come from hashing a row key with the seed, so a recomputed
partition after an executor loss draws the same values. Only restarts x k
centre summaries travel to the driver per step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.kdtree import TREE_POINTS, CentreSums, Tree, add_nearest
from marketlens.session import plain_plans, ship_package

#: Shuffle partitions of the merge of a step's partial sums, at most restarts x k rows a partition.
MERGE_PARTITIONS = 8
# Relative cost difference treated as summation rounding between restarts.
TIE_TOLERANCE = 1e-9


@dataclass
class KMeansFit:
    centers: list[list[float]]
    inertia: float
    iterations: int
    restart: int
    all_inertia: list[float]


def _mix_uniform(h: np.ndarray, salt: int) -> np.ndarray:
    """Deterministic uniforms in (0, 1) from 64-bit row hashes (splitmix64 finaliser)."""
    z = h.astype(np.uint64) ^ np.uint64(salt & 0xFFFFFFFFFFFFFFFF)
    z = (z + np.uint64(0x9E3779B97F4A7C15))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z = z ^ (z >> np.uint64(31))
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) / float(2**53)


def point_trees(data: DataFrame, feature_cols: list[str], key_col: str, seed: int = 42, count: int | None = None) -> DataFrame:
    """(points, keys, nodes): a packed tree per row, over all rows of ``data``.

    With their ``count`` known, the rows' partitions are merged until they hold about a whole tree, or one is left a core:
    every step runs a task a partition and sends its sums."""
    ship_package(data.sparkSession)
    if count is not None:
        data = data.coalesce(max(data.sparkSession.sparkContext.defaultParallelism, -(-count // TREE_POINTS)))
    dims = len(feature_cols)
    rows = data.select(*[F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(feature_cols)], F.xxhash64(F.col(key_col), F.lit(seed)).alias("_h"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def tree() -> pa.RecordBatch:
            whole = [np.concatenate(c) for c in zip(*held, strict=True)]
            packed = Tree.build(np.column_stack(whole[:dims]), whole[dims]).pack()
            return pa.RecordBatch.from_arrays([pa.array([packed[c]], pa.binary()) for c in ("points", "keys", "nodes")], names=["points", "keys", "nodes"])

        for batch in batches:
            for at in range(0, batch.num_rows, TREE_POINTS):
                part = batch.slice(at, TREE_POINTS)
                held.append([np.asarray(c) for c in part.columns])
                n += part.num_rows
                if n >= TREE_POINTS:
                    yield tree()
                    held, n = [], 0
        if n:
            yield tree()

    return rows.mapInArrow(build, "points binary, keys binary, nodes binary")


def _trees(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[Tree]:
    for batch in batches:
        for row in batch.to_pylist():
            yield Tree.unpack(row["points"], row["keys"], row["nodes"], dims)


def _seed(trees: DataFrame, dims: int, k: int, restarts: int, seed: int) -> np.ndarray:
    """k-means++ seeding for all restarts, one job per centre: (restarts, k, dims).

    Each partition finds, per restart, the point with the smallest race key
    ``-ln(u) / D^2`` (D^2 = squared distance to the nearest chosen centre; 1
    for the first centre, i.e. a uniform pick); the global minimum per
    restart is an exact draw with probability proportional to D^2."""
    xcols = [f"x{j}" for j in range(dims)]
    centers = np.zeros((restarts, 0, dims))
    for step in range(k):

        def winners(batches, chosen=centers, step=step):
            best = [(np.inf, None)] * restarts
            for tree in _trees(batches, dims):
                h = tree.keys.view(np.uint64)
                for r in range(restarts):
                    d2 = ((tree.points[:, None] - chosen[r]) ** 2).sum(axis=2).min(axis=1) if step else np.ones(len(h))
                    with np.errstate(divide="ignore", over="ignore"):
                        race = np.where(d2 > 0, -np.log(_mix_uniform(h, seed * 7919 + 1_000_003 * step + r)) / d2, np.inf)
                    i = int(np.argmin(race))
                    if race[i] < best[r][0]:
                        best[r] = (float(race[i]), tree.points[i])
            rows = [(r, b[0], *map(float, b[1])) for r, b in enumerate(best) if b[1] is not None]
            yield pa.RecordBatch.from_pylist([dict(zip(["r", "race", *xcols], row, strict=True)) for row in rows],
                                             schema=pa.schema([("r", pa.int32()), ("race", pa.float64()), *[(c, pa.float64()) for c in xcols]]))

        partial = trees.mapInArrow(winners, "r int, race double, " + ", ".join(f"{c} double" for c in xcols))
        with plain_plans(trees.sparkSession, MERGE_PARTITIONS):
            picked = partial.groupBy("r").agg(F.min_by(F.struct(*xcols), F.col("race")).alias("p")).collect()  # a row a restart
        got = {row["r"]: list(row["p"]) for row in picked}
        # fewer distinct points than k: repeat the last centre
        new = [got.get(r, centers[r][-1] if step else [0.0] * dims) for r in range(restarts)]
        centers = np.concatenate([centers, np.array(new, dtype=float).reshape(restarts, 1, dims)], axis=1)
    return centers


def centre_sums(trees: DataFrame, centers: np.ndarray) -> CentreSums:
    """Sums over the points nearest to each of ``centers`` (restarts, k, dims): one job over the trees."""
    restarts, k, dims = centers.shape
    names = ["at", "n", "sse", *[f"s{j}" for j in range(dims)]]

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = CentreSums.zeros(restarts, k, dims)
        for tree in _trees(batches, dims):
            add_nearest(tree, centers, own)
        at = np.flatnonzero(own.count.reshape(-1))
        columns = [at.astype(np.int32), own.count.reshape(-1)[at], own.cost.reshape(-1)[at], *own.total.reshape(-1, dims)[at].T]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    partial = trees.mapInArrow(partials, "at int, " + ", ".join(f"{c} double" for c in names[1:]))
    out = CentreSums.zeros(restarts, k, dims)
    with plain_plans(trees.sparkSession, MERGE_PARTITIONS):
        for row in partial.groupBy("at").agg(*[F.sum(c).alias(c) for c in names[1:]]).collect():  # at most restarts x k rows
            r, c = divmod(row["at"], k)
            out.count[r, c], out.cost[r, c], out.total[r, c] = row["n"], row["sse"], row[3:]
    return out


def lloyd_step(trees: DataFrame, centers: np.ndarray) -> tuple[np.ndarray, CentreSums]:
    """(means of the points nearest to each centre, the sums they come from); centres without points stay."""
    sums = centre_sums(trees, centers)
    means = sums.total / np.maximum(sums.count, 1)[..., None]
    return np.where(sums.count[..., None] > 0, means, centers), sums


def multi_start_kmeans(data: DataFrame, feature_cols: list[str], key_col: str, k: int, restarts: int = 20,
                       seed: int = 42, max_iter: int = 300, tol: float = 1e-4,
                       mean_variance: float = 1.0, count: int | None = None) -> KMeansFit:
    """Best of ``restarts`` k-means++ / Lloyd fits; ``count``: the number of rows, if known (see ``point_trees``)."""
    trees = point_trees(data, feature_cols, key_col, seed, count).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        centers = _seed(trees, len(feature_cols), k, restarts, seed)
        active, iterations = np.arange(restarts), np.zeros(restarts, int)
        for _ in range(max_iter):
            if not len(active):
                break
            new, _ = lloyd_step(trees, centers[active])
            shift = ((new - centers[active]) ** 2).sum(axis=(1, 2))
            centers[active] = new
            iterations[active] += 1
            active = active[shift > tol * mean_variance]
        # assignment cost with the final centres, all restarts in one pass
        inertia = centre_sums(trees, centers).cost.sum(axis=1)
    finally:
        trees.unpersist()
    # the earliest restart whose cost is the lowest up to summation rounding:
    # restarts reaching the same clustering differ only in the last bits,
    # and those depend on how the rows are partitioned
    best = int(np.flatnonzero(inertia <= inertia.min() + TIE_TOLERANCE * abs(inertia.min()))[0])
    return KMeansFit(centers[best].tolist(), float(inertia[best]), int(iterations[best]), best, inertia.tolist())


def _sqdist(cols: list[Column], center: list[float]) -> Column:
    total = None
    for x, c in zip(cols, center):
        term = (x - F.lit(float(c))) * (x - F.lit(float(c)))
        total = term if total is None else total + term
    return total


def assign_clusters(data: DataFrame, feature_cols: list[str], centers: list[list[float]], out: str = "cluster") -> DataFrame:
    """Nearest-centre label as plain column expressions (codegen, no UDF); lowest index on ties."""
    names = [f"_d{c}" for c in range(len(centers))]
    cols = [F.col(c).cast("double") for c in feature_cols]
    staged = data.select("*", *[_sqdist(cols, center).alias(n) for n, center in zip(names, centers, strict=True)])
    best = F.least(*names) if len(names) > 1 else F.col(names[0])
    index = F.lit(len(names) - 1)
    for c in range(len(names) - 2, -1, -1):
        index = F.when(F.col(names[c]) == best, F.lit(c)).otherwise(index)
    return staged.withColumn(out, index.cast("int")).drop(*names)
