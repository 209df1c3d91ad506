"""Approximate nearest neighbours with an inverted multi-index.

Each half of the vectors has a codebook of its own (k-means in numpy on at
most ``SAMPLE`` vectors, those with the smallest hash of vec_id); a row's cell
is its pair of nearest centroids, so two codebooks of k make k * k cells. A
query sorts the centroids of either half by distance and visits cells by
increasing sum of the two squared distances with a heap, until the cells seen
hold the share ``share`` of all rows and at least ``least``; the rows of those
cells are reranked by exact distance on original vectors. How large a share a
recall takes depends on the data: the test vectors are nearly uniform on a
sphere in 64 dimensions, where 0.55 gives 0.92 to 0.99; vectors with clusters
do with far less.

Every row is indexed. Only the k * k cell counts and the codebooks (fixed by
``CENTROIDS``) are sent to tasks. Rows and visits meet by the centroid of the
first half; more than ``BLOCK`` rows or visits of one centroid are split into
blocks, each row block meeting each visit block, so a cell that holds a third
of all rows is many groups of bounded size. A group returns at most
``neighbours`` rows per query.

Vectors that are null, empty, zero or hold null or non-finite components take
no part. Vectors of each length have an index of their own and are searched
among themselves. A query is never its own neighbour: rows with its vec_id are left
out. Of several rows with a query's vec_id the smallest vector asks. Ties go
to the smaller vec_id. Rows without vec_id are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.shared import store

SAMPLE = 20_000
LEAST, SHARE = 100, 0.55
CENTROIDS = 64
BLOCK = 4_096
_ROUNDS = 15


def codebook(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ seeds and Lloyd rounds; empty clusters keep their centroid."""
    draw = np.random.default_rng(seed)
    centres = [x[draw.integers(len(x))]]
    near = ((x - centres[0]) ** 2).sum(axis=1)
    for _ in range(k - 1):
        total = near.sum()
        centres.append(x[draw.choice(len(x), p=near / total)] if total > 0 else x[draw.integers(len(x))])
        np.minimum(near, ((x - centres[-1]) ** 2).sum(axis=1), out=near)
    out = np.array(centres)
    for _ in range(_ROUNDS):
        own = nearest(x, out)
        counts = np.bincount(own, minlength=k)
        sums = np.zeros((k, x.shape[1]))
        for j, column in enumerate(x.T):
            sums[:, j] = np.bincount(own, column, k)
        out = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], out)
    return out


def square_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return square_distances(x, centres).argmin(axis=1)


def cells_in_order(first: np.ndarray, second: np.ndarray, counts: np.ndarray, visit: int) -> list[int]:
    """Cells by increasing first[i] + second[j] until they hold ``visit`` rows; empty cells are passed over."""
    a, b, k = np.argsort(first, kind="stable"), np.argsort(second, kind="stable"), len(second)
    heap, seen, out, held = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and held < visit:
        _, i, j = heappop(heap)
        cell = int(a[i]) * k + int(b[j])
        if counts[cell]:
            out.append(cell)
            held += int(counts[cell])
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < k and (p, q) not in seen:
                seen.add((p, q))
                heappush(heap, (first[a[p]] + second[b[q]], p, q))
    return out


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), dims)


def _usable(vector: Column) -> Column:
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def search(vectors: DataFrame, is_query: Column, neighbours: int = 10, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows of ``vectors`` (vec_id, embedding) that are queries, against all others."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & _usable(F.col("embedding")))
    lengths = rows.groupBy(F.size("embedding").alias("dims")).agg(F.count(F.lit(1)).alias("n")).orderBy("dims").collect()  # one in a table of one model's vectors
    kind = vectors.schema["vec_id"].dataType.simpleString()
    found = vectors.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    for dims, n in lengths:
        own = _search(rows.where(F.size("embedding") == dims), kind, dims, n, neighbours, max(least, math.ceil(share * n)))
        found = own if len(lengths) == 1 else found.unionByName(own)
    return found


def _search(rows: DataFrame, kind: str, dims: int, n: int, neighbours: int, visit: int) -> DataFrame:
    """``search`` among ``n`` rows (vec_id, embedding, asks) of ``dims`` components; ``visit`` rows at least are reranked a query."""
    half = dims // 2
    drawn = rows.select(F.xxhash64(F.lit("index"), "vec_id").alias("_draw"), "vec_id", "embedding").orderBy("_draw", "vec_id", "embedding").limit(SAMPLE)
    sample = matrix(drawn.select("embedding").toArrow().column(0), dims)
    k = min(CENTROIDS, n)
    books = codebook(sample[:, :half], k, 1), codebook(sample[:, half:], k, 2)  # one dimension: the first half is empty

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), dims)
            cells = [pa.array(nearest(part, book).astype(np.int32)) for part, book in zip((x[:, :half], x[:, half:]), books, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cells], names=["vec_id", "embedding", "asks", "first", "second"])

    index = store(rows.mapInArrow(place, f"vec_id {kind}, embedding array<double>, asks boolean, first int, second int"))
    counts = np.zeros(k * k, np.int64)
    for first, second, held in index.groupBy("first", "second").count().collect():  # at most CENTROIDS ** 2 rows
        counts[first * k + second] = held

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), dims)
            near = [square_distances(part, book) for part, book in zip((x[:, :half], x[:, half:]), books, strict=True)]
            at, firsts, seconds = [], [], []
            for row, (a, b) in enumerate(zip(*near, strict=True)):
                own: dict[int, list[int]] = {}
                for cell in cells_in_order(a, b, counts, visit):
                    own.setdefault(cell // k, []).append(cell % k)
                at += [row] * len(own)
                firsts += own.keys()
                seconds += own.values()
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in batch.columns), pa.array(firsts, pa.int32()),
                                              pa.array(seconds, pa.list_(pa.int32()))], names=["query_id", "embedding", "first", "seconds"])

    queries = index.where("asks").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    visits = store(queries.mapInArrow(traverse, f"query_id {kind}, embedding array<double>, first int, seconds array<int>"))
    asked = dict(visits.groupBy("first").count().collect())  # at most CENTROIDS rows
    held = counts.reshape(k, k).sum(axis=1)
    blocks = lambda sizes: F.element_at(F.array(*[F.lit(max(1, -(-int(x) // BLOCK))) for x in sizes]), F.col("first") + 1)
    row_blocks, ask_blocks = blocks(held), blocks([asked.get(i, 0) for i in range(k)])
    left = (
        visits.withColumn("ask", F.pmod(F.xxhash64("query_id"), ask_blocks).cast("int"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), row_blocks - 1))).select("first", "part", "ask", "query_id", "embedding", "seconds")
    )
    right = (
        index.withColumn("part", F.pmod(F.xxhash64("vec_id", "embedding"), row_blocks).cast("int"))
        .withColumn("ask", F.explode(F.sequence(F.lit(0), ask_blocks - 1))).select("first", "part", "ask", "vec_id", "embedding", "second")
    )

    def rerank(asks: pa.Table, held: pa.Table) -> pa.Table:
        ids, out = np.asarray(held.column("vec_id")), []
        if asks.num_rows and held.num_rows:
            x, q = matrix(held.column("embedding"), dims), matrix(asks.column("embedding"), dims)
            second = np.asarray(held.column("second"))
            for row, (own, cells) in enumerate(zip(asks.column("query_id").to_pylist(), asks.column("seconds").to_pylist(), strict=True)):
                seen = np.zeros(k, bool)
                seen[cells] = True
                distance = np.full(len(x), np.inf)
                at = np.flatnonzero(seen[second] & (ids != own))
                distance[at] = np.sqrt(((x[at] - q[row]) ** 2).sum(axis=1))
                limit = np.partition(distance, neighbours - 1)[neighbours - 1] if len(distance) > neighbours else np.inf
                best = np.flatnonzero((distance <= limit) & (distance < np.inf))
                best = best[np.lexsort((ids[best], distance[best]))][:neighbours]
                out.append((np.full(len(best), own, ids.dtype), ids[best], distance[best]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [ids[:0], ids[:0], np.zeros(0)]
        return pa.table({"query_id": pa.array(columns[0]), "vec_id": pa.array(columns[1]), "score": pa.array(columns[2])})

    keys = ["first", "part", "ask"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(rerank, f"query_id {kind}, vec_id {kind}, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")
