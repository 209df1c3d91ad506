"""Near-duplicate documents by min-max hashing.

A document's set is the distinct hashes of its runs of ``shingle`` words
(lower-cased A-Z; words split at space and 0x09-0x0D). Each permutation gives
two signature values, its minimum and its maximum over the set, so a
signature of 160 values costs 80 hash evaluations per shingle; the two are
unbiased and nearly independent, and together have a lower variance than one
minimum of as many evaluations. Bands of ``ROWS`` values nominate pairs: at
similarity 0.8 a pair is missed with probability (1 - 0.8**5)**32 = 3e-6.

Nominated pairs are confirmed on full sets. Documents with equal sets are one
node, so copies never meet pairwise. In each of ``STAR_ROUNDS`` rounds every
bucket that holds more than one component tests its members against one centre
(another one each round); links merge components. Then a bucket has mostly one
large component and a few outliers. Outliers are compared with all members of
that component, and with each other, inside tasks: blocks of at most ``BLOCK``
sets meet, intersections are counted through a sorted list of one block's
hashes, and a task returns only links that merge components. So no nominated
pair is lost, and no pair is ever a row.

Texts without words, empty texts and nulls have no set and are linked with
nothing. Fewer words than ``shingle`` make one shingle. Rows without doc_id
take part; a component made of them alone has component_id null. Of a
component the row with the smallest doc_id (nulls last), then the smallest
text_md5, is kept. Rows equal in doc_id and text get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm import kernels as K
from marketlens.llm.graph import connected_components
from marketlens.llm.shared import store

PERMUTATIONS, ROWS = 80, 5
BANDS = 2 * PERMUTATIONS // ROWS
STAR_ROUNDS = 2
BLOCK = 512
_CHUNK = 1 << 15


def permutations(n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed)
    return draw.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 1 << 63, n, dtype=np.uint64)


def min_max(hashes: np.ndarray, times: np.ndarray, xors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest value of the set under each permutation."""
    low = np.full(len(times), np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(len(times), np.uint64)
    for at in range(0, len(hashes), _CHUNK):
        values = (hashes[None, at : at + _CHUNK] ^ xors[:, None]) * times[:, None]
        np.minimum(low, values.min(axis=1), out=low)
        np.maximum(high, values.max(axis=1), out=high)
    return low, high


def band_keys(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """One key per band; the values of a band come from different permutations."""
    table = np.concatenate([low, high]).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in table.T:
        key = K.mix(key * np.uint64(0x9FB21C651E98DF25) + column)
    return key.view(np.int64)


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, n_shingles, node, text_md5, bands); node names the set and is null if that is empty."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n_shingles", T.LongType()), T.StructField("node", T.StringType()),
                           T.StructField("text_md5", T.StringType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times, xors = permutations(PERMUTATIONS)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(2)
            for at, to, hashes, bounds in K.shingle_slices(batch.column(1), shingle):
                sizes, nodes, bands = [], [], []
                for i in range(to - at):
                    own = np.unique(hashes[bounds[i] : bounds[i + 1]])
                    sizes.append(len(own))
                    if len(own):
                        nodes.append(xxhash.xxh3_128_hexdigest(own))
                        bands.append(band_keys(*min_max(own, times, xors)))
                    else:
                        nodes.append(None)
                flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, to - at), pa.array(sizes, pa.int64()), pa.array(nodes, pa.string()), texts.slice(at, to - at),
                     K.ragged(flat, [BANDS * bool(n) for n in sizes], pa.int64())], names=schema.names)

    return docs.select("doc_id", "text", F.md5(F.col("text").cast("binary"))).mapInArrow(sign, schema)


def full_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(node, hashes): the whole set of every document."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, hashes, bounds in K.shingle_slices(batch.column(0), shingle):
                own = [np.unique(hashes[bounds[i] : bounds[i + 1]]) for i in range(to - at)]
                own = [x for x in own if len(x)]
                if own:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([xxhash.xxh3_128_hexdigest(x) for x in own], pa.string()),
                         K.ragged(np.concatenate(own).view(np.int64), [len(x) for x in own], pa.int64())], names=["node", "hashes"])

    return docs.select("text").mapInArrow(sets, "node string, hashes array<bigint>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union."""
    left, right = (sets.select(F.col("node").alias(x), F.col("hashes").alias(f"_{x}")) for x in "ab")
    both = F.size(F.array_intersect("_a", "_b"))
    return pairs.join(left, "a").join(right, "b").where(100 * both >= percent * (F.size("_a") + F.size("_b") - both)).select("a", "b")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, component) after the links (a, b) between nodes."""
    for x in "ab":
        links = links.join(labels.select(F.col("node").alias(x), F.col("component").alias(f"_{x}")), x).drop(x).withColumnRenamed(f"_{x}", x)
    joined = connected_components(links).toDF("component", "_to")
    return store(labels.join(joined, "component", "left").select("node", F.coalesce("_to", "component").alias("component")))


def outlier_links(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) across components within the buckets of ``placed`` (bucket, node, component).

    An arena is a component with the outliers nominated to it, or the
    outliers of a bucket; its two sides are dealt to blocks, and every left
    block meets every right block."""
    sizes = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("bucket").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "component")).alias("top")).where("parts > 1")
    top = F.when(F.col("top.n") > 1, F.col("top.component"))
    mixed = store(placed.join(largest.select("bucket", top.alias("top")), "bucket").where(F.col("top").isNull() | (F.col("component") != F.col("top"))))
    to_top = mixed.where("top IS NOT NULL").select(F.concat(F.lit("c"), "top").alias("arena"), "node", "component").distinct()
    tops = to_top.select("arena").distinct()
    of_top = placed.select(F.concat(F.lit("c"), "component").alias("arena"), "node", "component").distinct().join(tops, "arena", "left_semi")
    several = mixed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    rest = mixed.join(several, "bucket").select(F.concat(F.lit("b"), F.col("bucket").cast("string")).alias("arena"), "node", "component")
    sides = store(
        to_top.withColumn("side", F.lit(0)).unionByName(of_top.withColumn("side", F.lit(1)))
        .unionByName(rest.withColumn("side", F.lit(0))).unionByName(rest.withColumn("side", F.lit(1))))
    blocks = sides.groupBy("arena").agg(*(F.ceil(F.sum((F.col("side") == i).cast("int")) / BLOCK).cast("int").alias(f"_{i}") for i in (0, 1)))
    dealt = sides.join(blocks, "arena").join(sets, "node")
    own = lambda i: F.pmod(F.xxhash64(F.lit(i), "node"), F.col(f"_{i}")).cast("int")
    all_of = lambda i: F.explode(F.sequence(F.lit(0), F.col(f"_{i}") - 1))
    left = dealt.where("side = 0").withColumn("i", own(0)).withColumn("j", all_of(1)).select("arena", "i", "j", "node", "component", "hashes")
    right = dealt.where("side = 1").withColumn("j", own(1)).withColumn("i", all_of(0)).select(
        *(F.col(c).alias(f"_{c}") for c in ("arena", "i", "j", "node", "component", "hashes")))

    def compare(one: pa.Table, other: pa.Table) -> pa.Table:
        out = merging_links(*(_sets_of(t) for t in (one, other)), percent) if one.num_rows and other.num_rows else []
        return pa.table({x: pa.array([link[i] for link in out], pa.string()) for i, x in enumerate("ab")})

    keys = ["arena", "i", "j"]
    return left.groupBy(*keys).cogroup(right.groupBy(*(f"_{k}" for k in keys))).applyInArrow(compare, "a string, b string").distinct()


def _sets_of(table: pa.Table) -> tuple[list[str], list[str], list[np.ndarray]]:
    nodes, components, lists = table.columns[-3:]
    lists = lists.combine_chunks()
    flat, at = np.asarray(lists.flatten()), np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
    return nodes.to_pylist(), components.to_pylist(), [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def merging_links(left: tuple, right: tuple, percent: int) -> list[tuple[str, str]]:
    """Links between the two sides that join components not yet joined by an earlier one."""
    nodes, components, sets = right
    long = np.array([len(x) for x in sets])
    flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), long)
    order = np.argsort(flat, kind="stable")
    flat, of = flat[order], of[order]
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    out = []
    for node, component, own in zip(*left, strict=True):
        first, last = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
        count = last - first
        at = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        both = np.bincount(of[at], minlength=len(sets))
        for i in np.flatnonzero(100 * both >= percent * (len(own) + long - both)).tolist():
            a, b = root(component), root(components[i])
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((node, nodes[i]))
    return out


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, text_md5, n_shingles, component_id, kept), one row per row of ``docs`` (doc_id, text, any others)."""
    signed = store(signatures(docs, shingle))
    nodes = store(signed.where("node IS NOT NULL").groupBy("node", "n_shingles").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_md5")).alias("first"), F.any_value("bands").alias("bands")))
    entries = nodes.select("node", "n_shingles", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    members = store(entries.join(shared, "bucket"))
    member_ids = members.select("node").distinct().join(nodes, "node").select(F.col("first.doc_id").alias("_id")).distinct()
    texts = docs.select("doc_id", "text").join(member_ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    sets = store(full_sets(texts, shingle).groupBy("node").agg(F.any_value("hashes").alias("hashes")))
    labels = store(members.select("node", F.col("node").alias("component")).distinct())
    for turn in range(STAR_ROUNDS):
        placed = members.join(labels, "node")
        if turn:
            placed = placed.where("held > 2")  # a bucket of two has had its one pair tested
        buckets = placed.groupBy("bucket").agg(
            F.min("component").alias("_low"), F.max("component").alias("_high"),
            F.min(F.struct(F.xxhash64(F.lit(turn), "node").alias("draw"), "node", "component", "n_shingles")).alias("centre"))
        placed = placed.join(buckets.where("_low <> _high").select("bucket", "centre"), "bucket").where("component <> centre.component")
        low, high = F.least("n_shingles", "centre.n_shingles"), F.greatest("n_shingles", "centre.n_shingles")
        pairs = placed.where(100 * low >= percent * high).select(F.least("node", "centre.node").alias("a"), F.greatest("node", "centre.node").alias("b"))
        labels = merged(labels, confirmed(pairs.distinct(), sets, percent))
    labels = merged(labels, outlier_links(members.where("held > 2").join(labels, "node").select("bucket", "node", "component"), sets, percent))
    named = nodes.select("node", "first").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("first").alias("first"))
    placed = named.select("node", "component").join(smallest, "component").select(
        "node", F.col("first.doc_id").alias("_id"), F.col("first.text_md5").alias("_md5"), F.lit(True).alias("_in"))
    result = signed.select("doc_id", "text_md5", "n_shingles", "node").join(placed, "node", "left")
    first = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("text_md5").eqNullSafe(F.col("_md5"))
    return result.select(
        "doc_id", "text_md5", "n_shingles", F.when(F.col("_in"), F.col("_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("_in"), first).otherwise(F.lit(True)).alias("kept"))
