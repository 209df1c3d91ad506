"""Benchmark decontamination: size-partitioned MinHash containment search, verified on exact shingles.

An item is contained in a document if at least ``percent`` of its distinct
5-word shingles (lower-cased A-Z) occur in the document. Whole documents are
far larger than items, which would make their MinHashes useless, so both are
partitioned by size: an item of 2**k to 2**(k+1)-1 shingles is compared with
windows of 3 * 2**k shingles at steps of 2**k, in which any passage as long as
the item lies wholly. Jaccard similarity of a contained item and such a window
is at least 0.25; one of 32 minima agrees with probability 1 - 0.75**32 =
0.9999, for whole items of middling size 0.999999. Items of fewer than
``TINY`` shingles are nominated by each shingle instead.

A window's minima come from block minima: each shingle is hashed once per
permutation, larger classes take minima of pairs of blocks. A Bloom filter of
2**``BITS`` bits of the items' keys (that size, whatever the benchmark's) drops
windows without any item's key inside the scan; the rest meet the item keys
in a shuffle join, and nominated pairs are verified on full sets.

Texts of 1 to 4 words have one shingle, the whole sequence. Items so short are
looked up among the documents' runs of as many words, so they too are found
inside long documents. Null or empty
texts contain nothing and are contained in nothing. Repeated rows give
repeated results. Documents without doc_id are reported with null doc_id;
``text_md5`` tells them apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm import kernels as K
from marketlens.llm.minhash import permutations
from marketlens.llm.shared import store

PERMUTATIONS = 32
TINY = 8
BITS = 25
_SEED = 8


def _keys(values: np.ndarray, size_class: int, permutation: int) -> np.ndarray:
    salt = np.uint64((size_class * 64 + permutation + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    return (values + salt) * np.uint64(0xFF51AFD7ED558CCD)


def item_sets(items: DataFrame, shingle: int) -> DataFrame:
    """(item_id, n_item, hashes, keys) of every item that has words."""
    kind = items.schema["item_id"].dataType
    schema = T.StructType([T.StructField("item_id", kind), T.StructField("n_item", T.LongType()),
                           T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("keys", T.ArrayType(T.LongType()))])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times, xors = permutations(PERMUTATIONS, _SEED)
        for batch in batches:
            for at, to, hashes, bounds in K.shingle_slices(batch.column(1), shingle):
                own = [np.unique(hashes[bounds[i] : bounds[i + 1]]) for i in range(to - at)]
                keys = []
                for x in own:
                    if len(x) >= TINY:
                        low = ((x[None, :] ^ xors[:, None]) * times[:, None]).min(axis=1)
                        size_class = len(x).bit_length() - 1
                        keys.append(np.concatenate([_keys(low[p : p + 1], size_class, p) for p in range(PERMUTATIONS)]))
                    else:
                        keys.append(_keys(x, 0, 0))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), pa.array([len(x) for x in own], pa.int64()),
                     K.ragged(np.concatenate(own).view(np.int64), [len(x) for x in own], pa.int64()),
                     K.ragged(np.concatenate(keys).view(np.int64), [len(x) for x in keys], pa.int64())], names=schema.names)

    return items.select("item_id", "text").mapInArrow(build, schema).where("n_item > 0")


def key_bitmap(item_keys: DataFrame) -> np.ndarray:
    """Bloom filter of the keys, two positions each; at most 2**(BITS-6) rows come to the driver."""
    places = item_keys.select(F.explode(F.array(
        F.shiftrightunsigned("key", 64 - BITS), F.shiftrightunsigned("key", 39 - BITS).bitwiseAND((1 << BITS) - 1))).alias("at"))
    words = places.groupBy(F.shiftrightunsigned("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS int))")).alias("bits"))
    found = words.toArrow()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[np.asarray(found.column("word"))] = np.asarray(found.column("bits"))
    return np.unpackbits(out.view(np.uint8), bitorder="little")


def _window_hits(hashes: np.ndarray, bounds: np.ndarray, size_classes: list[int], bitmap: np.ndarray,
                 times: np.ndarray, xors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, key) of the windows' keys that are in the bitmap, over a slice."""
    docs, keys = [], []

    def look(values: np.ndarray, of: np.ndarray, size_class: int, permutation: int) -> None:
        key = _keys(values, size_class, permutation)
        hit = np.flatnonzero(bitmap[key >> np.uint64(64 - BITS)])
        hit = hit[bitmap[(key[hit] >> np.uint64(39 - BITS)) & np.uint64((1 << BITS) - 1)] > 0]
        docs.append(of[hit])
        keys.append(key[hit])

    counts = np.diff(bounds)
    if 0 in size_classes:
        look(hashes, np.repeat(np.arange(len(counts)), counts), 0, 0)
    classes = [c for c in size_classes if c]
    if classes and len(hashes):
        levels = []  # per size class: starts of its blocks (in shingles, then in blocks of the class below), their documents
        block = 1 << classes[0]
        n = -(-counts // block)
        first = np.concatenate([[0], np.cumsum(n)])
        at = np.arange(first[-1]) - np.repeat(first[:-1], n)
        levels.append((at * block + np.repeat(bounds[:-1], n), np.repeat(np.arange(len(counts)), n)))
        for _ in range(classes[0], classes[-1]):
            n, below = -(-n // 2), first
            first = np.concatenate([[0], np.cumsum(n)])
            at = np.arange(first[-1]) - np.repeat(first[:-1], n)
            levels.append((at * 2 + np.repeat(below[:-1], n), np.repeat(np.arange(len(counts)), n)))
        for p in range(PERMUTATIONS):
            values = (hashes ^ xors[p]) * times[p]
            for size_class, (starts, of) in zip(range(classes[0], classes[-1] + 1), levels, strict=True):
                values = np.minimum.reduceat(values, starts)
                if size_class in classes:
                    window = values.copy()
                    for step in (1, 2):
                        same = of[step:] == of[:-step]
                        np.minimum(window[:-step], values[step:], out=window[:-step], where=same)
                    look(window, of, size_class, p)
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(docs), np.concatenate(keys)


def _short_hits(hashes: np.ndarray, bounds: np.ndarray, bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, key, hash) of the shingles whose keys, as those of tiny items, are in the bitmap."""
    key = _keys(hashes, 0, 0)
    hit = np.flatnonzero(bitmap[key >> np.uint64(64 - BITS)])
    hit = hit[bitmap[(key[hit] >> np.uint64(39 - BITS)) & np.uint64((1 << BITS) - 1)] > 0]
    return np.searchsorted(bounds, hit, "right") - 1, key[hit], hashes[hit]


def contained_items(docs: DataFrame, items: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, text_md5, item_id, n_item, n_shared) of every contained item; ``docs``: doc_id, text; ``items``: item_id, text."""
    spark = docs.sparkSession
    built = store(item_sets(items, shingle))
    item_keys = built.select("item_id", F.explode("keys").alias("key"))
    tiny = F.col("n_item") < TINY
    size_class = F.when(tiny, 0).otherwise(F.floor(F.log2("n_item") + 1e-9)).cast("int")
    size_classes = sorted(r[0] for r in built.select(size_class.alias("c")).distinct().collect())  # at most 64
    bitmap = spark.sparkContext.broadcast(key_bitmap(item_keys))
    length = F.size(F.regexp_extract_all(F.col("text"), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    short = sorted(r[0] for r in items.select(length.alias("n")).where(F.col("n").between(1, shingle - 1)).distinct().collect())  # under ``shingle`` numbers
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("text_md5", T.StringType()), T.StructField("node", T.StringType()),
                           T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("hashes", T.ArrayType(T.LongType()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times, xors = permutations(PERMUTATIONS, _SEED)
        bits = bitmap.value
        for batch in batches:
            ids = batch.column(0)
            data, offsets, _ = K.text_buffers(batch.column(1))
            for at, to, part, local in K.slices(data, offsets):
                lower = K.LOWER[part]
                starts, ends, of = K.word_spans(lower, local)
                words = K.span_hash(K.prefix_hash(lower), starts, ends)
                hashes, bounds = K.shingles(words, of, to - at, shingle)
                found, keys = _window_hits(hashes, bounds, size_classes, bits, times, xors)
                runs = [_short_hits(*K.shingles(words, of, to - at, k, like=shingle), bits) for k in short]
                brief = {}  # document: its runs that may be items of fewer than ``shingle`` words
                for docs_of, own_keys, own_hashes in runs:
                    found, keys = np.append(found, docs_of), np.append(keys, own_keys)
                    for i, h in zip(docs_of.tolist(), own_hashes, strict=True):
                        brief.setdefault(i, []).append(h)
                rows, texts, nodes, own_keys, own = [], [], [], [], []
                order = np.argsort(found, kind="stable")
                hit, first = np.unique(found[order], return_index=True)
                for i, mine in zip(hit.tolist(), np.split(keys[order], first[1:]) if len(hit) else [], strict=True):
                    unique = np.unique(np.append(hashes[bounds[i] : bounds[i + 1]], np.array(brief.get(i, []), np.uint64)))
                    rows.append(at + i)
                    texts.append(md5(part[local[i] : local[i + 1]]).hexdigest())
                    nodes.append(xxhash.xxh3_128_hexdigest(unique))
                    own_keys.append(np.unique(mine))
                    own.append(unique)
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(rows)), pa.array(texts, pa.string()), pa.array(nodes, pa.string()),
                         K.ragged(np.concatenate(own_keys).view(np.int64), [len(x) for x in own_keys], pa.int64()),
                         K.ragged(np.concatenate(own).view(np.int64), [len(x) for x in own], pa.int64())], names=schema.names)

    hits = store(docs.select("doc_id", "text").mapInArrow(scan, schema))
    pairs = hits.select("node", F.explode("keys").alias("key")).distinct().join(item_keys, "key").select("node", "item_id").distinct()
    sets = hits.groupBy("node").agg(F.any_value("hashes").alias("_doc"))
    shared = F.size(F.array_intersect("_item", "_doc"))
    verified = (
        pairs.join(built.select("item_id", "n_item", F.col("hashes").alias("_item")), "item_id")
        .join(sets, "node").withColumn("n_shared", shared.cast("long")).where(100 * F.col("n_shared") >= percent * F.col("n_item"))
        .select("node", "item_id", "n_item", "n_shared")
    )
    return hits.select("doc_id", "text_md5", "node").join(verified, "node").drop("node")
