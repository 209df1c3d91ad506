"""Near-duplicate documents by SimHash fingerprints and pigeonhole blocks.

A document's words are lower-cased (A-Z) and split at space and 0x09-0x0D; its
shingles are all runs of ``shingle`` words joined by one space, repeats
included (fewer words: the whole sequence). Bit b of the fingerprint is 1 if
more than half of the shingles' XXH64 values (seed 42) have it. Fingerprints
link at ``distance`` or fewer differing bits.

The 64 bits are split into ``blocks`` blocks. Two close fingerprints differ in
at most ``distance`` of them, so they agree in ``blocks - distance`` others:
each choice of so many blocks is a key, and fingerprints are joined on equal
keys. With 6 blocks and 2 bits these are 15 keys of 42 to 44 bits; a key of one
block would give as few rows but, at 10 billion fingerprints, some 10,000
times the candidates. Equal fingerprints are one entry from the start, so a
key has at most 2**22 entries, however many documents hold them.

Entries are dealt to tasks by a hash of their key. A task sorts the entries by
key and verifies the Hamming distance of candidates: in short runs of equal
keys by comparing neighbours at every offset, in long ones by looking up every
fingerprint reachable by flipping up to ``distance`` bits outside the key.
It returns one link per merged entry (to the smallest fingerprint it reached),
so a dense run gives as many rows as it has entries, and no link is lost.

Texts without words, empty texts and nulls have the fingerprint zero and are
linked like any other. Rows without doc_id take part; a component made of them
alone has component_id null. Repeated rows give repeated results, an empty
table an empty one. Texts are read in pieces of 1 MB; other columns of any
name are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm.graph import connected_components
from marketlens.llm.pieces import pieces
from marketlens.llm.shared import partitions, store

SEED = 42
BLOCKS, DISTANCE = 6, 2
ENTRIES = 1 << 20  # entries a task should hold
SHORT = 32  # longer runs of equal keys are searched by flipped bits
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def fingerprint(raw: bytes, shingle: int) -> int:
    """SimHash of a UTF-8 text as an unsigned number."""
    ones, n, tail = np.zeros(64, np.int64), 0, []
    for part in pieces(raw.lower(), _SPACE):
        words = tail + part.split()
        digests = b"".join([xxhash.xxh64_digest(b" ".join(own), SEED) for own in zip(*(words[i:] for i in range(shingle)), strict=False)])
        if digests:
            ones += _bit_counts(digests)
            n += len(digests) // 8
        tail = words[max(0, len(words) - shingle + 1):]
    if not n and tail:
        ones, n = _bit_counts(xxhash.xxh64_digest(b" ".join(tail), SEED)), 1
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _bit_counts(digests: bytes) -> np.ndarray:
    """How many of the 8-byte digests have each bit, the highest first."""
    return np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, fingerprint as a signed long) of every row."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("fingerprint", T.LongType())])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py() or b"", shingle) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=schema.names)

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(sign, schema)


def block_masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """Bits of each key: every choice of ``blocks - distance`` of the blocks."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    whole = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(whole, blocks - distance)]


def flips(mask: int, distance: int) -> list[int]:
    """All patterns of 1 to ``distance`` bits outside the mask."""
    free = [1 << b for b in range(64) if not mask >> b & 1]
    return [sum(own) for n in range(1, distance + 1) for own in combinations(free, n)]


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give the entries a[i] and b[i] one label, the smallest of all that are joined; labels are entries."""
    while True:
        one, other = label[a], label[b]
        apart = one != other
        if not apart.any():
            return
        a, b, one, other = a[apart], b[apart], one[apart], other[apart]
        np.minimum.at(label, np.maximum(one, other), np.minimum(one, other))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def joined(fps: np.ndarray, mask: int, distance: int) -> np.ndarray:
    """For sorted distinct fingerprints, the index of the smallest one reached through links among equal ``fps & mask``."""
    label = np.arange(len(fps))
    order = np.lexsort((fps, fps & np.uint64(mask)))
    key = (fps & np.uint64(mask))[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    length = np.diff(np.append(first, len(fps)))
    length = np.repeat(length, length)
    short = order[(length > 1) & (length <= SHORT)]
    own = fps[short] & np.uint64(mask)
    for step in range(1, min(SHORT, len(short))):
        at = np.flatnonzero(own[step:] == own[:-step])
        if not len(at):
            break
        a, b = short[at], short[at + step]
        near = np.bitwise_count(fps[a] ^ fps[b]) <= distance
        merge(label, a[near], b[near])
    long = np.sort(order[length > SHORT])
    if len(long):
        held = fps[long]
        for flip in flips(mask, distance):
            wanted = held ^ np.uint64(flip)
            at = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
            hit = np.flatnonzero((held[at] == wanted) & (wanted > held))
            merge(label, long[hit], long[at[hit]])
    return label


def links(prints: DataFrame, blocks: int = BLOCKS, distance: int = DISTANCE) -> DataFrame:
    """(a, b): links that join every pair of distinct fingerprints at ``distance`` or fewer bits; ``prints``: fingerprint, distinct."""
    masks = block_masks(blocks, distance)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    n = prints.count()
    n_tasks = max(partitions(prints.sparkSession), -(-n * len(masks) // ENTRIES))
    keyed = prints.select("fingerprint", F.posexplode(F.array(*[F.col("fingerprint").bitwiseAND(F.lit(m)) for m in signed])).alias("choice", "key"))
    dealt = keyed.select(F.pmod(F.xxhash64("choice", "key"), F.lit(n_tasks)).alias("task"), F.col("choice").cast("byte").alias("choice"), "fingerprint")

    def verify(table: pa.Table) -> pa.Table:
        choice, fps = np.asarray(table.column("choice")), np.asarray(table.column("fingerprint")).view(np.uint64)
        out = []
        for i in np.unique(choice).tolist():
            own = np.sort(fps[choice == i])
            label = joined(own, masks[i], distance)
            moved = np.flatnonzero(label != np.arange(len(own)))
            out.append((own[moved], own[label[moved]]))
        a, b = (np.concatenate(x).view(np.int64) for x in zip(*out, strict=True))
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return dealt.groupBy("task").applyInArrow(verify, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int = 5, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, fingerprint as 16 hexadecimal digits, component_id) of every row of ``docs`` (doc_id, text, any others)."""
    signed = store(fingerprints(docs, shingle))
    prints = store(signed.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    labels = connected_components(links(prints.select("fingerprint"), blocks, distance)).toDF("fingerprint", "component")
    named = prints.join(labels, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    placed = named.select("fingerprint", "component").join(smallest, "component").select("fingerprint", "component_id")
    return signed.join(placed, "fingerprint").select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
