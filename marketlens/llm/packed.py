"""Shuffles of many small entries (key, text, position) as packed blocks.

Substring operators compare millions of positions. A row per position would
cost far more than its content, so a task sorts its entries into buckets by
key and writes one block of numpy columns per bucket; a reducer unpacks the
blocks of one bucket, sorts its keys, and sends its findings back to the
texts, packed in the same way by text bucket. The numbers of buckets follow
from the size of the input.

Entries of equal keys within a block's batch are sent once, marked ``multi``:
a key that many texts share reaches its bucket at most once per batch. The
positions that a batch so knows to repeat are sent past the key's bucket, to
the bucket of their text, so a key that a third of the texts hold gives each
text bucket its own positions only.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm import blocks as B
from marketlens.llm.shared import store

#: Bytes of text per text bucket, entries per key bucket.
TEXT_BYTES, ENTRIES = 6 << 20, 1 << 20


ENTRY_SCHEMA = "bucket int, block binary"
FOUND_SCHEMA = "text_bucket int, block binary"


def decided(entries: DataFrame, n_texts: int, decide: Callable[..., np.ndarray], known_code: int, with_places: bool = False) -> DataFrame:
    """Rows (text_bucket, block of (tag, position, code)) of the entries with a code other than 0.

    ``decide(multi, keys, columns...)`` gives the codes of all entries of a
    bucket; ``with_places`` adds their tags and positions to its arguments."""

    def reduce(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        tags, pos, *columns = B.unpack(table.column("block").to_pylist())
        if bucket < 0:
            code = np.full(len(tags), known_code, np.uint8)
        else:
            multi = (pos & B.MULTI) > 0
            code = decide(multi, *columns, *((tags, pos & ~B.MULTI) if with_places else ())).astype(np.uint8)
            keep = code > 0
            tags, pos, code = tags[keep], pos[keep] & ~B.MULTI, code[keep]
        order = np.argsort(tags, kind="stable")
        tags, pos, code = tags[order], pos[order], code[order]
        rows = list(B.deal((tags % np.uint64(n_texts)).astype(np.int64), tags, pos, code))
        return pa.table({"text_bucket": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([r[1] for r in rows], pa.binary())})

    return entries.groupBy("bucket").applyInArrow(reduce, FOUND_SCHEMA)


def distinct_texts(docs: DataFrame, numbered: bool = False) -> tuple[DataFrame, int, int]:
    """Stored (md5, tag, text, copies) of the distinct texts (null: empty), their number of bytes, and of text buckets.

    ``tag`` (64 bits) stands for the text in entries: a hash of its md5, or
    with ``numbered`` a number that no other text has. Copies are combined
    before the shuffle, so a text held by a third of the rows is one row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = store(
        docs.select(F.md5(text.cast("binary")).alias("md5"), text.alias("text"))
        .groupBy("md5").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
        .select("md5", (F.monotonically_increasing_id() if numbered else F.xxhash64("md5")).alias("tag"), "text", "copies"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return texts, size, max(1, -(-size // TEXT_BYTES))


def with_findings(texts: DataFrame, n_texts: int, findings: DataFrame, run: Callable[[pa.Table, dict], pa.Table], schema: str) -> DataFrame:
    """``run(table of texts, {tag: (positions, codes)})`` for every text bucket."""
    # the unsigned tag modulo n_texts, as in the findings
    bucket = F.pmod(F.shiftrightunsigned("tag", 32) * F.lit((1 << 32) % n_texts) + F.col("tag").bitwiseAND(0xFFFFFFFF) % n_texts, F.lit(n_texts))

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        found = {}
        blocks = right.column("block").to_pylist()
        if blocks:
            tags, pos, code = B.unpack(blocks)
            order = np.argsort(tags, kind="stable")
            tags, pos, code = tags[order], pos[order].astype(np.int64), code[order]
            first = np.flatnonzero(np.concatenate([[True], tags[1:] != tags[:-1]]))
            for tag, a, b in zip(tags[first].tolist(), first.tolist(), np.append(first[1:], len(tags)).tolist(), strict=True):
                found[tag] = pos[a:b], code[a:b]
        return run(left, found)

    left = texts.withColumn("text_bucket", bucket.cast("int"))
    return left.groupBy("text_bucket").cogroup(findings.groupBy("text_bucket")).applyInArrow(both, schema)


