"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes: shift left by one, add the byte's random
value, so it depends on the last 32 bytes only. Where its top ``BITS`` bits
are 0 a chunk ends; an insertion moves the cuts around it and no others.
A chunk's extent is the chunk and the 32 bytes that made the cut before it (a
text's first chunk has none). Chunks with equal extents are one chunk: the
occurrence in the text with the smallest tag (a hash of the text), there the
first, owns it, and all others repeat it. Every repeated extent goes, however
short, but for bytes in an extent that the text owns. So what goes is kept by
its owner and no content is lost; a chunk of a few bytes goes only after equal
32 bytes. Of a passage in otherwise different texts goes what lies between 32
bytes before its first cut (from its 32nd byte on) and its last cut; nothing
goes of a passage with fewer than two such cuts.

Of the copies of a text, the one with the smallest doc_id is treated as
above, the others repeat it wholly and go, whatever their length.
Rows equal in doc_id and text are one document. Empty and null texts have no
chunks. A cut needs 32 bytes before it in the same text; the last chunk ends
with the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm import blocks as B
from marketlens.llm import packed as P
from marketlens.llm.packed import ENTRIES

BITS = 5
_ROLL = 32
_REPEAT, _OWN = 1, 2


def gear(data: np.ndarray) -> np.ndarray:
    """Gear hash (32 bits) behind every byte, by doubling: sums over 2, 4, ... 32 bytes."""
    table = np.random.default_rng(10).integers(0, 1 << 32, 256, dtype=np.uint32)
    h = table[data]
    step = 1
    while step < _ROLL:
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        step *= 2
    return h


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions in a slice where chunks start: texts' starts, and behind every cut."""
    cut = np.flatnonzero(gear(data) >> np.uint32(32 - BITS) == 0) + 1
    text = np.searchsorted(offsets, cut, "left") - 1  # a cut at a text's end belongs to that text
    cut = cut[cut - offsets[text] >= _ROLL]
    return np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], cut[cut < len(data)]]))


def leads(starts: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Starts of the extents of chunks in texts that start at ``texts``."""
    return np.where(starts > texts, starts - _ROLL, starts)


def covered(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` bytes lie in an extent."""
    depth = np.bincount(starts, minlength=size + 1) - np.bincount(ends, minlength=size + 1)
    return np.cumsum(depth[:size]) > 0


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_chunks, n_shared, n_removed, n_spans, kept_sha256) of every row of ``docs`` (doc_id, text, any others).

    ``n_shared``: bytes in extents that occur elsewhere too, owned ones included."""
    texts, size, n_texts = P.distinct_texts(docs)
    n_buckets = max(1, -(-size // (1 << BITS) // ENTRIES))

    def chop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tags, held = B.tags_of(batch), []
            for at, to, data, offsets in B.text_slices(batch):
                starts = chunk_starts(data, offsets)
                of = np.searchsorted(offsets, starts, "right") - 1
                raw, ends = data.tobytes(), np.append(starts[1:], len(data)).tolist()
                digests = np.fromiter((xxhash.xxh3_64_intdigest(raw[s:e]) for s, e in zip(leads(starts, offsets[of]).tolist(), ends, strict=True)), np.uint64, len(starts))
                held.append((digests, tags[at + of], starts - offsets[of]))
                if sum(len(h[0]) for h in held) >= ENTRIES or to == batch.num_rows:
                    digests, own, pos = (np.concatenate(x) for x in zip(*held, strict=True))
                    order = np.lexsort((pos, own))  # so that the first of a digest is the one that may own it
                    held = []
                    yield B.entry_rows(n_buckets, n_texts, digests[order], own[order], pos[order], (digests[order],))

    def owners(multi: np.ndarray, digests: np.ndarray, tags: np.ndarray, pos: np.ndarray) -> np.ndarray:
        order = np.lexsort((pos, tags, digests))
        d = digests[order]
        new = np.concatenate([[True], d[1:] != d[:-1]])
        group = np.cumsum(new) - 1
        shared = (np.bincount(group) + np.bincount(group, multi[order])) > 1
        code = np.zeros(len(digests), np.uint8)
        code[order] = np.where(shared[group], np.where(new, _OWN, _REPEAT), 0)
        return code

    entries = texts.select("tag", "text").mapInArrow(chop, P.ENTRY_SCHEMA)
    found = P.decided(entries, n_texts, owners, _REPEAT, with_places=True)

    def remove(table: pa.Table, marks: dict) -> pa.Table:
        out, tags, digests = [], B.tags_of(table), table.column("md5").to_pylist()
        for at, to, data, offsets in B.text_slices(table):
            starts = chunk_starts(data, offsets)
            for i in range(to - at):
                text = data[offsets[i] : offsets[i + 1]]
                first = starts[slice(*np.searchsorted(starts, offsets[i : i + 2]))] - offsets[i]
                lead, ends = leads(first, 0), np.append(first[1:], len(text))
                owned, repeated = np.zeros(len(first), bool), np.zeros(len(first), bool)
                if int(tags[at + i]) in marks:
                    pos, code = marks[int(tags[at + i])]
                    owned[np.searchsorted(first, pos[code == _OWN])] = True
                    repeated[np.searchsorted(first, pos[code == _REPEAT])] = True
                    repeated &= ~owned
                kept, again = (covered(lead[x], ends[x], len(text)) for x in (owned, repeated))
                n, spans, rest = B.kept_bytes(text, again & ~kept)
                out.append((digests[at + i], len(text), len(first), int((kept | again).sum()), n, spans, sha256(rest).hexdigest()))
        columns = list(zip(*out, strict=True)) if out else [()] * 7
        return pa.table({name: pa.array(column, pa.string() if name in ("md5", "kept_sha256") else pa.int64()) for name, column in zip(
            ("md5", "n_bytes", "n_chunks", "n_shared", "n_removed", "n_spans", "kept_sha256"), columns, strict=True)})

    done = P.with_findings(texts.select("tag", "text", "md5"), n_texts, found, remove,
                           "md5 string, n_bytes bigint, n_chunks bigint, n_shared bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    rows = docs.select("doc_id", F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("md5"))
    groups = rows.groupBy("md5").agg(F.min("doc_id").alias("_first"), F.count_distinct("doc_id").alias("_ids"))
    copy = ~F.col("doc_id").eqNullSafe(F.col("_first"))
    return (
        rows.join(done.join(groups, "md5"), "md5")
        .select("doc_id", "n_bytes", "n_chunks", F.when(F.col("_ids") > 1, F.col("n_bytes")).otherwise(F.col("n_shared")).alias("n_shared"),
                F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
                F.when(copy, F.least("n_bytes", F.lit(1))).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
                F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"))
    )
