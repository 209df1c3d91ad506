"""Packed blocks of entries and text helpers, numpy only: these parts run on executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from marketlens.llm import kernels as K

MULTI = np.uint32(1 << 31)


def pack(tags: np.ndarray, pos: np.ndarray, *columns: np.ndarray) -> bytes:
    """Entries ordered by tag runs; columns byte by byte, which compresses better."""
    n = len(pos)
    new = np.flatnonzero(np.concatenate([[True], tags[1:] != tags[:-1]])) if n else np.zeros(0, np.int64)
    columns = (pos.astype(np.uint32), *columns)
    head = np.array([len(new), n, len(columns), *(c.itemsize for c in columns)], np.uint32)
    parts = [head.tobytes(), tags[new].tobytes(), np.diff(np.append(new, n)).astype(np.uint32).tobytes()]
    parts += [np.ascontiguousarray(c).view(np.uint8).reshape(n, c.itemsize).T.tobytes() for c in columns]
    return b"".join(parts)


def unpack(blocks: list[bytes]) -> tuple[np.ndarray, ...]:
    """(tags, positions, columns...) of all blocks; () if there are none."""
    out = []
    for block in blocks:
        runs, n, width = np.frombuffer(block, np.uint32, 3).tolist()
        sizes, at = np.frombuffer(block, np.uint32, width, 12).tolist(), 12 + 4 * width
        tags = np.frombuffer(block, np.uint64, runs, at)
        counts = np.frombuffer(block, np.uint32, runs, at + 8 * runs)
        at += 12 * runs
        columns = [np.repeat(tags, counts)]
        for size in sizes:
            raw = np.frombuffer(block, np.uint8, n * size, at).reshape(size, n).T
            columns.append(np.ascontiguousarray(raw).view(f"u{size}").reshape(n))
            at += n * size
        out.append(columns)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def deal(buckets: np.ndarray, tags: np.ndarray, pos: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, block) of the entries, each block in the order of the entries."""
    if not len(buckets):
        return
    order = np.argsort(buckets, kind="stable")
    found, first = np.unique(buckets[order], return_index=True)
    for bucket, own in zip(found.tolist(), np.split(order, first[1:]), strict=True):
        yield int(bucket), pack(tags[own], pos[own], *(c[own] for c in columns))


def repeats(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is the first with its keys, do its keys occur again); equal in all of the arrays."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    counts = np.diff(np.append(np.flatnonzero(new), len(order)))
    first, again = np.zeros(len(order), bool), np.zeros(len(order), bool)
    first[order[new]] = True
    again[order] = np.repeat(counts > 1, counts)
    return first, again


def entry_rows(n_buckets: int, n_texts: int, keys: np.ndarray, tags: np.ndarray, pos: np.ndarray, same: tuple[np.ndarray, ...],
               *columns: np.ndarray) -> pa.RecordBatch:
    """Rows (bucket, block) of a batch of entries.

    Entries with equal ``same`` are sent once, with MULTI in the position. All
    of them are known to occur again; that goes straight towards their text's
    bucket t, as bucket -1 - t, and never through the bucket of their key."""
    first, again = repeats(*same)
    buckets = (keys % np.uint64(n_buckets)).astype(np.int64)
    marked = pos.astype(np.uint32) | np.where(again, MULTI, np.uint32(0))
    rows = list(deal(buckets[first], tags[first], marked[first], keys[first], *(c[first] for c in columns)))
    rows += [(-1 - t, block) for t, block in deal((tags[again] % np.uint64(n_texts)).astype(np.int64), tags[again], pos[again])]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "block"])


def text_slices(table: pa.Table | pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets, _ = K.text_buffers(table.column("text"))
    yield from K.slices(data, offsets)


def tags_of(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    column = table.column("tag")
    return np.asarray(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).view(np.uint64)


def kept_bytes(text: np.ndarray, removed: np.ndarray) -> tuple[int, int, bytes]:
    """Number of removed bytes, of their maximal runs, and the bytes that stay."""
    starts = removed.copy()
    starts[1:] &= ~removed[:-1]
    return int(removed.sum()), int(starts.sum()), text[~removed].tobytes()
