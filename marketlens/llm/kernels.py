"""Vectorised byte and word kernels used inside ``mapInArrow`` functions.

Texts are read straight from Arrow's string buffers as UTF-8 bytes; no Python
string is made. A batch is cut into slices of about ``SLICE`` bytes on
document boundaries, so memory does not grow with the batch; a longer
document is a slice of its own and is never cut.

Words are maximal runs of bytes other than space and 0x09-0x0D. Hashes are
64-bit: a polynomial over the bytes modulo 2**64, finished with a mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 4 << 20
BASE, SECOND_BASE = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD1B54A32D192ED03)
INVERSE, SECOND_INVERSE = (np.uint64(pow(int(b), -1, 1 << 64)) for b in (BASE, SECOND_BASE))



class _WorkerCache(dict):
    """Empty again in every process that it is pickled to."""

    def __reduce__(self):
        return _WorkerCache, ()


_POWERS = _WorkerCache()


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept, if not much longer than a slice."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, min(SLICE + 4096, 4 * n), 1), base, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have)
        if len(have) <= 2 * SLICE + 4096:
            _POWERS[int(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, is_null) of a string column; nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    null = np.asarray(column.is_null())
    if null.any():
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets, null


def slices(data: np.ndarray, offsets: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) of about ``size`` bytes each."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        to = min(to, n)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every word of a slice."""
    return runs(~_SPACE[data], offsets)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of the maximal runs of True; runs end with their document."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def prefix_hash(data: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    """P with P[j] - P[i] = polynomial of bytes i..j-1, shifted by i."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(base, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span's bytes; equal bytes, equal hash, wherever they lie."""
    h = (prefix[ends] - prefix[starts]) * powers(INVERSE, len(prefix))[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingles(words: np.ndarray, word_docs: np.ndarray, n_docs: int, k: int, like: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words, and bounds: document d has hashes bounds[d]..bounds[d+1]-1.

    A document of 1 to k-1 words has one hash, that of its whole sequence.
    Documents without words have none. With ``like`` > k the hashes are those
    that a sequence of k words has among shingles of ``like`` words."""
    counts = np.bincount(word_docs, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(counts)])
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1], n) + np.repeat(first[:-1], n)
    length = np.repeat(np.minimum(counts, k), n)
    h = length.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    padded = np.concatenate([words, np.zeros(like or k, np.uint64)])
    for j in range(like or k):
        h = h * np.uint64(0xE7037ED1A0B428DB) + np.where(length > j, padded[at + j], np.uint64(j + 1))
    return mix(h), bounds


def shingle_slices(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, shingle hashes, bounds) over the lower-cased (A-Z) words of a column."""
    data, offsets, _ = text_buffers(column)
    for at, to, part, local in slices(data, offsets):
        part = LOWER[part]
        starts, ends, docs = word_spans(part, local)
        words = span_hash(prefix_hash(part), starts, ends)
        yield at, to, *shingles(words, docs, to - at, k)


def ragged(values: np.ndarray, lengths: list[int], kind: pa.DataType) -> pa.Array:
    """List array from flat values."""
    offsets = np.concatenate([[0], np.cumsum(np.asarray(lengths, dtype=np.int64))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
