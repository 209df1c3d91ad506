"""Removal of substrings that repeat, found blockwise on a difference cover.

A byte goes if a string of ``width`` bytes that covers it also starts anywhere
else, in the same text or in another. Sorting all suffixes takes many times
the text; a difference cover D modulo v (for every shift there is a residue
that two positions so shifted have in common) makes a sample enough:

1. Suffixes at positions in D (mod v) are dealt to suffix buckets, one bucket
   is sorted at a time, and suffixes that agree in their first width - v + 1
   bytes get one rank. Two equal strings of ``width`` bytes have a cover sample
   of equal rank at a common offset below v, so only samples whose rank is
   shared go on.
2. Samples of a shared rank are told apart by all that the windows around
   them can see, v - 1 bytes on either side. Where samples agree in that, all
   windows that contain them repeat: long ties end here, whatever their length.
3. The other windows around samples of ranks with differing contexts are
   ordered bucket by bucket; equal neighbours repeat.

The search runs twice: over all texts at ``short`` bytes, for the column
``n_repeated``, and at ``width`` bytes over the texts that have so long a run
of short repeats, which all texts with a string of ``width`` bytes to lose do.

A rank is a hash of 64 bits, that only nominates; where bytes are taken to
repeat, a second, independent hash of 32 bits agrees too (contexts: 160 bits
with the rank), and texts have numbers of their own. Suffixes are ordered by the hash of their rank bytes and not by the
bytes, which would take as many more bytes to every bucket. Memory: one bucket
and one text (a text's arrays take some 30 times its bytes). Copies of a text
are one text; it repeats wholly if it has ``width`` bytes. Texts shorter than
that, empty and null ones lose nothing. Rows without doc_id are rows like
others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm import blocks as B
from marketlens.llm import kernels as K
from marketlens.llm import packed as P
from marketlens.llm.packed import ENTRIES
from marketlens.llm.shared import store

WIDTH, SHORT = 400, 200
# primes; a cover of order q has q + 1 residues modulo q**2 + q + 1
ORDER, SHORT_ORDER = 13, 7
_RESOLVED, _OPEN, _WINDOW = 1, 2, 4


def difference_cover(q: int) -> tuple[int, np.ndarray]:
    """(v, D): a perfect difference set, the zeros of a linear recurrence of order 3 modulo the prime q."""
    v = q * q + q + 1
    for a, b, c in product(range(q), range(q), range(1, q)):
        s = [0, 0, 1]
        while len(s) < v:
            s.append((a * s[-1] + b * s[-2] + c * s[-3]) % q)
        d = np.flatnonzero(np.array(s) == 0)
        if len(d) == q + 1 and len(np.unique((d[:, None] - d) % v)) == v:
            return v, d
    raise ValueError(f"no difference set of order {q}")


class _Hashes:
    """Hashes of the spans of a slice, ``second`` independent of ``first``."""

    def __init__(self, data: np.ndarray, both: bool = False):
        self._first = K.prefix_hash(data), K.powers(K.INVERSE, len(data) + 1)
        self._second = (K.prefix_hash(data, K.SECOND_BASE), K.powers(K.SECOND_INVERSE, len(data) + 1)) if both else None

    @staticmethod
    def _of(tables: tuple[np.ndarray, np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        prefix, inverse = tables
        return K.mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))

    def first(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self._of(self._first, starts, ends)

    def second(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """32 bits."""
        return (self._of(self._second, starts, ends) >> np.uint64(32)).astype(np.uint32)


def _cover(lengths: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Mask over ``lengths`` positions of those in any interval first..last (inclusive)."""
    steps = np.bincount(first, minlength=lengths + 1) - np.bincount(last + 1, minlength=lengths + 1)[: lengths + 1]
    return np.cumsum(steps)[:lengths] > 0


def _repeats(texts: DataFrame, size: int, n_texts: int, width: int, order: int) -> DataFrame:
    """Findings (text_bucket, block) on the places of ``texts`` (tag, text) where strings of ``width`` bytes repeat."""
    v, cover = difference_cover(order)
    reach = v - 1
    rank_bytes = width - reach
    if rank_bytes < 1:
        raise ValueError("width must be larger than the cover's modulus")
    n_samples = max(1, -(-size * len(cover) // v // P.ENTRIES))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tags, held = B.tags_of(batch), []
            for at, to, data, offsets in B.text_slices(batch):
                hashes, long = _Hashes(data), np.diff(offsets)
                rounds = np.where(long >= width, -(-long // v), 0)
                base = np.repeat(offsets[:-1], rounds) + v * (np.arange(rounds.sum()) - np.repeat(np.cumsum(rounds) - rounds, rounds))
                of = np.repeat(np.arange(to - at), rounds * len(cover))
                starts = (base[:, None] + cover).reshape(-1)
                fits = starts + rank_bytes <= offsets[1:][of]
                starts, of = starts[fits], of[fits]
                held.append((hashes.first(starts, starts + rank_bytes), tags[at + of], starts - offsets[of]))
                if sum(len(h[0]) for h in held) >= ENTRIES or to == batch.num_rows:
                    names, own, pos = (np.concatenate(x) for x in zip(*held, strict=True))
                    held = []
                    yield B.entry_rows(n_samples, n_texts, names, own, pos, (names,))

    entries = texts.mapInArrow(sample, P.ENTRY_SCHEMA)
    flagged = store(P.decided(entries, n_texts, _rank_shared, 1))
    n_flagged = max(1, -(-_entries(flagged) // P.ENTRIES))

    def contexts(table: pa.Table, found: dict) -> pa.Table:
        rows = []
        for names, own, pos, around, check in _each_text(table, found, lambda hashes, begin, end, p, code: _context(
                hashes, begin, end, p, reach, rank_bytes, width)):
            rows.append(B.entry_rows(n_flagged, n_texts, names, own, pos, (names, around, check), around, check))
        return pa.Table.from_batches(rows, _ENTRY_ARROW)

    resolved = store(P.decided(P.with_findings(texts, n_texts, flagged, contexts, P.ENTRY_SCHEMA), n_texts, _compare_contexts, _RESOLVED))
    n_windows = max(1, -(-_entries(resolved, _OPEN) * v // P.ENTRIES // 2))

    def windows(table: pa.Table, found: dict) -> pa.Table:
        rows = []
        for names, own, pos, check in _each_text(table, found, lambda hashes, begin, end, p, code: _windows(
                hashes, begin, end, p, code, reach, width)):
            rows.append(B.entry_rows(n_windows, n_texts, names, own, pos, (names, check), check))
        return pa.Table.from_batches(rows, _ENTRY_ARROW)

    opened = P.with_findings(texts, n_texts, resolved, windows, P.ENTRY_SCHEMA)
    return resolved.unionByName(store(P.decided(opened, n_texts, _window_shared, _WINDOW)))


def _starts(n: int, found: tuple[np.ndarray, np.ndarray] | None, copies: int, width: int, reach: int) -> np.ndarray:
    """Where in a text of ``n`` bytes strings of ``width`` bytes start that start elsewhere too."""
    starts = np.zeros(n, bool)
    if n >= width:
        if copies > 1:
            starts[: n - width + 1] = True
        elif found is not None:
            pos, code = found
            p = pos[(code & _RESOLVED) > 0]
            last = np.minimum(p, n - width)
            first = np.maximum(p - reach, 0)
            starts |= _cover(n, first[first <= last], last[first <= last])
            starts[pos[(code & _WINDOW) > 0]] = True
    return starts


def _covered(starts: np.ndarray, width: int) -> np.ndarray:
    at = np.flatnonzero(starts)
    return _cover(len(starts), at, at + width - 1) if len(starts) else starts


def repeated_substrings(docs: DataFrame, width: int = WIDTH, order: int = ORDER, short: int = SHORT, short_order: int = SHORT_ORDER) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated) of every row of ``docs`` (doc_id, text, any others).

    ``n_repeated``: bytes covered by strings of ``short`` bytes that also start elsewhere; nothing is removed for them."""
    if short > width:
        raise ValueError("short must not be larger than width")
    texts, size, n_texts = P.distinct_texts(docs, numbered=True)
    reach, short_reach = difference_cover(order)[0] - 1, difference_cover(short_order)[0] - 1
    brief = _repeats(texts.select("tag", "text"), size, n_texts, short, short_order)

    def mark(table: pa.Table, found: dict) -> pa.Table:
        tags, copies, rows = B.tags_of(table), table.column("copies").to_pylist(), []
        for at, to, _, offsets in B.text_slices(table):
            for i in range(to - at):
                n = int(offsets[i + 1] - offsets[i])
                starts = _starts(n, found.get(int(tags[at + i])), copies[at + i], short, short_reach)
                run = np.diff(np.concatenate([[-1], np.flatnonzero(~starts), [n]])).max() - 1 if n else 0
                rows.append((int(_covered(starts, short).sum()), bool(run > width - short)))
        repeated, wide = zip(*rows, strict=True) if rows else ((), ())
        text = table.column("text").combine_chunks()
        return pa.table({"md5": table.column("md5"), "tag": table.column("tag"), "copies": table.column("copies"),
                         "n_bytes": pc.binary_length(text).cast(pa.int64()), "n_repeated": pa.array(repeated, pa.int64()),
                         "whole": _digests(text, wide),
                         "text": pc.if_else(pa.array(wide, pa.bool_()), text, pa.scalar(None, pa.string()))})

    marked = store(P.with_findings(texts, n_texts, brief, mark,
                                   "md5 string, tag bigint, copies bigint, n_bytes bigint, n_repeated bigint, whole string, text string"))
    wide = marked.where("text IS NOT NULL").select("tag", "text", "md5", "copies")
    size = wide.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_wide = max(1, -(-size // P.TEXT_BYTES))
    found = _repeats(wide.select("tag", "text"), size, n_wide, width, order)

    def remove(table: pa.Table, found: dict) -> pa.Table:
        out = []
        tags, copies, digests = B.tags_of(table), table.column("copies").to_pylist(), table.column("md5").to_pylist()
        for at, to, data, offsets in B.text_slices(table):
            for i in range(to - at):
                text = data[offsets[i] : offsets[i + 1]]
                starts = _starts(len(text), found.get(int(tags[at + i])), copies[at + i], width, reach)
                gone, spans, rest = B.kept_bytes(text, _covered(starts, width))
                out.append((digests[at + i], gone, spans, sha256(rest).hexdigest()))
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        return pa.table({"md5": pa.array(columns[0], pa.string()), "n_removed": pa.array(columns[1], pa.int64()),
                         "n_spans": pa.array(columns[2], pa.int64()), "kept_sha256": pa.array(columns[3], pa.string())})

    done = P.with_findings(wide, n_wide, found, remove, "md5 string, n_removed bigint, n_spans bigint, kept_sha256 string")
    done = done.withColumnRenamed("md5", "_md5")
    results = marked.drop("text", "tag", "copies").join(done, F.col("md5") == F.col("_md5"), "left").select(
        "md5", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"), "n_repeated")
    rows = docs.select("doc_id", F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("md5"))
    return rows.join(results, "md5").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated")


def _digests(texts: pa.Array, left_out: tuple[bool, ...]) -> pa.Array:
    """SHA-256 of each text, null for those left out."""
    return pa.array([None if out else sha256(t.as_buffer() if t.is_valid else b"").hexdigest() for t, out in zip(texts, left_out, strict=True)], pa.string())


_ENTRY_ARROW = pa.schema([("bucket", pa.int32()), ("block", pa.binary())])


def _entries(found: DataFrame, code: int = 0) -> int:
    """Number of entries in stored findings; with ``code``, of those that carry it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = 0
            for block in batch.column(0).to_pylist():
                codes = B.unpack([block])[2]
                n += int(((codes & code) > 0).sum()) if code else len(codes)
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return found.select("block").mapInArrow(count, "n bigint").agg(F.sum("n")).first()[0] or 0


def _each_text(table: pa.Table, found: dict, make) -> Iterator[tuple[np.ndarray, ...]]:
    """Entries (keys, tags, positions, further columns) of the texts with findings, about ENTRIES at a time."""
    tags, held = B.tags_of(table), []
    for at, to, data, offsets in B.text_slices(table):
        own = [i for i in range(to - at) if int(tags[at + i]) in found]
        if own:
            hashes = _Hashes(data, both=True)
            for i in own:
                keys, pos, *extra = make(hashes, int(offsets[i]), int(offsets[i + 1]), *found[int(tags[at + i])])
                held.append((keys, np.full(len(keys), tags[at + i]), pos, *extra))
        if held and (sum(len(h[0]) for h in held) >= ENTRIES or to == table.num_rows):
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held = []
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _rank_shared(multi: np.ndarray, names: np.ndarray) -> np.ndarray:
    """1 for samples whose rank another one has, but for those that know it already."""
    return B.repeats(names)[1] & ~multi


def _window_shared(multi: np.ndarray, names: np.ndarray, check: np.ndarray) -> np.ndarray:
    return np.where(B.repeats(names, check)[1] & ~multi, _WINDOW, 0)


def _context(hashes: _Hashes, begin: int, end: int, pos: np.ndarray, reach: int, rank_bytes: int, width: int) -> tuple[np.ndarray, ...]:
    """Rank, position and two context hashes of each flagged sample; the context is cut at the text's ends, which enters its hashes."""
    p = np.unique(pos) + begin
    low, high = np.maximum(p - reach, begin), np.minimum(p + width, end)
    cut = ((p - low) * (width + 1) + (high - p)).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return hashes.first(p, p + rank_bytes), p - begin, K.mix(hashes.first(low, high) + cut), hashes.second(low, high)


def _compare_contexts(multi: np.ndarray, names: np.ndarray, around: np.ndarray, check: np.ndarray) -> np.ndarray:
    """RESOLVED where another sample has rank and context; OPEN for one sample of each context, where the rank's contexts differ and one is single."""
    order = np.lexsort((check, around, names))
    n, a, c, m = names[order], around[order], check[order], multi[order]
    new_name = np.concatenate([[True], n[1:] != n[:-1]])
    new = new_name | np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])])
    context = np.cumsum(new) - 1
    many = (np.bincount(context) + np.bincount(context, m)) > 1
    name = np.cumsum(new_name) - 1
    single = np.bincount(name, ~many[context]) > 0
    code = np.zeros(len(names), np.uint8)
    code[order] = np.where(many[context] & ~m, _RESOLVED, 0) | np.where(single[name] & new, _OPEN, 0)
    return code


def _windows(hashes: _Hashes, begin: int, end: int, pos: np.ndarray, code: np.ndarray, reach: int, width: int) -> tuple[np.ndarray, ...]:
    """Hash, position and second hash of the windows around the open samples."""
    n, p = end - begin, pos[(code & _OPEN) > 0]
    last, first = np.minimum(p, n - width), np.maximum(p - reach, 0)
    w = np.flatnonzero(_cover(n, first[first <= last], last[first <= last]))
    return hashes.first(w + begin, w + begin + width), w, hashes.second(w + begin, w + begin + width)
