"""Spelling variants: words that differ by one inserted, deleted or replaced code point, grouped under their commonest form.

Every word is placed in a trie by its letter-group counts: letters fall into
``GROUPS`` groups, and level l branches on how many letters of the l-th group
the word has (groups in order of the variance of their counts over the
vocabulary, so the first levels tell most). Two words one edit apart have
equal counts, or one has one letter more in one group (the surplus) and, if
it was a replacement, one less in another (the deficit). The search walks down
the trie with a budget of one each; words of the leaves it reaches are
verified. Of a pair only the word whose first difference is the surplus asks,
so each pair is found once and counted for both.

On the cluster the first levels are the shuffle key: a word goes to its own
prefix, and asks at all prefixes within its budget. Their number of levels
grows with the logarithm of the vocabulary, so a prefix's share does not. A
prefix with more than ``BLOCK`` words, or asked by more than ``ASKS``, is split
into blocks of words and blocks of asks that each meet in one task; there the
rest of the trie is built and searched depth first, a block of asks at a time.
A task returns one row per word and not per pair: its number of near words and
the commonest of them.

A word's form is its near word of largest count (ties: the smallest in
code-point order), if that has at least ``ratio`` times its own count; forms
are followed to the last by pointer doubling, at most log2(log2(counts)) rounds.

Null and empty texts have no words. Runs whose deletion leaves fewer than
``least_length`` code points are dropped with the short ones; a null doc_id is
written as nothing before the colon. Repeated rows count again. Empty tables
give empty results. Texts are read in pieces of 1 MB, words are never cut;
other columns of any name are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.pieces import pieces
from marketlens.llm.shared import partitions, store

GROUPS = 32
BLOCK, ASKS = 1 << 15, 1 << 17
_HELD = 1 << 18  # words a task counts before it passes them on
_CHUNK = 1 << 17  # search states expanded at a time
_LEAF = 4  # nodes of so few words are not divided further
_RUN, _GAP = re.compile("[a-zA-ZÀ-ÿ]+"), re.compile("[^a-zA-ZÀ-ÿ]")


def word_counts(docs: DataFrame, least_length: int, thinning: int) -> DataFrame:
    """(word, n) over all texts; of one in ``thinning`` (document, run) pairs the run loses a code point."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            words, counts = list(held), list(held.values())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                start = crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for part in pieces((raw.as_py() or b"").lower().decode(), _GAP):  # bytes: only A-Z
                    for run, n in Counter(_RUN.findall(part)).items():
                        h = crc32(run.encode(), start)
                        if h % thinning == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1:]
                        if len(run) >= least_length:
                            held[run] += n
                if len(held) >= _HELD:
                    yield flush()
        yield flush()

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def letter_group(code_points: np.ndarray) -> np.ndarray:
    """a-z: a group each; other letters share the rest by code point."""
    ascii_letter = (code_points >= 97) & (code_points <= 122)
    return np.where(ascii_letter, code_points - 97, 26 + code_points % (GROUPS - 26)).astype(np.int64)


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points, and bounds: word i has bounds[i]..bounds[i + 1] - 1."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    return flat, np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)


def count_vectors(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Letter-group counts of each word, at most 200 of a group (more differ by as little)."""
    n = len(bounds) - 1
    of = np.repeat(np.arange(n), np.diff(bounds))
    counts = np.bincount(of * GROUPS + letter_group(flat), minlength=n * GROUPS)
    return np.minimum(counts, 200).astype(np.uint8).reshape(n, GROUPS)


def level_order(words: DataFrame) -> list[int]:
    """Letter groups by falling variance of their counts over all words."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = count_vectors(*code_points(batch.column(0).to_pylist())).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(GROUPS), pa.int32()), pa.array(np.full(GROUPS, len(v))), pa.array(v.sum(axis=0)), pa.array((v * v).sum(axis=0))],
                    names=["g", "n", "s", "q"])

    found = words.select("word").mapInArrow(moments, "g int, n bigint, s bigint, q bigint").groupBy("g").agg(F.sum("n"), F.sum("s"), F.sum("q")).collect()
    variance = {g: q / n - (s / n) ** 2 for g, n, s, q in found}  # GROUPS rows
    return sorted(range(GROUPS), key=lambda g: (-variance.get(g, 0.0), g))


def asked_prefixes(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, prefix) for all prefixes that a word's search enters: none, a surplus, or a surplus and a later deficit."""
    n, depth = vectors.shape
    at, out = [np.arange(n)], [vectors]
    for i in range(depth):
        more = vectors.copy()
        more[:, i] += 1
        at.append(np.arange(n))
        out.append(more)
        for j in range(i + 1, depth):
            fits = np.flatnonzero(vectors[:, j])
            less = more[fits]
            less[:, j] -= 1
            at.append(fits)
            out.append(less)
    return np.concatenate(at), np.concatenate(out)


def search(asks: np.ndarray, spent: tuple[np.ndarray, np.ndarray], tree: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates (ask, row of ``tree``): rows whose counts can be reached with the surplus and deficit not yet spent.

    ``tree`` holds the count vectors of the words in lexicographic order; node
    j of level l is the j-th run of rows that agree in their first l counts."""
    n, depth = tree.shape
    differs = np.ones((depth + 1, n), bool)
    differs[:, 1:] = False
    for level in range(depth):
        differs[level + 1, 1:] = differs[level, 1:] | (tree[1:, level] != tree[:-1, level])
    starts = [np.flatnonzero(d) for d in differs]
    ends = [np.append(s[1:], n) for s in starts]
    keys = [(np.cumsum(differs[level]) - 1)[starts[level + 1]] * 256 + tree[starts[level + 1], level] for level in range(depth)]
    every = np.arange(len(asks))
    stack = [(0, every[i : i + _CHUNK], np.zeros(len(every[i : i + _CHUNK]), np.int64), spent[0][i : i + _CHUNK], spent[1][i : i + _CHUNK])
             for i in range(0, len(every), _CHUNK)]
    while stack:
        level, ask, node, surplus, deficit = stack.pop()
        size = ends[level][node] - starts[level][node]
        leaf = np.flatnonzero((size <= _LEAF) | (level == depth))
        for i in range(0, len(leaf), _CHUNK):
            own = leaf[i : i + _CHUNK]
            many = size[own]
            row = np.repeat(starts[level][node[own]] - np.cumsum(many) + many, many) + np.arange(many.sum())
            yield np.repeat(ask[own], many), row
        if level == depth:
            continue
        go = np.flatnonzero(size > _LEAF)
        ask, node, surplus, deficit = ask[go], node[go], surplus[go], deficit[go]
        found = []
        for step, may in ((0, None), (1, ~surplus), (-1, surplus & ~deficit)):
            own = np.arange(len(ask)) if may is None else np.flatnonzero(may)
            wanted = asks[ask[own], level].astype(np.int64) + step
            key = node[own] * 256 + wanted
            at = np.minimum(np.searchsorted(keys[level], key), len(keys[level]) - 1)
            hit = (wanted >= 0) & (keys[level][at] == key)
            own = own[hit]
            found.append((ask[own], at[hit], surplus[own] | (step > 0), deficit[own] | (step < 0)))
        columns = [np.concatenate(x) for x in zip(*found, strict=True)]
        for i in range(0, len(columns[0]), _CHUNK):
            stack.append((level + 1, *(c[i : i + _CHUNK] for c in columns)))


def one_edit(flat: np.ndarray, bounds: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """True where word y is word x with one code point replaced, or inserted."""
    length, other = bounds[x + 1] - bounds[x], bounds[y + 1] - bounds[y]
    out = np.zeros(len(x), bool)
    live = np.flatnonzero((other == length) | (other == length + 1))
    same = np.zeros(len(x), np.int64)  # code points that agree from the start, then also from the end
    at, k = live, 0
    while len(at):
        at = at[(k < length[at])]
        at = at[flat[bounds[x[at]] + k] == flat[bounds[y[at]] + k]]
        same[at] += 1
        k += 1
    at, k = live[same[live] < other[live]], 0
    while len(at):
        at = at[same[at] < length[at]]  # not into the common start
        at = at[flat[bounds[x[at] + 1] - 1 - k] == flat[bounds[y[at] + 1] - 1 - k]]
        same[at] += 1
        k += 1
    out[live] = (same[live] == other[live] - 1) & ((other[live] > length[live]) | (same[live] < length[live]))
    return out


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, near_n, near): number of near words, and the commonest of them, of every of the ``words`` (word, n) that has any."""
    size = words.count()
    order = level_order(words)
    depth = min(GROUPS - 1, max(3, math.ceil(math.log(max(size, 1) / BLOCK + 1, 2.5))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = count_vectors(*code_points(batch.column(0).to_pylist()))[:, order[:depth]]
            yield pa.RecordBatch.from_arrays([*batch.columns, _bytes(v)], names=["word", "n", "prefix"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = count_vectors(*code_points(batch.column(0).to_pylist()))[:, order[:depth]]
            at, prefixes = asked_prefixes(v)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in batch.columns), _bytes(prefixes)], names=["word", "n", "prefix"])

    schema = "word string, n bigint, prefix binary"
    held, asked = words.mapInArrow(place, schema), words.mapInArrow(ask, schema)
    number = lambda per, name: F.ceil(F.count(F.lit(1)) / per).cast("int").alias(name)
    blocks = held.groupBy("prefix").agg(number(BLOCK, "parts")).join(asked.groupBy("prefix").agg(number(ASKS, "turns")), "prefix")
    blocks = store(blocks)
    mine = lambda name: F.pmod(F.xxhash64("word"), F.col(name)).cast("int")
    all_of = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    left = asked.join(blocks, "prefix").select("prefix", "word", "n", mine("turns").alias("turn"), "parts").select(
        "prefix", "turn", all_of("parts").alias("part"), "word", "n")
    right = held.join(blocks, "prefix").select("prefix", "word", "n", mine("parts").alias("part"), "turns").select(
        "prefix", all_of("turns").alias("turn"), "part", "word", "n")
    n_tasks = max(partitions(words.sparkSession), -(-size * depth * depth // ASKS))
    task = F.pmod(F.xxhash64("prefix", "turn", "part"), F.lit(n_tasks)).alias("task")

    def compare(one: pa.Table, other: pa.Table) -> pa.Table:
        out = []
        lefts, rights = (_by_place(t) for t in (one, other))
        for key, own in lefts.items():
            if key in rights:
                out += _near_pairs(own, rights[key], np.frombuffer(key[0], np.uint8), order, depth)
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.table({name: pa.array(c, kind) for name, c, kind in zip(("word", "n_near", "near_n", "near"), columns, kinds, strict=True)})

    found = left.select(task, "*").groupBy("task").cogroup(right.select(task, "*").groupBy("task")).applyInArrow(
        compare, "word string, n_near bigint, near_n bigint, near string")
    top = F.min(F.struct((-F.col("near_n")).alias("rank"), "near"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), top.alias("top")).select(
        "word", "n_near", (-F.col("top.rank")).alias("near_n"), F.col("top.near").alias("near"))


def _bytes(vectors: np.ndarray) -> pa.Array:
    width = vectors.shape[1]
    data = np.ascontiguousarray(vectors)
    offsets = np.arange(len(data) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def _by_place(table: pa.Table) -> dict[tuple, tuple[list[str], np.ndarray]]:
    """{(prefix, turn, part): (words, counts)} of a task's rows."""
    out: dict[tuple, tuple[list, list]] = {}
    for *key, word, n in zip(*(table.column(c).to_pylist() for c in ("prefix", "turn", "part", "word", "n")), strict=True):
        own = out.setdefault(tuple(key), ([], []))
        own[0].append(word)
        own[1].append(n)
    return {key: (words, np.array(counts, np.int64)) for key, (words, counts) in out.items()}


def _near_pairs(asking: tuple, held: tuple, prefix: np.ndarray, order: list[int], depth: int) -> list[tuple]:
    """Rows (word, n_near, near_n, near) of the words with near words among a block's asking and held ones."""
    names = asking[0] + held[0]
    counts, first = np.concatenate([asking[1], held[1]]), len(asking[0])
    flat, bounds = code_points(names)
    vectors = count_vectors(flat, bounds)[:, order].astype(np.int16)
    gap = prefix.astype(np.int16) - vectors[:first, :depth]
    rest = vectors[first:, depth:]
    row = np.lexsort(rest.T[::-1])
    pairs = []
    for x, y in search(vectors[:first, depth:], ((gap > 0).any(axis=1), (gap < 0).any(axis=1)), rest[row]):
        y = row[y] + first
        near = one_edit(flat, bounds, x, y)
        x, y = x[near], y[near]
        change = vectors[y] - vectors[x]  # the surplus comes first, or the smaller of two words with equal counts asks
        lead = np.take_along_axis(change, (change != 0).argmax(axis=1)[:, None], axis=1)[:, 0]
        own = np.array([a > 0 or (a == 0 and names[i] < names[j]) for a, i, j in zip(lead.tolist(), x.tolist(), y.tolist(), strict=True)], bool)
        if own.any():
            pairs.append((x[own], y[own]))
    if not pairs:
        return []
    x, y = (np.concatenate(p) for p in zip(*pairs, strict=True))
    word, near = np.concatenate([x, y]), np.concatenate([y, x])
    place = np.empty(len(names), np.int64)
    place[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))  # code-point order
    by = np.lexsort((place[near], -counts[near], word))
    word, near = word[by], near[by]
    new = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    many = np.diff(np.append(new, len(word)))
    return [(names[w], m, int(counts[v]), names[v]) for w, m, v in zip(word[new].tolist(), many.tolist(), near[new].tolist(), strict=True)]


def spelling_groups(docs: DataFrame, least_length: int = 5, least_count: int = 3, ratio: int = 2, thinning: int = 97) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every distinct word of ``docs`` (doc_id, text, any others) with enough code points and occurrences."""
    words = store(word_counts(docs, least_length, thinning).where(F.col("n") >= least_count))
    near = near_words(words)
    formed = F.col("near_n") >= ratio * F.col("n")
    rated = store(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("near")).alias("form"),
        F.when(formed, F.col("near_n")).alias("form_n")))
    links = rated.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = store(links.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        links = step.select("word", "root")
        if step.where("_moved").isEmpty():
            break
    return rated.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
