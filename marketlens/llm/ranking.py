"""Ranked lexical search of many queries at once, sharing the work on terms that queries have in common.

The documents' scores for an item are sums over the item's terms of

    w * ((1000000000 * tf) div (1000 * tf + 20 * m)),  w = floor(1000 * ln((2N + 2) / (2 df + 1))),  m = 100 - 50 + ((50 * n * N) div L)

in 64-bit integers, so sums over shared sets of terms can be added up once and
used by every item that has them. Terms are the maximal runs of digits,
letters A-Z (lower-cased) and all characters beyond ASCII.

1. Items are dealt to blocks of about ``ITEM_BLOCK``. A task mines each block:
   the two rows (items or sets found before) with the most terms in common
   give a shared set, which becomes a node; every row that has the whole set
   takes the node in place of those terms. So sets nest, and the block becomes
   a graph without cycles from terms through shared sets to items.
2. One pass over the documents writes each one's number of terms and its
   frequencies of the items' terms; df, N and L are counted from all of them.
3. One pass over those evaluates, for slices of documents, every node once
   from its terms and its nodes, and keeps the best ``k`` of every item. Each
   task returns at most k rows an item; they are merged in two steps, by item
   and a part of the tasks, then by item.

Items come in groups of about ``GROUP_BYTES`` of text; only one group's terms
and graphs are sent to tasks at a time, so the benchmark may be of any size.

Null and empty texts have no terms and are never found; items without terms
find nothing. Items equal in item_id and text are one; items that share an
item_id only are ranked each on their own. Documents with equal doc_id and
score are ordered among themselves by nothing else, those without doc_id come
after the others of their score. Texts are read in pieces of 1 MB. An empty
table gives an empty result; other columns of any name are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.kernels import ragged
from marketlens.llm.pieces import pieces
from marketlens.llm.shared import store

ITEM_BLOCK = 256
GROUP_BYTES = 16 << 20
SLICE = 4_096
PARTS = 64
_TERM, _GAP = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")


def terms(raw: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, a list for each of its pieces."""
    for part in pieces((raw or b"").lower(), _GAP):
        yield _TERM.findall(part)


def shared_sets(held: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
    """(terms left to each row, nodes used by each row) after mining the rows x terms table ``held``.

    The first rows are the given ones, the others shared sets of two or more terms."""
    n, uses = len(held), [[] for _ in held]
    room = 2 * n + 16
    rows, common = np.zeros((room, held.shape[1]), np.float32), np.zeros((room, room), np.float32)
    rows[:n] = held
    common[:n, :n] = rows[:n] @ rows[:n].T
    np.fill_diagonal(common, 0)
    while True:
        i, j = divmod(int(common.argmax()), room)
        if common[i, j] < 2:
            return rows[:n] > 0, uses
        found = rows[i] * rows[j]
        having = np.flatnonzero(rows[:n] @ found == found.sum())
        rows[having] -= found
        for row in having.tolist():
            uses[row].append(n)
        uses.append([])
        rows[n] = found
        changed, n = [*having.tolist(), n], n + 1
        part = rows[changed] @ rows.T
        common[changed], common[:, changed] = part, part.T
        common[changed, changed] = 0
        if n == room:
            rows, common, room = np.pad(rows, ((0, room), (0, 0))), np.pad(common, (0, room)), 2 * room


def evaluation_order(uses: list[list[int]]) -> list[int]:
    """Nodes after all that they use."""
    done, out = set(), []
    for root in range(len(uses)):
        stack = [(root, iter(uses[root]))] if root not in done else []
        done.add(root)
        while stack:
            node, rest = stack[-1]
            below = next((x for x in rest if x not in done), None)
            if below is None:
                out.append(node)
                stack.pop()
            else:
                done.add(below)
                stack.append((below, iter(uses[below])))
    return out


def graphs(items: DataFrame, n_blocks: int) -> DataFrame:
    """(block, node, item_id, text_md5, uses, terms) of every node; ``items``: item_id, text_md5, text, distinct."""
    kind = items.schema["item_id"].dataType.simpleString()
    schema = f"block int, node int, item_id {kind}, text_md5 string, uses array<int>, terms array<binary>"

    def mine(table: pa.Table) -> pa.Table:
        own = [sorted({t for part in terms(x.as_py()) for t in part}) for x in table.column("raw")]
        held = Counter(t for x in own for t in x)
        several = sorted(t for t, n in held.items() if n > 1)  # others can't be shared
        at = {t: i for i, t in enumerate(several)}
        matrix = np.zeros((len(own), len(several)), bool)
        for row, x in enumerate(own):
            matrix[row, [at[t] for t in x if t in at]] = True
        left, uses = shared_sets(matrix)
        rest = [[several[i] for i in np.flatnonzero(row).tolist()] for row in left]
        for row, x in enumerate(own):
            rest[row] += [t for t in x if held[t] == 1]
        order = evaluation_order(uses)
        name = {node: i for i, node in enumerate(order)}
        item = [node if node < len(own) else None for node in order]
        pick = pa.array(item, pa.int64())
        return pa.table({
            "block": pa.array([table.column("block")[0].as_py()] * len(order), pa.int32()), "node": pa.array(range(len(order)), pa.int32()),
            "item_id": table.column("item_id").combine_chunks().take(pick), "text_md5": table.column("text_md5").combine_chunks().take(pick),
            "uses": pa.array([[name[x] for x in uses[node]] for node in order], pa.list_(pa.int32())),
            "terms": pa.array([rest[node] for node in order], pa.list_(pa.binary()))})

    dealt = items.select(F.pmod(F.xxhash64("item_id", "text_md5"), F.lit(n_blocks)).cast("int").alias("block"), "item_id", "text_md5",
                         F.col("text").cast("binary").alias("raw"))
    return dealt.groupBy("block").applyInArrow(mine, schema)


def postings(docs: DataFrame, vocabulary) -> DataFrame:
    """(doc_id, n, ids, tfs): number of terms with repeats, and the frequencies of the broadcast {term: id}."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = vocabulary.value
        for batch in batches:
            sizes, held, flat, times = [], [], [], []
            for x in batch.column(1):
                n, tf = 0, Counter()
                for part in terms(x.as_py()):
                    n += len(part)
                    tf.update(filter(ids.__contains__, part))
                sizes.append(n)
                held.append(len(tf))
                flat.extend([ids[t] for t in tf])
                times.extend(tf.values())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), ragged(np.array(flat, np.int32), held, pa.int32()), ragged(np.array(times, np.int64), held, pa.int64())],
                names=["doc_id", "n", "ids", "tfs"])

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(count, f"doc_id {kind}, n bigint, ids array<int>, tfs array<bigint>")


def item_scores(plan: list[tuple], rows: np.ndarray, values: np.ndarray, bounds: np.ndarray, n_docs: int) -> Iterator[tuple[int, np.ndarray]]:
    """(item, scores of all documents of a slice) through a block's graph.

    ``plan``: (item or -1, uses, term ids) of each node, used ones first; postings of term t are rows/values[bounds[t]:bounds[t + 1]]."""
    made: list[np.ndarray | None] = []
    for item, uses, own in plan:
        total = np.zeros(n_docs, np.int64)
        for node in uses:
            total += made[node]
        for t in own:
            a, b = bounds[t], bounds[t + 1]
            total[rows[a:b]] += values[a:b]
        made.append(total if item < 0 else None)  # no row uses an item
        if item >= 0:
            yield item, total


def best(found: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k of (scores, no id, ids) by score, largest first, then by id, missing ones last."""
    scores, missing, ids = found
    order = np.lexsort((ids, missing, -scores))[:k]
    return scores[order], missing[order], ids[order]


def top_documents(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, text_md5, rank, doc_id, score): the best ``k`` rows of ``docs`` (doc_id, text) for each of ``items`` (item_id, text)."""
    items = store(items.select("item_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "text").dropDuplicates(["item_id", "text_md5"]))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_groups = max(1, -(-size // GROUP_BYTES))
    group = F.pmod(F.xxhash64(F.lit("group"), "item_id", "text_md5"), F.lit(n_groups))
    found = None
    for i in range(n_groups):
        part = group_results(docs, items.where(group == i), k)
        found = part if found is None else found.unionByName(part)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    for keys in (["item_id", "text_md5", "part"], ["item_id", "text_md5"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return found.select("item_id", "text_md5", "rank", "doc_id", "score")


def group_results(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(item_id, text_md5, part, doc_id, score) with at least the best ``k`` documents of each of the items."""
    spark = docs.sparkSession
    plan = store(graphs(items, max(1, -(-items.count() // ITEM_BLOCK)))).orderBy("block", "node").collect()  # about GROUP_BYTES
    vocabulary = {t: i for i, t in enumerate(sorted({bytes(t) for row in plan for t in row["terms"]}))}
    held = store(postings(docs, spark.sparkContext.broadcast(vocabulary)))
    n, length = held.agg(F.sum((F.col("n") > 0).cast("long")), F.sum("n")).first()
    df = np.zeros(len(vocabulary), np.int64)
    for t, having in held.select(F.explode("ids").alias("t")).groupBy("t").count().collect():  # at most the group's terms
        df[t] = having
    n, length = n or 0, length or 0
    weight = np.array([math.floor(1000 * math.log((2.0 * n + 2) / (2.0 * x + 1))) for x in df.tolist()], np.int64)
    names = [(row["item_id"], row["text_md5"]) for row in plan if row["text_md5"] is not None or row["item_id"] is not None]
    blocks: list[list[tuple]] = []
    item = 0
    for row in plan:
        if row["node"] == 0:
            blocks.append([])
        is_item = row["text_md5"] is not None or row["item_id"] is not None
        blocks[-1].append((item if is_item else -1, list(row["uses"]), [vocabulary[bytes(t)] for t in row["terms"]]))
        item += is_item
    shared = spark.sparkContext.broadcast((weight, blocks))
    n_terms = len(vocabulary)
    kind = docs.schema["doc_id"].dataType.simpleString()
    item_kind = items.schema["item_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, blocks = shared.value
        top: dict[int, tuple] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                missing = np.asarray(batch.column(0).is_null())
                doc_ids = np.asarray(batch.column(0).fill_null(0))
                m = 100 - 50 + (50 * np.asarray(batch.column(1)) * n) // max(length, 1)
                counts = np.asarray(batch.column(2).value_lengths())
                ids, tf = np.asarray(batch.column(2).flatten()), np.asarray(batch.column(3).flatten())
                of = np.repeat(np.arange(batch.num_rows), counts)
                values = weight[ids] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[of]))
                order = np.argsort(ids, kind="stable")
                bounds = np.searchsorted(ids[order], np.arange(n_terms + 1))
                for plan in blocks:
                    for item, total in item_scores(plan, of[order], values[order], bounds, batch.num_rows):
                        have = top.get(item)
                        least = int(have[0][-1]) if have is not None and len(have[0]) == k else 1
                        good = np.flatnonzero(total >= least)
                        if len(good) > k:
                            good = good[total[good] >= np.partition(total[good], len(good) - k)[len(good) - k]]
                        if len(good):
                            new = total[good], missing[good], doc_ids[good]
                            top[item] = best(new if have is None else tuple(np.concatenate(x) for x in zip(have, new, strict=True)), k)
        if top:
            items = np.repeat(list(top), [len(x[0]) for x in top.values()])
            scores, missing, ids = (np.concatenate(x) for x in zip(*top.values(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(items, pa.int32()), pa.array(ids, mask=missing), pa.array(scores, pa.int64())], names=["item", "doc_id", "score"])

    rows = held.select("doc_id", "n", "ids", "tfs").mapInArrow(score, f"item int, doc_id {kind}, score bigint")
    named = spark.createDataFrame([(i, *name) for i, name in enumerate(names)], f"item int, item_id {item_kind}, text_md5 string")
    part = F.pmod(F.spark_partition_id(), F.lit(PARTS))
    return store(rows.withColumn("part", part).join(named, "item").select("item_id", "text_md5", "part", "doc_id", "score"))
