"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths slide over them, each filter's
largest answer in a window is kept, and a softmax layer decides. Windows have
``WINDOW`` positions (plus the bytes that the widest filter looks ahead); a
document is covered by as many windows as it needs, to its last byte, and gets
the mean of their probabilities, weighted by their bytes.

Training (numpy, on the driver) takes at most ``PER_LANGUAGE`` documents of
each language, those with the smallest hash of doc_id among the rows not held
out, and ``PIECES`` evenly spaced windows of each. For scoring, the layers
before the pooling are folded into tables over byte pairs, so a position
costs three look-ups.

``lang_pred`` is a learned language, or ``und`` with score 0 if the text is
null or has no letter. With a single learned language that one is predicted
with score 1; without any, all rows are ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm import kernels as K
from marketlens.llm.shared import held_out

WINDOW = 128
WIDTHS = (2, 3, 4, 5)
FILTERS = 6
EMBED = 8
PER_LANGUAGE = 800
PIECES = 6
_AHEAD = max(WIDTHS) - 1
_CHUNK = 1 << 10


@dataclass
class Network:
    """Parameters; ``conv[w]`` has shape (w * EMBED, FILTERS)."""

    languages: list[str]
    embed: np.ndarray
    conv: list[np.ndarray]
    conv_bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Summed filter answers to bytes 0 and 1, to bytes 2 and 3 (by pair), and to byte 4."""
        width = len(WIDTHS) * FILTERS
        single = np.zeros((max(WIDTHS), 256, width), np.float32)
        for i, (w, weights) in enumerate(zip(WIDTHS, self.conv, strict=True)):
            for k in range(w):
                single[k, :, i * FILTERS : (i + 1) * FILTERS] = self.embed @ weights[k * EMBED : (k + 1) * EMBED]
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, width)
        return pair(single[0] + self.conv_bias, single[1]), pair(single[2], single[3]), single[4]


def fit_network(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 8, rate: float = 0.01, batch: int = 64,
                seed: int = 0) -> Network:
    """Adam on the cross entropy. ``windows``: (n, WINDOW + ahead) bytes; ``labels``: indexes of languages."""
    draw = np.random.default_rng(seed)
    n, width = len(labels), len(WIDTHS) * FILTERS
    p = [draw.normal(0, 0.5, (256, EMBED)), *(draw.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS)) for w in WIDTHS),
         np.zeros(width), draw.normal(0, width**-0.5, (width, len(languages))), np.zeros(len(languages))]
    p = [x.astype(np.float32) for x in p]
    first, second = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    step = 0
    for _ in range(epochs):
        order = draw.permutation(n)
        for at in range(0, n, batch):
            own = order[at : at + batch]
            x, y, m = windows[own], labels[own], len(own)
            e = p[0][x]
            pooled, place, patches = np.empty((m, width), np.float32), np.empty((m, width), np.int64), []
            for i, w in enumerate(WIDTHS):
                patch = np.lib.stride_tricks.sliding_window_view(e, w, axis=1)[:, :WINDOW].transpose(0, 1, 3, 2).reshape(m, WINDOW, w * EMBED)
                answer = patch @ p[1 + i]
                cols = slice(i * FILTERS, (i + 1) * FILTERS)
                place[:, cols] = answer.argmax(axis=1)
                pooled[:, cols] = answer.max(axis=1)
                patches.append(patch)
            hidden = np.maximum(pooled + p[-3], 0)
            logits = hidden @ p[-2] + p[-1]
            prob = np.exp(logits - logits.max(axis=1, keepdims=True))
            prob /= prob.sum(axis=1, keepdims=True)
            prob[np.arange(m), y] -= 1
            prob /= m
            back = (prob @ p[-2].T) * (hidden > 0)
            grads = [np.zeros_like(p[0]), *(np.zeros_like(p[1 + i]) for i in range(len(WIDTHS))), back.sum(axis=0), hidden.T @ prob, prob.sum(axis=0)]
            rows = np.arange(m)[:, None]
            for i, w in enumerate(WIDTHS):
                cols = slice(i * FILTERS, (i + 1) * FILTERS)
                chosen = patches[i][rows, place[:, cols]]  # only the place of the maximum learns
                grads[1 + i] = np.einsum("mfe,mf->ef", chosen, back[:, cols])
                to_bytes = np.einsum("ef,mf->mfe", p[1 + i], back[:, cols]).reshape(m, FILTERS, w, EMBED)
                np.add.at(grads[0], x[rows[:, :, None], place[:, cols][:, :, None] + np.arange(w)], to_bytes)
            step += 1
            for q, g, a, b in zip(p, grads, first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                q -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return Network(languages, p[0], p[1:-3], p[-3], p[-2], p[-1])


def window_rows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Windows (n, WINDOW + ahead) from byte positions; bytes past ``ends`` are 0."""
    at = starts[:, None] + np.arange(WINDOW + _AHEAD)
    return np.where(at < ends[:, None], data[np.minimum(at, max(len(data) - 1, 0))], 0) if len(data) else np.zeros(at.shape, np.uint8)


#: Parts that a language's rows are dealt to when the smallest draws are found.
DRAW_PARTS = 64


def fit(docs: DataFrame) -> Network | None:
    """Network from ``docs`` (doc_id, text, lang); None without any usable row."""
    rows = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0) & ~held_out())
    rows = rows.select("lang", F.xxhash64(F.lit("langid"), "doc_id").alias("_draw"), "doc_id", "text")
    long = F.length("text")
    pieces = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda i: F.substr(
        F.col("text"), (F.floor(i * F.greatest(long - WINDOW, F.lit(0)) / (PIECES - 1)) + 1).cast("int"), F.lit(WINDOW)))
    rows = rows.withColumn("pieces", F.array_distinct(pieces)).drop("text")
    # the smallest draws of a language, first among DRAW_PARTS parts of it, so that four languages are not four tasks
    rows = rows.withColumn("_part", F.pmod("_draw", F.lit(DRAW_PARTS)))
    for keys in (["lang", "_part"], ["lang"]):
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy("_draw", "doc_id", "pieces"))
        rows = rows.withColumn("_nth", nth).where(F.col("_nth") <= PER_LANGUAGE)
    sample = rows.orderBy("lang", "_nth").select("lang", "pieces").toArrow().to_pylist()
    if not sample:
        return None
    languages = sorted({r["lang"] for r in sample})
    texts = [(t.encode(), languages.index(r["lang"])) for r in sample for t in r["pieces"]]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t, _ in texts])])
    data = np.frombuffer(b"".join(t for t, _ in texts), np.uint8)
    shorter = np.random.default_rng(1).integers(16, 2 * WINDOW, len(texts))  # about half of the windows teach short texts
    return fit_network(window_rows(data, offsets[:-1], np.minimum(offsets[1:], offsets[:-1] + shorter)), np.array([y for _, y in texts]), languages)


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each document has a letter of any script."""
    ascii_letter = np.concatenate([[0], np.cumsum((K.LOWER[data] >= 97) & (K.LOWER[data] <= 122))])
    out = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
    for i in np.flatnonzero(~out & (offsets[1:] > offsets[:-1])).tolist():
        out[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))
    return out


def classify(docs: DataFrame, network: Network | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs`` (doc_id, text, any others)."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])
    names = np.array([*(network.languages if network else []), "und"], dtype=object)

    def probabilities(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, tables: tuple) -> np.ndarray:
        pairs, later, last = tables
        out = []
        for at in range(0, len(starts), _CHUNK):
            x = window_rows(data, starts[at : at + _CHUNK], ends[at : at + _CHUNK]).astype(np.int32)
            two = x[:, :-1] * 256 + x[:, 1:]
            best = np.empty((len(x), pairs.shape[1]), np.float32)
            for i in range(0, len(x), 64):  # keeps the answers in the processor's cache
                answer = pairs[two[i : i + 64, :WINDOW]]
                answer += later[two[i : i + 64, 2 : WINDOW + 2]]
                answer += last[x[i : i + 64, 4 : WINDOW + 4]]
                best[i : i + 64] = answer.max(axis=1)
            logits = np.maximum(best, 0) @ network.dense + network.dense_bias
            logits -= logits.max(axis=1, keepdims=True)
            prob = np.exp(logits)
            out.append(prob / prob.sum(axis=1, keepdims=True))
        return np.concatenate(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = network.tables() if network else None
        for batch in batches:
            data, offsets, _ = K.text_buffers(batch.column(1))
            for at, to, part, local in K.slices(data, offsets):
                n = to - at
                known = has_letter(part, local) if network else np.zeros(n, bool)
                pick, score = np.full(n, len(names) - 1), np.zeros(n)
                if known.any():
                    long = np.where(known, np.diff(local), 0)
                    count = -(-long // WINDOW)
                    of = np.repeat(np.arange(n), count)
                    nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                    starts, ends = local[of] + nth * WINDOW, local[of + 1]
                    weight = np.minimum(ends - starts, WINDOW)
                    probs = probabilities(part, starts, ends, tables)
                    prob = np.stack([np.bincount(of, weight * column, n) for column in probs.T], axis=1) / np.maximum(long, 1)[:, None]
                    pick = np.where(known, prob.argmax(axis=1), pick)
                    score = np.where(known, np.minimum(prob.max(axis=1), 1.0), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), pa.array(names[pick], pa.string()), pa.array(score.astype(float))], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
