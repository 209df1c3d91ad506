"""Toxicity scores: gradient-boosted trees over dense text features, calibrated by isotonic regression.

Features of a whole text: densities of a stated lexicon of insults and of a
lexicon learned from labelled texts (words and word beginnings that are far
commoner in toxic ones), their proximity to second-person words, capitals,
punctuation and obfuscation (symbols for letters inside words, as in ``id!0t``).

Fitting takes at most ``SAMPLE`` labelled rows, those with the smallest hash
of doc_id among the rows not held out; 2/5 of them teach the lexicon, 2/5 the
trees, 1/5 the calibration, so no part scores what it has learned. At most
``LEXICON`` units are learned. Everything else is one pass over the texts.

Empty and null texts get the score of a text without any hits. Without
labels of both kinds every score is the share of toxic rows in the sample (0,
if none). Several labels of one doc_id count as toxic if any is. Columns
``score`` and ``predicted`` replace columns of those names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm import kernels as K
from marketlens.llm.boosting import Isotonic, Trees, fit_isotonic, fit_trees
from marketlens.llm.shared import held_out, store

SAMPLE = 24_000
LEXICON = 4_000
SUPPORT = 5
THRESHOLD = 0.7
NEAR = 5
_FILTER = 20

# fixed values: insults and second-person words
INSULTS = """idiot idiots idiotic moron morons moronic stupid stupidity dumb dumbass fool fools loser losers scum scumbag trash garbage
worthless pathetic disgusting clown clowns imbecile jerk creep freak pig swine vermin filth filthy ugly coward liar bastard bitch
asshole shit shitty crap bullshit fuck fucking fucker damn dick prick cunt slut whore retard retarded twat wanker
idiota estupido estúpido imbécil tonto basura asqueroso inútil patético payaso mierda puta cabrón
dumm dummkopf trottel schwachkopf abschaum müll wertlos erbärmlich widerlich scheiße arschloch hure
crétin débile stupide ordure déchet minable dégoûtant bouffon merde salaud connard pute"""
SECOND_PERSON = "you your yours yourself yourselves u ur ya du dich dir dein deine deiner ihr euch tu te toi ton ta tes vous votre tú ti usted vosotros"
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

FEATURES = ("log_words", "insults", "log_insults", "learned", "log_learned", "learned_weight", "top_weight", "near_second_person", "second_person",
            "capitals", "shouted", "exclamations", "questions", "punctuation", "repeated_punctuation", "obfuscated")

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True
_LEET = np.zeros(256, np.uint8)
for _symbol, _letter in LEET.items():
    _LEET[ord(_symbol)] = ord(_letter)
_STAR = np.zeros(256, bool)
_STAR[[ord("*"), ord("#")]] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_BEGINNINGS = (5, 7)


@dataclass
class Text:
    """Words of a slice: hash of each and of its beginnings, document of each, counts by document."""

    words: np.ndarray
    beginnings: list[np.ndarray]
    docs: np.ndarray
    counts: dict[str, np.ndarray]


def read(data: np.ndarray, offsets: np.ndarray) -> Text:
    n = len(offsets) - 1
    low = K.LOWER[data]
    latin = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
    low[latin] += 0x20  # capitals of Latin-1
    letter = _LETTER[low]
    inner = np.zeros(len(low), bool)
    if len(low) > 2:
        inner[1:-1] = letter[:-2] & letter[2:]
    swapped = inner & (_LEET[low] > 0)
    hidden = swapped | (inner & _STAR[low])
    low = np.where(swapped, _LEET[low], low)
    starts, ends, docs = K.runs(letter | swapped, offsets)
    prefix = K.prefix_hash(low)
    words = K.span_hash(prefix, starts, ends)
    length = ends - starts
    beginnings = [np.where(length > b, K.span_hash(prefix, starts, np.minimum(starts + b, ends)), words) for b in _BEGINNINGS]
    per_doc = lambda mask: np.add.reduceat(np.append(mask.astype(np.int64), 0), offsets[:-1]) * (np.diff(offsets) > 0)
    upper = (data >= 65) & (data <= 90)
    ups = np.concatenate([[0], np.cumsum(upper)])
    shouted = (length >= 2) & (ups[ends] - ups[starts] == length)
    punctuation = _PUNCTUATION[data]
    again = np.zeros(len(data), bool)
    again[1:] = punctuation[1:] & (data[1:] == data[:-1])
    counts = {"bytes": np.diff(offsets), "words": np.bincount(docs, minlength=n), "letters": per_doc(letter), "upper": per_doc(upper),
              "shouted": np.bincount(docs, shouted, n), "!": per_doc(data == 33), "?": per_doc(data == 63),
              "punctuation": per_doc(punctuation), "again": per_doc(again), "hidden": per_doc(hidden)}
    return Text(words, beginnings, docs, counts)


def word_hashes(words: str) -> np.ndarray:
    data = np.frombuffer(words.encode(), np.uint8)
    starts, ends, _ = K.word_spans(data, np.array([0, len(data)]))
    return np.unique(K.span_hash(K.prefix_hash(data), starts, ends))


@dataclass
class Lookup:
    """Weights by hash, behind a bitmap that answers most misses."""

    keys: np.ndarray
    weights: np.ndarray
    bitmap: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, weights: np.ndarray) -> Lookup:
        order = np.argsort(keys)
        bitmap = np.zeros(1 << _FILTER, bool)
        bitmap[keys >> np.uint64(64 - _FILTER)] = True
        return cls(keys[order], weights[order], bitmap)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes))
        maybe = np.flatnonzero(self.bitmap[hashes >> np.uint64(64 - _FILTER)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.keys, hashes[maybe]), len(self.keys) - 1)
            out[maybe] = np.where(self.keys[at] == hashes[maybe], self.weights[at], 0)
        return out


@dataclass
class Lexicons:
    insults: Lookup
    second_person: Lookup
    learned: Lookup

    @classmethod
    def of(cls, units: np.ndarray, weights: np.ndarray) -> Lexicons:
        flat = [Lookup.of(h, np.ones(len(h))) for h in (word_hashes(INSULTS), word_hashes(SECOND_PERSON))]
        return cls(*flat, Lookup.of(units, weights))


def features(data: np.ndarray, offsets: np.ndarray, lexicons: Lexicons) -> np.ndarray:
    """Matrix (documents, FEATURES) of a slice."""
    t, n = read(data, offsets), len(offsets) - 1
    c = t.counts
    insult = lexicons.insults(t.words) > 0
    weight = lexicons.learned(t.words)
    for b in t.beginnings:
        np.maximum(weight, lexicons.learned(b), out=weight)
    hit = insult | (weight > 0)
    second = lexicons.second_person(t.words) > 0
    first = np.searchsorted(t.docs, np.arange(n + 1))
    seconds = np.concatenate([[0], np.cumsum(second)])
    at = np.flatnonzero(hit)
    low, high = np.maximum(at - NEAR, first[t.docs[at]]), np.minimum(at + NEAR + 1, first[t.docs[at] + 1])
    near = seconds[high] > seconds[low]
    top = np.zeros(n)
    np.maximum.at(top, t.docs[at], weight[at])
    by_doc = lambda values, docs=t.docs: np.bincount(docs, values, n)
    words, size = np.maximum(c["words"], 1), np.maximum(c["bytes"], 1)
    insults, learned = by_doc(insult), by_doc(weight > 0)
    return np.stack([
        np.log1p(c["words"]), 100 * insults / words, np.log1p(insults), 100 * learned / words, np.log1p(learned), 100 * by_doc(weight) / words, top,
        100 * by_doc(near, t.docs[at]) / words, 100 * by_doc(second) / words, c["upper"] / np.maximum(c["letters"], 1), c["shouted"] / words,
        100 * c["!"] / size, 100 * c["?"] / size, c["punctuation"] / size, c["again"] / size, 100 * c["hidden"] / words], axis=1)


@dataclass
class Model:
    lexicons: Lexicons
    trees: Trees | None
    calibrate: Isotonic | None
    share: float

    def score(self, matrix: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(matrix), self.share)
        return np.clip(self.calibrate(self.trees.margin(matrix)), 0, 1)


def _unit_counts(rows: DataFrame) -> DataFrame:
    """(unit, toxic, clean): documents of each kind that hold the unit, added up per batch before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = np.asarray(batch.column(1))
            data, offsets, _ = K.text_buffers(batch.column(0))
            for at, to, part, local in K.slices(data, offsets):
                t = read(part, local)
                units = np.concatenate([t.words, *t.beginnings])
                docs = np.tile(t.docs, 1 + len(t.beginnings))
                order = np.lexsort((docs, units))
                units, docs = units[order], docs[order]
                new = np.ones(len(units), bool)
                new[1:] = (units[1:] != units[:-1]) | (docs[1:] != docs[:-1])
                units, toxic = units[new], labels[at:to][docs[new]]
                unit, where = np.unique(units, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(unit.view(np.int64)), pa.array(np.bincount(where, toxic, len(unit)).astype(np.int64)),
                     pa.array(np.bincount(where, 1 - toxic, len(unit)).astype(np.int64))], names=["unit", "toxic", "clean"])

    counted = rows.select("text", "toxic").mapInArrow(count, "unit bigint, toxic bigint, clean bigint")
    return counted.groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic 0/1)."""
    chosen = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .withColumn("_draw", F.xxhash64(F.lit("toxicity"), "doc_id")).orderBy("_draw", "doc_id").limit(SAMPLE)
        .withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(5))).drop("_draw")
    )
    rows = store(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))  # at most SAMPLE rows are broadcast
    teach, rest = rows.where("part < 2"), rows.where("part >= 2")
    toxic, clean = (x or 0 for x in teach.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first())
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    units = _unit_counts(teach).where(F.col("toxic") >= SUPPORT).withColumn("weight", odds).where("weight >= 2.5")
    found = units.orderBy((F.col("weight") * F.col("toxic")).desc(), "unit").limit(LEXICON).toArrow()
    lexicons = Lexicons.of(np.asarray(found.column("unit"), dtype=np.int64).view(np.uint64), np.asarray(found.column("weight"), dtype=float))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, _ = K.text_buffers(batch.column(0))
            for at, to, part, local in K.slices(data, offsets):
                matrix = features(part, local, lexicons)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(at, to - at), batch.column(2).slice(at, to - at), batch.column(3).slice(at, to - at),
                     K.ragged(matrix.ravel(), [matrix.shape[1]] * len(matrix), pa.float64())], names=["toxic", "part", "doc_id", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    table = rest.select("text", "toxic", "part", "doc_id").mapInArrow(measure, f"toxic int, part bigint, doc_id {kind}, x array<double>").orderBy("doc_id", "x").toArrow()
    y, part = np.asarray(table.column("toxic"), dtype=float), np.asarray(table.column("part"))
    x = np.asarray(table.column("x").combine_chunks().flatten()).reshape(len(y), len(FEATURES))
    grow, check = part < 4, part == 4
    if not (0 < y[grow].sum() < grow.sum() and check.any()):
        return Model(lexicons, None, None, float(y.mean()) if len(y) else 0.0)
    trees = fit_trees(x[grow], y[grow])
    margin, share = trees.margin(x[check]), float(y.mean())
    # one row of the average share at either end: a handful of labelled rows makes nothing certain
    ends = np.array([margin.min(), margin.max()])
    return Model(lexicons, trees, fit_isotonic(np.append(margin, ends), np.append(y[check], [share, share])), share)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score (double) and predicted (1 if score >= 0.7)."""
    kept = [f for f in docs.schema.fields if f.name not in ("score", "predicted")]
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    column = [f.name for f in kept].index("text")

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, _ = K.text_buffers(batch.column(column))
            for at, to, part, local in K.slices(data, offsets):
                s = model.score(features(part, local, model.lexicons))
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(at, to - at) for c in batch.columns), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=schema.names)

    return docs.select(*[f.name for f in kept]).mapInArrow(rate, schema)
