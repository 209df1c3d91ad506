"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

DataFrame and SQL functions only. A source's target is its share of ``total``
(a multiple of all words) by weight, at most ``epochs`` times its own size;
what a full source leaves is shared again by weight. A target is met with
whole epochs first; the rest is drawn without replacement: every document
gets the exponential key ``-ln(u) / quality`` (u: uniform by a hash of doc_id,
so reruns agree), a source's documents are taken by increasing key until the
words run out. A document is taken if at least half of its words fit, so the
words taken are within half a document of the target.

Prefix sums run in two levels, so that no source is held by one task: keys
fall into ``BUCKETS`` buckets per source, sums within buckets by a window over
(source, bucket), sums before buckets by a window over bucket totals.

Sizes are counts of ``[^\\x20\\x09-\\x0D]+`` (null text: 0). Null is a source of
its own, last in order. Sources of size 0 have target 0. Documents of 0 words
take 0. Rows equal in doc_id and text have equal keys and may be taken in any
order. Columns of the input are kept; added columns replace namesakes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.shared import store

BUCKETS = 4096
WORD = "[^\\x20\\x09-\\x0D]+"


def words(text: Column | str) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(size: Column | str = "size", text: Column | str = "text") -> Column:
    """Weight in [0.05, 1]: share of ASCII letters, other scripts' letters and blanks; short texts count less."""
    text, size = (F.col(c) if isinstance(c, str) else c for c in (text, size))
    odd = F.length(F.regexp_replace(text, "[A-Za-z\\x20\\x09-\\x0D\\u0080-\\uFFFF]+", ""))
    clean = 1 - odd / F.greatest(F.length(text), F.lit(1))
    return F.greatest(F.lit(0.05), F.coalesce(clean * F.least(F.lit(1.0), (size + 10) / F.lit(60.0)), F.lit(0.0)))


def uniform(*salt: Column) -> Column:
    """Uniform in (0, 1) from the first 52 bits of an md5."""
    digest = F.md5(F.concat_ws(":", *salt).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), total: float = 1.5, epochs: int = 2) -> DataFrame:
    """(source, source_size, target) from (source, source_size): proportional shares with ceilings.

    Sources in order of ceiling / weight fill up first; the first one whose
    share of what is left stays under its ceiling fixes the rate for it and
    all after it. One row per source goes through these windows."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*[F.lit(float(w)) for w in weights])
    everything = Window.partitionBy()
    filled = Window.orderBy("_ratio", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.orderBy(F.col("_ratio").desc(), F.col("_rank").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        sizes.withColumn("_rank", F.row_number().over(by_name) - 1)
        .withColumn("_weight", F.element_at(listed, (F.col("_rank") % len(weights) + 1).cast("int")))
        .withColumn("_ceiling", F.col("source_size") * F.lit(float(epochs)))
        .withColumn("_ratio", F.col("_ceiling") / F.col("_weight"))
        .withColumn("_left", F.sum("source_size").over(everything) * F.lit(total) - F.coalesce(F.sum("_ceiling").over(filled), F.lit(0.0)))
        .withColumn("_rate", F.col("_left") / F.sum("_weight").over(ahead))
        .withColumn("_open", F.min(F.when(F.col("_rate") <= F.col("_ratio"), F.struct("_ratio", "_rank", "_rate"))).over(everything))
        .withColumn("target", F.when(
            F.struct("_ratio", "_rank") >= F.struct("_open._ratio", "_open._rank"), F.col("_open._rate") * F.col("_weight"),
        ).otherwise(F.col("_ceiling")))
        .select("source", "source_size", "target")
    )


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), total: float = 1.5, epochs: int = 2,
                quality: Column | None = None, seed: int = 0, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (doc_id, text, source, any others) with size, source_size, target, copies (times taken) and taken (words taken).

    Rows taken no times are kept with copies 0; ``explode_copies`` writes the
    mix out. With ``keep`` only those columns of ``docs`` (and doc_id, source)
    stay; sizes and keys are then computed once and stored with them, instead
    of once for the totals and once for the draw."""
    added = ("size", "source_size", "target", "copies", "taken")
    sized = docs.drop(*added).withColumn("size", words("text"))
    weight = quality if quality is not None else quality_weight()
    salt = (F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.md5(F.col("text").cast("binary")), F.lit("-")))
    sized = sized.withColumn("__tie", F.crc32(F.col("text").cast("binary")))
    sized = sized.withColumn("__key", -F.log(uniform(*salt)) / weight)
    sized = sized.withColumn("__bucket", F.least(F.lit(BUCKETS - 1), F.floor(F.col("__key") / (1 + F.col("__key")) * BUCKETS)).cast("int"))
    if keep is not None:
        narrow = dict.fromkeys([*keep, "doc_id", "source", "size", "__tie", "__key", "__bucket"])
        sized = store(sized.select(*narrow))
    totals = store(sized.groupBy("source", "__bucket").agg(F.sum("size").alias("_words")))
    sources = source_targets(totals.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, total, epochs)
    before = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("__before", F.coalesce(F.sum("_words").over(before), F.lit(0))).drop("_words")
    starts = starts.join(sources.withColumnRenamed("source", "__name"), F.col("source").eqNullSafe(F.col("__name"))).drop("__name")
    starts = starts.withColumnsRenamed({"source": "__name", "__bucket": "__at"})
    within = Window.partitionBy("source", "__bucket").orderBy("__key", "doc_id", "__tie")
    run = sized.withColumn("__run", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    placed = run.join(starts, F.col("source").eqNullSafe(F.col("__name")) & (F.col("__bucket") == F.col("__at")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    part = F.col("target") - whole * F.col("source_size")
    drawn = F.col("__before") + F.col("__run") - F.col("size") / 2.0 <= part
    return (
        placed.withColumn("copies", F.when(F.col("size") > 0, whole + F.when(drawn & (part > 0), 1).otherwise(0)).otherwise(0).cast("int"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop("__key", "__tie", "__bucket", "__run", "__before", "__name", "__at")
    )


def explode_copies(mixed: DataFrame) -> DataFrame:
    """The mix itself: every row as often as it is taken."""
    return mixed.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("__copy")
