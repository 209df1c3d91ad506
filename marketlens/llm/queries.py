"""The operators of this package bound to the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm.shared import held_out, table


def op1_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketlens.llm.multiindex import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_consistent_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketlens.llm.sharding import assign_shards

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    raw = F.col("text").cast("binary")
    sized = docs.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16).withColumn("text_crc32", F.crc32(raw))
    return assign_shards(sized, shards=40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketlens.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op4_secret_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketlens.llm.secrets import find_secrets

    return find_secrets(table(spark, sf_dir, "documents"))


def op5_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketlens.llm.langid import classify, fit

    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op6_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketlens.llm.minhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op7_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketlens.llm.suffixes import repeated_substrings

    return repeated_substrings(table(spark, sf_dir, "documents"))


def op8_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketlens.llm.decontaminate import contained_items

    found = contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_item", "n_shared")


def op9_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketlens.llm.mixing import mix_sources

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs, keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


def op10_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketlens.llm.chunks import repeated_chunks

    return repeated_chunks(table(spark, sf_dir, "documents"))


def op11_simhash_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketlens.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=2)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketlens.llm.spelling import spelling_groups

    return spelling_groups(table(spark, sf_dir, "documents"))


def op13_shared_term_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketlens.llm.ranking import top_documents

    return top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50).select("item_id", "rank", "doc_id", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_inverted_multi_index": op1_inverted_multi_index,
    "op2_consistent_hash_shards": op2_consistent_hash_shards,
    "op3_toxicity": op3_toxicity,
    "op4_secret_automaton": op4_secret_automaton,
    "op5_byte_cnn_language": op5_byte_cnn_language,
    "op6_minmax_near_dedup": op6_minmax_near_dedup,
    "op7_repeated_substrings": op7_repeated_substrings,
    "op8_benchmark_containment": op8_benchmark_containment,
    "op9_weighted_mix": op9_weighted_mix,
    "op10_gear_chunks": op10_gear_chunks,
    "op11_simhash_blocks": op11_simhash_blocks,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_shared_term_ranking": op13_shared_term_ranking,
}

_SHINGLES = r"""
        SELECT {key}, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                  ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s
        FROM (SELECT {key}, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\x20\x09-\x0D]+') AS w FROM {table})
        WHERE len(w) > 0"""

#: Runs of one to four words, for items of so few.
_SHORT_RUNS = r"""
        SELECT doc_id, unnest(flatten([[array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)] FOR k IN range(1, 5)])) AS s
        FROM (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[^\x20\x09-\x0D]+') AS w FROM documents)"""


def _crc32_table() -> list[int]:
    """CRC-32 of every byte: eight steps of the reflected polynomial."""
    out = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        out.append(value)
    return out


_TERMS = r"""
        SELECT row, {key}, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
        FROM (SELECT {key}, text, row_number() OVER () AS row FROM {table})"""

ORACLE: dict[str, str] = {
    "op8_benchmark_containment": f"""
        WITH items AS (SELECT DISTINCT item_id, s FROM ({_SHINGLES.format(key="item_id", table="benchmark")})),
             sizes AS (SELECT item_id, count(*) AS n_item FROM items GROUP BY 1),
             docs AS (SELECT DISTINCT doc_id, s FROM ({_SHINGLES.format(key="doc_id", table="documents")})
                      UNION SELECT doc_id, s FROM ({_SHORT_RUNS}) WHERE s IN (SELECT s FROM items))
        SELECT doc_id, item_id, n_item, count(*) AS n_shared
        FROM docs JOIN items USING (s) JOIN sizes USING (item_id)
        GROUP BY ALL HAVING 100 * count(*) >= 80 * n_item
    """,
    "op9_weighted_mix": r"""
        WITH sized AS (
          SELECT doc_id, source, text,
                 coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
          FROM documents
        ), keyed AS (
          SELECT doc_id, source, size,
                 (CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), md5(text), '-')), 1, 13) AS BIGINT) + 0.5::DOUBLE)
                   / 4503599627370496.0::DOUBLE AS u,
                 greatest(0.05::DOUBLE, coalesce(
                   (1 - length(regexp_replace(text, '[A-Za-z\x20\x09-\x0D\x{0080}-\x{FFFF}]+', '', 'g'))::DOUBLE
                        / greatest(length(text), 1)) * least(1.0::DOUBLE, (size + 10) / 60.0::DOUBLE), 0)) AS quality
          FROM sized
        ), sources AS (
          SELECT source, sum(size) AS source_size,
                 [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
          FROM sized GROUP BY source
        ), rated AS (
          SELECT *, 2.0::DOUBLE * source_size AS top,
                 (sum(source_size) OVER () * 1.5::DOUBLE
                   - coalesce(sum(2.0::DOUBLE * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                 / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate,
                 row_number() OVER o AS nth
          FROM sources WINDOW o AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST)
        ), opened AS (
          SELECT min_by(rate, nth) AS rate, min(nth) AS nth FROM rated WHERE rate <= top / weight
        ), targets AS (
          SELECT source, source_size, CASE WHEN rated.nth >= opened.nth THEN opened.rate * weight ELSE top END AS target
          FROM rated LEFT JOIN opened ON true
        ), runs AS (
          SELECT k.*, sum(size) OVER (PARTITION BY source ORDER BY -ln(u) / quality, doc_id ROWS UNBOUNDED PRECEDING) AS run
          FROM keyed k
        )
        SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
               CAST(size * CASE WHEN size = 0 THEN 0 ELSE floor(target / source_size)
                 + CASE WHEN target - floor(target / source_size) * source_size > 0
                         AND run - size / 2.0::DOUBLE <= target - floor(target / source_size) * source_size THEN 1 ELSE 0 END
               END AS BIGINT) AS taken
        FROM runs r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
    """,
    "op6_minmax_near_dedup": r"""
        WITH RECURSIVE worded AS (
          SELECT row_number() OVER () AS row, doc_id,
                 coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
          FROM documents),
        held AS (SELECT DISTINCT row, unnest(CASE WHEN len(w) = 1 THEN w ELSE [array_to_string(w[i:i + 1], ' ') FOR i IN range(1, len(w))] END) AS s
                 FROM worded WHERE len(w) > 0),
        sizes AS (SELECT row, count(*) AS n FROM held GROUP BY row),
        shared AS (SELECT a.row AS a, b.row AS b, count(*) AS n FROM held a JOIN held b ON a.s = b.s AND a.row < b.row GROUP BY ALL),
        links AS (SELECT a, b FROM shared JOIN sizes x ON x.row = a JOIN sizes y ON y.row = b WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)),
        linked AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reached(row, other) AS (
          SELECT row, row FROM worded
          UNION SELECT r.row, l.b FROM reached r JOIN linked l ON r.other = l.a),
        components AS (SELECT r.row, min(d.doc_id) AS component_id FROM reached r JOIN worded d ON d.row = r.other GROUP BY r.row)
        SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
        FROM worded JOIN components USING (row) LEFT JOIN sizes USING (row)
    """,
    "op12_spelling_variants": rf"""
        WITH RECURSIVE runs AS (
          SELECT doc_id, run, count(*) AS n
          FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                         '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents) GROUP BY ALL),
        coded AS (SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS h FROM runs),
        summed AS (
          SELECT run, n, xor(list_reduce(
            [4294967295::BIGINT] || list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)),
            lambda c, b: xor(c >> 8, list_extract({_crc32_table()}, (xor(c, b) & 255) + 1))), 4294967295::BIGINT) AS crc FROM coded),
        words AS (
          SELECT word, CAST(sum(n) AS BIGINT) AS n
          FROM (SELECT CASE WHEN crc % 97 = 0 THEN left(run, CAST(crc % length(run) AS INT)) || substr(run, CAST(crc % length(run) AS INT) + 2) ELSE run END AS word, n
                FROM summed)
          WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
        holes AS (SELECT word, n, left(word, i) || '*' || substr(word, i + 2) AS hole, left(word, i) || substr(word, i + 2) AS cut
                  FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)),
        near AS (
          SELECT a.word, b.word AS near, b.n FROM holes a JOIN holes b ON a.hole = b.hole WHERE a.word <> b.word
          UNION SELECT h.word, w.word, w.n FROM holes h JOIN words w ON h.cut = w.word
          UNION SELECT w.word, h.word, h.n FROM holes h JOIN words w ON h.cut = w.word),
        ranked AS (SELECT word, near, n, row_number() OVER (PARTITION BY word ORDER BY n DESC, near) AS nth, count(*) OVER (PARTITION BY word) AS n_near FROM near),
        formed AS (
          SELECT w.word, w.n, CAST(coalesce(r.n_near, 0) AS BIGINT) AS n_near, CASE WHEN r.n >= 2 * w.n THEN r.near END AS form, CASE WHEN r.n >= 2 * w.n THEN r.n END AS form_n
          FROM words w LEFT JOIN ranked r ON w.word = r.word AND r.nth = 1),
        chain(word, root) AS (
          SELECT word, word FROM formed
          UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON c.root = f.word WHERE f.form IS NOT NULL),
        roots AS (SELECT c.word, c.root FROM chain c JOIN formed f ON c.root = f.word WHERE f.form IS NULL)
        SELECT f.word, form, root, n, n_near, form_n FROM formed f JOIN roots r ON f.word = r.word
    """,
    "op13_shared_term_ranking": rf"""
        WITH held AS ({_TERMS.format(key="doc_id", table="documents")}),
             sizes AS (SELECT row, doc_id, count(*) AS n FROM held GROUP BY ALL),
             whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM sizes),
             asked AS (SELECT DISTINCT row AS item, item_id, t FROM ({_TERMS.format(key="item_id", table="benchmark")})),
             tfs AS (SELECT row, t, count(*) AS tf FROM held WHERE t IN (SELECT t FROM asked) GROUP BY ALL),
             weights AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tfs, whole GROUP BY t, docs),
             scored AS (
               SELECT item, item_id, doc_id, sizes.row,
                      CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // length))))) AS BIGINT) AS score
               FROM asked JOIN tfs USING (t) JOIN weights USING (t) JOIN sizes ON sizes.row = tfs.row, whole GROUP BY ALL),
             ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST, row) AS rank
                        FROM scored WHERE score > 0)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50
    """,
}
