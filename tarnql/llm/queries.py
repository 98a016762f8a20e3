"""The contract's queries: thin callables (spark, sf_dir) over the operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import exact_dedup
from .html_extract import extract, trained
from .line_dedup import line_dedup
from .mixing import mix
from .ngram_join import ngram_join
from .packing import pack
from .quality import quality
from .substring_dedup import substring_dedup
from .toxicity import toxicity, trained_on
from .url_filter import url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).withColumn("distance", F.round("distance", 6))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), trained(spark))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, trained_on(spark, sf_dir, docs))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_html_extract": op2_html_extract,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_url_filter": op6_url_filter,
    "op7_ngram_join": op7_ngram_join,
    "op8_line_dedup": op8_line_dedup,
    "op9_packing": op9_packing,
    "op10_mixing": op10_mixing,
}

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

ORACLES: dict[str, str] = {
    "op3_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op4_substring_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
spots AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
windows AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS words FROM spots),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY words) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT r, i + k AS p FROM twice, range(35) AS t(k)),
each AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM each ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)""",
    "op7_ngram_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
spots AS (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) AS i FROM d WHERE len(w) > 0),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM spots),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS same FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * same >= 90 * (a.n + b.n - same)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM d LEFT JOIN sizes USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) USING (doc_id)""",
    "op10_mixing": f"""
WITH sized AS (SELECT doc_id, source, {_WORDS} AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS shuffle FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn FROM sources),
weighed AS (SELECT *, CASE turn WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM ranked),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER earlier, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0)) AS level
  FROM weighed
  WINDOW earlier AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
found AS (SELECT coalesce((SELECT level FROM levels WHERE 2.0::DOUBLE * source_size >= level * weight
                           ORDER BY source_size / weight, source NULLS LAST LIMIT 1), 0) AS level),
goals AS (SELECT source, source_size, turn, weight, CASE WHEN 2.0::DOUBLE * source_size < found.level * weight THEN 2.0::DOUBLE * source_size
                 ELSE found.level * weight END AS target FROM weighed, found),
placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY shuffle, doc_id, size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sized),
takes AS (SELECT doc_id, size, source_size, target, turn, before,
    greatest(0, least(size, floor(target + 0.5) - before)) AS one,
    greatest(0, least(size, floor(target + 0.5) - source_size - before)) AS two
  FROM placed JOIN goals ON placed.source IS NOT DISTINCT FROM goals.source),
shares AS (SELECT *, (before + one / 2.0::DOUBLE) / target AS p, (source_size + before + two / 2.0::DOUBLE) / target AS q FROM takes)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(one + two AS BIGINT) AS taken,
  CASE WHEN one > 0 THEN round(CASE turn
    WHEN 0 THEN least(p * 5.0::DOUBLE * 2.0::DOUBLE / (7.0::DOUBLE + sqrt(greatest(49.0::DOUBLE + p * 5.0::DOUBLE * -8.0::DOUBLE, 0))), 1)
    WHEN 1 THEN least(p * 2.0::DOUBLE * 2.0::DOUBLE / (2.0::DOUBLE + sqrt(4.0::DOUBLE)), 1)
    ELSE least(p * 1.0::DOUBLE * 2.0::DOUBLE / sqrt(p * 1.0::DOUBLE * 4.0::DOUBLE), 1) END, 9) END AS position,
  CASE WHEN two > 0 THEN round(CASE turn
    WHEN 0 THEN least(q * 5.0::DOUBLE * 2.0::DOUBLE / (7.0::DOUBLE + sqrt(greatest(49.0::DOUBLE + q * 5.0::DOUBLE * -8.0::DOUBLE, 0))), 1)
    WHEN 1 THEN least(q * 2.0::DOUBLE * 2.0::DOUBLE / (2.0::DOUBLE + sqrt(4.0::DOUBLE)), 1)
    ELSE least(q * 1.0::DOUBLE * 2.0::DOUBLE / sqrt(q * 1.0::DOUBLE * 4.0::DOUBLE), 1) END, 9) END AS again
FROM shares""",
}
