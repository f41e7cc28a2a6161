"""The queries of this subpackage over the whole tables, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, fingerprints, license_scan, mixing, ngram_lm, simhash, suffix_dedup, token_counts, toxicity, url_filter
from .common import documents, read_table

TOKENIZER = "byte_bpe_50k.json"


def op1_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path(tokenizer))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir)).drop("kept")


def op4_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_digest(documents(spark, sf_dir)).drop("spans")


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_documents(documents(spark, sf_dir))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(documents(spark, sf_dir), read_table(spark, sf_dir, "labels")).drop("spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_counts, op2_simhash, op3_licenses, op4_contamination, op5_url_filter, op6_mixing, op7_suffix_dedup, op8_lm_scores, op9_fingerprints, op10_toxicity)
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op4_contamination": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 8) AS n, array_to_string(w[i:i + 7], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
m AS (SELECT r, i, n, item_id FROM (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
        FROM p, (SELECT DISTINCT n FROM bw) WHERE i + n - 1 <= len(w)) JOIN bw USING (n, win)),
h AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM m) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN it USING (r)
""",
    "op6_mixing": rf"""
WITH b AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT) AS salt FROM documents),
t AS (SELECT source, sum(size) AS source_size, greatest(1, CAST(ceil(count(*) / {mixing.BLOCK_ROWS}.0) AS BIGINT)) AS parts FROM b GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS DOUBLE) AS w, CAST(source_size AS DOUBLE) * 3 AS cap FROM t),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level FROM w
      WINDOW before AS (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT level AS final FROM l WHERE level * w <= cap ORDER BY cap / w, source IS NULL, source LIMIT 1),
g AS (SELECT source, source_size, parts, CASE WHEN level * w > cap THEN cap ELSE w * (SELECT final FROM f) END AS target,
        CAST('0x' || substr(md5(coalesce(source, '') || CASE WHEN source IS NULL THEN '1' ELSE '0' END || '7'), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM l),
p AS (SELECT b.*, g.source_size, g.target, g.u, g.parts, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || salt || '|7'), 1, 15) AS BIGINT) AS h, bin(size + 1) AS bits FROM b JOIN g ON b.source IS NOT DISTINCT FROM g.source),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS step, row_number() OVER (PARTITION BY source ORDER BY
        length(bits) * 4 + CASE substr(bits || '00', 2, 2) WHEN '00' THEN 0 WHEN '01' THEN 1 WHEN '10' THEN 2 ELSE 3 END DESC, (h >> 8) % parts, size DESC, h, doc_id) AS k FROM p)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(floor(u + k * step) - floor(u + (k - 1) * step) AS BIGINT) * size AS taken, source, CAST(floor(u + k * step) - floor(u + (k - 1) * step) AS BIGINT) AS copies FROM r
""",
}
