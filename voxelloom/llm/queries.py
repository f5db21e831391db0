"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, exact_dedup, html, minhash, records, sampling, token_counts, toxicity, urlfilter, warc
from .common import read


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.report(read(spark, sf_dir, "pages"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.report(read(spark, sf_dir, "documents"))


def op4_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.report(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.report(read(spark, sf_dir, "pages"))


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.round_trip(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(read(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.report(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(read(spark, sf_dir, "pages"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontaminate,
        op2_html_text,
        op3_near_dedup,
        op4_piece_sampling,
        op5_toxicity,
        op6_url_filter,
        op7_token_records,
        op8_exact_dedup,
        op9_token_counts,
        op10_warc_derivatives,
    )
}

_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

ORACLES = {
    "op1_decontaminate": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        win AS (
            SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS k
            FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
                  FROM (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0))),
        runs AS (
            SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS k
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
                  FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
        occ AS (SELECT doc_id, item_id, i, n FROM runs JOIN win USING (n, k)),
        hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit
                FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM occ) GROUP BY doc_id),
        found AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
                  FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)""",
    # The article element of each page, cut at block elements; it holds for pages that have one and nothing else in it.
    "op2_html_text": r"""
        WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS art FROM pages),
        b AS (SELECT page_id, url, list_transform(
                  regexp_split_to_array(regexp_replace(art, '<br>', ' ', 'g'), '</?(?:h[1-6]|p|div|ul|ol|li|article|section|blockquote)(?:\s[^>]*)?>'),
                  lambda x: trim(regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'),
                      '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '[\s\p{Z}\x0b\x1c-\x1f\x{85}]+', ' ', 'g'))) AS parts FROM a),
        t AS (SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM b)
        SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t""",
    "op6_url_filter": urlfilter.oracle(),
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
}
