"""The corpus operators as registered queries, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabularium.llm import bpe, jpeg_media, licenses, mixing, quality, simhash, token_counts, toxicity, url_filter, warc
from tabularium.llm.common import table


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file; the files are never part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(table(spark, sf_dir, "documents"))


def op6_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = jpeg_media.store_media(table(spark, sf_dir, "documents"))
    out = jpeg_media.read_media(stored)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_and_decode(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_labels(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_url_filters": op2_url_filters,
    "op3_simhash": op3_simhash,
    "op4_warc": op4_warc,
    "op5_quality_rules": op5_quality_rules,
    "op6_jpeg_media": op6_jpeg_media,
    "op7_toxicity": op7_toxicity,
    "op8_bpe": op8_bpe,
    "op9_mixing": op9_mixing,
    "op10_license_scans": op10_license_scans,
}

_SPACE = r"[\x20\x09-\x0D]"

_QUALITY_SQL = rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '{_SPACE}+'), lambda x: x <> '') AS words,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
    p AS (SELECT doc_id, words, unnest(generate_series(1, len(words) - 4)) AS i FROM w WHERE len(words) > 5),
    g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(list_slice(words, i, i + 4), chr(1))) AS k FROM p),
    c AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM g, range(5) AS r(j) WHERE k > 1 GROUP BY doc_id),
    m AS (SELECT doc_id, t, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
                 length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
                 coalesce(n_repeat_words, 0) AS n_repeat_words, len(string_split(t, chr(10))) AS n_lines,
                 len(list_filter(words, lambda x, i: i > 1 AND x = words[i - 1])) AS n_stutter FROM w LEFT JOIN c USING (doc_id)),
    v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
    SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
           NOT base_failed AND NOT (10 * n_symbols > n_words OR 10 * (strlen(t) - strlen(replace(t, '!!', '!'))) > n_words OR word_chars > 20 * n_words OR word_chars < 2 * n_words
                                    OR 10 * n_stutter > 3 * n_words OR 2 * n_dup_lines > n_lines) AS kept FROM v
"""


def _license_sql() -> str:
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    phrases = ", ".join(f"({quoted(p.split())}, '{label}')" for p, label in licenses.PHRASES.items())
    pairs = lambda text: quoted(sorted({" ".join(x) for x in zip(text.split(), text.split()[1:], strict=False)}))
    templates = ", ".join(f"({pairs(t)}, '{label}', {pairs(n)}::VARCHAR[])" for label, t, n in licenses.TEMPLATES)
    size, half = licenses.WINDOW, licenses.WINDOW // 2
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return rf"""
    WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    w AS (SELECT doc_id, regexp_extract_all(t, '{word}') AS words FROM d),
    ph AS (SELECT * FROM (VALUES {phrases}) AS x(p, label)),
    i AS (SELECT doc_id, words, unnest(range(0, len(words))) AS i FROM w),
    b AS (SELECT doc_id, i, label FROM i, ph WHERE words[i + 1] = p[1] AND list_slice(words, i + 1, i + len(p)) = p),
    base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM b GROUP BY doc_id),
    l0 AS (SELECT doc_id, string_split(t, chr(10)) AS ls FROM d),
    l1 AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS k, ls FROM l0),
    l2 AS (SELECT doc_id, k, regexp_extract_all(ls[k], '{word}') AS lw FROM l1),
    l3 AS (SELECT *, sum(CASE WHEN len(lw) = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM l2),
    bl AS (SELECT doc_id, lw AS words FROM l3 WHERE len(lw) > 0 UNION ALL SELECT doc_id, flatten(list(lw)) FROM l3 WHERE len(lw) > 0 GROUP BY doc_id, run HAVING count(*) > 1),
    wi AS (SELECT doc_id, words FROM bl WHERE len(words) <= {size} UNION ALL
           SELECT doc_id, list_slice(words, s + 1, s + {size}) FROM (SELECT doc_id, words, unnest(range(0, len(words) - {half}, {half})) AS s FROM bl WHERE len(words) > {size})),
    tk AS (SELECT doc_id, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS words FROM wi),
    tp AS (SELECT * FROM (VALUES {templates}) AS x(tw, label, naming)),
    m AS (SELECT doc_id, label, len(list_intersect(tw, words))::DOUBLE / len(tw) AS c FROM tk, tp
          WHERE len(list_intersect(naming, words)) = len(naming) AND len(list_intersect(tw, words)) >= ceil({licenses.THRESHOLD}::DOUBLE * len(tw) - 1e-9::DOUBLE)),
    mm AS (SELECT doc_id, max(c) AS c, list(DISTINCT label) AS labels FROM m GROUP BY doc_id)
    SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
           coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(mm.labels, [])))), ','), '') AS labels,
           CASE WHEN n_base IS NOT NULL THEN 1.0::DOUBLE ELSE coalesce(c, 0.0::DOUBLE) END AS score
    FROM w LEFT JOIN base USING (doc_id) LEFT JOIN mm USING (doc_id)
    """


ORACLE_SQL: dict[str, str] = {
    "op5_quality_rules": _QUALITY_SQL,
    "op10_license_scans": _license_sql(),
    "op4_warc": """
        WITH p AS (
            SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages
        ), f AS (
            SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first_id <> page_id THEN first_id END AS refers_to
        FROM p LEFT JOIN f USING (payload_digest)
    """,
}
