"""The registered queries of this package, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, collocations, embedding_dedup, language_id, license_scan, lm_score, media, mixing, near_dedup, packing, prefix_trie, secret_scan, url_filter

QUERIES = {
    "op1_media_webp": media.query,
    "op2_url_filter": url_filter.query,
    "op3_secret_scan": secret_scan.query,
    "op4_language_id": language_id.query,
    "op5_bpe_codec": bpe.query,
    "op6_best_two_fit": packing.query,
    "op7_embedding_dedup": embedding_dedup.query,
    "op8_near_dedup": near_dedup.query,
    "op9_license_scan": license_scan.query,
    "op10_lm_score": lm_score.query,
    "op11_collocations": collocations.query,
    "op12_prefix_trie": prefix_trie.query,
    "op13_source_mix": mixing.query,
}
ORACLE_SQL = {"op2_url_filter": url_filter.ORACLE_SQL, "op11_collocations": collocations.ORACLE_SQL, "op12_prefix_trie": prefix_trie.ORACLE_SQL, "op13_source_mix": mixing.ORACLE_SQL}


def secret_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op3_secret_scan that SQL can express."""
    return secret_scan.query(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def license_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op9_license_scan that SQL can express."""
    return license_scan.query(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def _found(kind: str, pattern: str, least: int, group: int = 0) -> str:
    """start, finish (code points) of matches whose group has `least` characters."""
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""SELECT doc_id, '{kind}' AS kind, p0 AS a, p0 + length(m) AS b FROM (
  SELECT doc_id, ms[i] AS m, gs[i] AS g, CAST(coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS p0
  FROM (SELECT *, unnest(generate_series(1, len(ms))) AS i FROM (
    SELECT doc_id, string_split_regex(text, {p}) AS gaps, regexp_extract_all(text, {p}) AS ms, regexp_extract_all(text, {p}, {group}) AS gs
    FROM documents WHERE regexp_matches(text, {p})))) WHERE length(g) >= {least}"""


_ASSIGN_SQL = r"""(?i:password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)"""
_SPANS = " UNION ALL ".join((_found("assign", _ASSIGN_SQL, 6, 1), _found("access", "AKIA[A-Z0-9]+", 20), _found("hex", "[0-9a-f]+", 24)))
ORACLE_SQL["secret_base_columns"] = f"""
WITH spans AS ({_SPANS}),
sums AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, CASE kind WHEN 'assign' THEN 0 WHEN 'access' THEN 1 ELSE 2 END) AS joined FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(joined, '')) AS base_sha256
FROM documents d LEFT JOIN sums s ON d.doc_id = s.doc_id
"""
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
_PLACES = " UNION ALL ".join(
    f"SELECT doc_id, '{label}' AS label, unnest(list_filter(generate_series(0, len(w) - {len(p.split())}), lambda i: {' AND '.join(f'w[i + {k + 1}] = ' + repr(x) for k, x in enumerate(p.split()))})) AS place FROM words" for label, p in _PHRASES
)
ORACLE_SQL["license_base_columns"] = f"""
WITH words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
places AS ({_PLACES}),
sums AS (SELECT doc_id, count(*) AS n, min(place) AS lo, max(place) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word, coalesce(labels, '') AS base_labels
FROM words d LEFT JOIN sums s ON d.doc_id = s.doc_id
"""
QUERIES |= {"secret_base_columns": secret_base_columns, "license_base_columns": license_base_columns}
