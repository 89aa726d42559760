"""The registered queries of this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.html_extract import extract

    return extract(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.near_dedup import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.token_counts import count_tokens

    return count_tokens(_read(spark, sf_dir, "documents"), keep=["doc_id"])


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.decontaminate import find_leaks

    return find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.line_dedup import dedup_lines

    return dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.language_model import score_documents

    return score_documents(_read(spark, sf_dir, "documents"), order=3)


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.url_rules import filter_urls, site_rule

    sites = [site_rule("net/", "block"), site_rule("example.net/en/", "allow"), site_rule("example.com/de/", "block"), site_rule("org/fr/", "allow")]
    return filter_urls(_read(spark, sf_dir, "pages").select("page_id", "url"), sites).drop("url")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.quality import fit_bands, judge

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return judge(docs, fit_bands(docs, _read(spark, sf_dir, "labels"))).drop("text", "lang")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.bpe import encode_documents

    return encode_documents(_read(spark, sf_dir, "documents"), keep=["doc_id"]).drop("ids")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.store import new_folder
    from tideline.llm.warc import read_records, write_archives

    folder = new_folder(spark, "warc")
    return read_records(write_archives(_read(spark, sf_dir, "pages"), folder), folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extraction": op1_html_extraction,
        "op2_near_dedup": op2_near_dedup,
        "op3_token_counts": op3_token_counts,
        "op4_decontamination": op4_decontamination,
        "op5_line_dedup": op5_line_dedup,
        "op6_lm_scoring": op6_lm_scoring,
        "op7_url_filters": op7_url_filters,
        "op8_quality_rules": op8_quality_rules,
        "op9_byte_bpe": op9_byte_bpe,
        "op10_warc": op10_warc,
    }


# Words of hosts that the default rules block, as in url_rules.
_SPAM = r"(^|[^a-z0-9])(spam|spam-farm|casino|casino-win|pills|cheap-pills|free-bets|bets|ads|ads-track|adserver|doubleclick|viagra|poker|porn|xxx|payday-loan|replica-watches|clickbait|popunder)($|[^a-z0-9])"

OP7_SQL = f"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), cut AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM cut
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(host, '{_SPAM}') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all({_LOWER.format("text")}, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingles FROM w
), each AS (
  SELECT doc_id, len(shingles) AS n, unnest(shingles) AS s FROM sets
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM each a JOIN each b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY ALL HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))
), reach AS (
  SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, y FROM reach JOIN links ON x = r
), roots AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, len(shingles) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN roots USING (doc_id)
"""

# Lines are compared with white space made spaces; variants without one word find lines within one word.
_SPACES = "translate({}, chr(9) || chr(13) || chr(11) || chr(12), '    ')"
_ENDS = "' ' || chr(9) || chr(13) || chr(11) || chr(12)"

OP5_SQL = f"""
WITH split AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents
), lines AS (
  SELECT doc_id, p, trim({_SPACES.format("parts[p]")}, ' ') AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS p FROM split)
), counted AS (
  SELECT *, len(string_split(line, ' ')) AS n FROM lines WHERE len(string_split(line, ' ')) >= 3 OR length(line) >= 16
), firsts AS (
  SELECT line, any_value(n) AS n, min((doc_id, p)) AS o, string_split(line, ' ') AS w FROM counted GROUP BY line
), variants AS (
  SELECT line, i, array_to_string(list_concat(w[:i - 1], w[i + 1:]), ' ') AS v FROM (SELECT line, w, unnest(range(1, n + 1)) AS i FROM firsts WHERE n >= 8)
), near AS (
  SELECT DISTINCT line FROM (
    SELECT a.line, b.line AS other FROM variants a JOIN variants b ON a.v = b.v AND a.i = b.i AND a.line <> b.line
    UNION SELECT a.line, f.line FROM variants a JOIN firsts f ON f.line = a.v WHERE f.n >= 8
    UNION SELECT f.line, a.line FROM variants a JOIN firsts f ON f.line = a.v WHERE f.n >= 8
  ) JOIN firsts x USING (line) JOIN firsts y ON y.line = other WHERE y.o < x.o
), gone AS (
  SELECT doc_id, list(p) AS gone, count(near.line) AS n_near FROM counted JOIN firsts USING (line) LEFT JOIN near USING (line)
  WHERE near.line IS NOT NULL OR (doc_id, p) <> o GROUP BY doc_id
), rebuilt AS (
  SELECT doc_id, split.text AS before, gone, coalesce(n_near, 0) AS n_near, coalesce(len(parts), 0) AS n_lines,
         CASE WHEN gone IS NULL THEN split.text ELSE array_to_string(list_transform(list_filter(range(1, len(parts) + 1), lambda i: NOT list_contains(gone, i)), lambda i: parts[i]), chr(10)) END AS text
  FROM split LEFT JOIN gone USING (doc_id)
), ended AS (SELECT *, trim(coalesce(text, ''), {_ENDS} || chr(10)) AS remains FROM rebuilt)
SELECT doc_id, text, n_lines, coalesce(len(gone), 0) AS n_removed, n_near, gone IS NOT NULL AND (remains = '' OR (20 * length(remains) <= length(before) - length(text)
       AND len(list_filter(string_split(remains, chr(10)), lambda x: len(string_split(trim(x, {_ENDS}), ' ')) >= 3)) = 0)) AS emptied FROM ended
"""

OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, strlen(payload) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS INT) >> (15 - 5 * (i % 4))) & 31 AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_near_dedup": OP2_SQL, "op5_line_dedup": OP5_SQL, "op7_url_filters": OP7_SQL, "op10_warc": OP10_SQL}
