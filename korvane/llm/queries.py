"""Queries of the training-data operators over the whole test tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korvane import runtime
from korvane.llm import bpe, history, markup, near_duplicates, packing, repeated_lines, templates, term_counts, text_quality

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return runtime.spread(spark.read.parquet(f"{folder}/{table}.parquet"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return history.repeats(_read(spark, folder, "articles"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return templates.template_lines(_read(spark, folder, "articles"), _read(spark, folder, "pages"))


def p2_texts(spark: SparkSession, folder: str) -> DataFrame:
    return templates.main_texts(_read(spark, folder, "articles"), _read(spark, folder, "pages"))


def p3_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(field, value, occurrences, records, mark) of every distinct term of articles.text and value of freq.freq."""
    text = term_counts.text_term_counts(_read(spark, folder, "articles")).withColumn("field", F.lit("text"))
    freq = term_counts.value_counts(_read(spark, folder, "freq")).withColumn("field", F.lit("freq"))
    return text.unionByName(freq).select("field", "value", "occurrences", "records", "mark")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_counts(spark, folder).where(F.col("mark").isNotNull()).select("field", "value", "mark")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicate_pairs(_read(spark, folder, "articles"))


def p4_classes(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicate_classes(_read(spark, folder, "articles"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_lines.frequent_lines(_read(spark, folder, "articles"))


def p6_texts(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_lines.without_frequent_lines(_read(spark, folder, "articles"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return markup.markup_languages(_read(spark, folder, "articles"))


def p7_texts(spark: SparkSession, folder: str) -> DataFrame:
    return markup.clean_texts(_read(spark, folder, "articles"))


def p7_pages(spark: SparkSession, folder: str) -> DataFrame:
    return markup.extract_pages(_read(spark, folder, "pages"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_documents(_read(spark, folder, "documents"))


def p9_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(_read(spark, folder, "documents"))


def p10_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return text_quality.text_kinds(_read(spark, folder, "documents"), _read(spark, folder, "labels"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return p10_statistics(spark, folder).where(F.col("kind") != "prose").select("doc_id", "kind")


def p10_held_out(spark: SparkSession, folder: str) -> DataFrame:
    """Hand-checked documents that nothing was fitted on: their kind, the kind found, how many."""
    return text_quality.held_out_report(_read(spark, folder, "documents"), _read(spark, folder, "labels"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p2_found, p2_texts, p3_found, p3_counts, p4_found, p4_classes, p6_found, p6_texts, p7_found, p7_texts, p7_pages, p8_ids, p9_containers, p10_found, p10_statistics, p10_held_out)}


_TERM = r"[0-9A-Za-zЀ-ѿ]+(?:[-''][0-9A-Za-zЀ-ѿ]+)*"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZАБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ', 'abcdefghijklmnopqrstuvwxyzабвгдеёжзийклмнопрстуфхцчшщъыьэюя')"

_P3 = f"""
WITH term AS (
    SELECT article_id, {_LOWER.format("unnest(regexp_extract_all(text, '" + _TERM + "'))")} AS value FROM articles WHERE text IS NOT NULL
), counted AS (
    SELECT 'text' AS field, value, count(*) AS occurrences, count(DISTINCT article_id) AS records, (SELECT count(*) FROM articles WHERE text IS NOT NULL) AS total
    FROM term GROUP BY value
    UNION ALL
    SELECT 'freq', CAST(freq AS VARCHAR), count(*), count(DISTINCT rank), (SELECT count(DISTINCT rank) FROM freq WHERE freq IS NOT NULL)
    FROM freq WHERE freq IS NOT NULL GROUP BY freq
), marks AS (
    SELECT field, value, occurrences, records, CASE WHEN records > 0.2 * total THEN 'common' WHEN records <= 2 THEN 'rare' END AS mark FROM counted
)
"""

_P6 = r"""
WITH line AS (
    SELECT article_id, source, CAST(i AS INTEGER) AS line_no, parts[i] AS line
    FROM (SELECT article_id, source, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT article_id, source, string_split(text, chr(10)) AS parts FROM articles WHERE text IS NOT NULL))
), lettered AS (
    SELECT article_id, source, line_no, letters FROM (SELECT *, lower(regexp_replace(line, '[^\p{L}]+', '', 'g')) AS letters FROM line) WHERE length(letters) >= 4
), often AS (
    SELECT l.source, letters FROM lettered l
    JOIN (SELECT source, count(*) AS articles FROM articles WHERE text <> '' GROUP BY source) t USING (source)
    GROUP BY l.source, letters, articles HAVING count(DISTINCT article_id) >= 5 AND count(DISTINCT article_id) >= 0.05 * articles
)
"""


#: Distinct runs of three terms of every text with at least 20 terms, and all similar pairs.
_P4 = f"""
WITH worded AS (
    SELECT article_id, list_transform(regexp_extract_all(text, '{_TERM}'), lambda x: {_LOWER.format("x")}) AS w FROM articles
), shingle AS (
    SELECT DISTINCT article_id, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS s FROM (SELECT article_id, w, unnest(range(1, len(w) - 1)) AS i FROM worded WHERE len(w) >= 20)
), sized AS (
    SELECT article_id, count(*) AS n FROM shingle GROUP BY article_id
), near AS (
    SELECT a.article_id AS x, b.article_id AS y FROM shingle a JOIN shingle b ON a.s = b.s AND a.article_id < b.article_id
    JOIN sized m ON m.article_id = a.article_id JOIN sized n ON n.article_id = b.article_id
    GROUP BY a.article_id, b.article_id, m.n, n.n HAVING count(*) >= 0.5 * (m.n + n.n - count(*))
)
"""


#: Page of an address (host without user, port and www., decoded path, decoded parameters that choose content), links to earlier
#: records by page or text, and acceptance record by record.
_P1 = (
    _P4.replace("WITH worded", "WITH RECURSIVE worded").rstrip()
    + r""", cut AS (
    SELECT article_id, regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://)?([^/?#]*)', 1) AS host, regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://)?[^/?#]*([^?#]*)', 1) AS way,
    regexp_extract(trim(url), '^[^?#]*\?([^#]*)', 1) AS query FROM articles WHERE trim(url) <> ''
), page AS (
    SELECT article_id, concat(regexp_replace(regexp_replace(rtrim(lower(regexp_replace(host, '^.*@', '')), '.'), ':(80|443)?$', ''), '^www\.', ''),
    rtrim(url_decode(regexp_replace(regexp_replace(way, '/{2,}', '/', 'g'), '/\.(/|$)', '/', 'g')), '/'), '?',
    array_to_string(list_sort(list_filter(list_transform(regexp_split_to_array(query, '[&;]'), lambda x: url_decode(replace(x, '+', ' '))), lambda x: x <> '' AND NOT regexp_matches(lower(split_part(x, '=', 1)),
    '^(utm_\w+|[gfymt]clid|dclid|msclkid|gclsrc|_openstat|mc_[ce]id|igshid|_ga|ref|ref_src|from|source|share|s_cid|sessionid|phpsessid|sid)$'))), '&')) AS name FROM cut
), ordered AS (
    SELECT article_id, batch_no, row_number() OVER (ORDER BY batch_no, article_id) AS r FROM articles WHERE batch_no >= 0
), linked AS (
    SELECT x, y FROM near UNION SELECT y, x FROM near UNION SELECT a.article_id, b.article_id FROM page a JOIN page b ON a.name = b.name AND a.article_id <> b.article_id
), earlier AS (
    SELECT a.r, list(DISTINCT b.r) AS those FROM linked JOIN ordered a ON a.article_id = x JOIN ordered b ON b.article_id = y WHERE b.r < a.r GROUP BY a.r
), walk(r, accepted) AS (
    SELECT coalesce(max(r), 0), coalesce(list(r), []) FROM ordered WHERE batch_no = 0
    UNION ALL
    SELECT w.r + 1, CASE WHEN list_has_any(coalesce(e.those, []), w.accepted) THEN w.accepted ELSE list_append(w.accepted, w.r + 1) END
    FROM walk w JOIN ordered o ON o.r = w.r + 1 LEFT JOIN earlier e ON e.r = w.r + 1
)
"""
)


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1 + "SELECT article_id FROM ordered, (SELECT accepted FROM walk ORDER BY r DESC LIMIT 1) WHERE batch_no > 0 AND NOT list_contains(accepted, r)",
        "p4_found": _P4 + "SELECT x AS article_id_a, y AS article_id_b FROM near",
        "p3_found": _P3 + "SELECT field, value, mark FROM marks WHERE mark IS NOT NULL",
        "p3_counts": _P3 + "SELECT field, value, occurrences, records, mark FROM marks",
        "p6_found": _P6 + "SELECT article_id, line_no FROM lettered JOIN often USING (source, letters)",
        "p6_texts": _P6
        + """, gone AS (SELECT article_id, line_no FROM lettered JOIN often USING (source, letters))
SELECT a.article_id, CASE WHEN a.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text FROM articles a
LEFT JOIN (SELECT article_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM line ANTI JOIN gone USING (article_id, line_no) GROUP BY article_id) k USING (article_id)""",
    }
