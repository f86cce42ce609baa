"""SQL of the core queries over the same tables."""

from __future__ import annotations

from korvane.functions import text as tx

_TOKENS = f"regexp_extract_all({{0}}, '{tx.TOKEN.replace(chr(39), chr(39) * 2)}')"
_LOWER = f"translate({{0}}, '{tx.CAPITALS}', '{tx.SMALL}')"
_STEM = f"regexp_replace({{0}}, '(?:{'|'.join(tx.SUFFIXES)})$', '')"


def _term(token: str) -> str:
    return _STEM.format(_LOWER.format(token))


def _terms(table: str, key: str, body: str) -> str:
    return f"(SELECT {key}, {_term('token')} AS term FROM (SELECT {key}, unnest({_TOKENS.format(body)}) AS token FROM {table}))"


_DOC_TERMS = _terms("documents", "doc_id", "text")
_TF = f"(SELECT term, count(*) AS tf FROM {_DOC_TERMS} GROUP BY term)"
_RANKED = f"(SELECT row_number() OVER (ORDER BY tf DESC, term) AS rank, term, tf AS freq, max(tf) OVER () / row_number() OVER (ORDER BY tf DESC, term) AS zipf FROM {_TF})"
# Bytes of a page that is no UTF-8, by the table of windows-1251.
_CYRILLIC = "[" + ", ".join(f"'{c}'" if c != "'" else "chr(39)" for c in tx.CYRILLIC_HIGH) + "]"
_DECODED = f"""coalesce(TRY(decode(html)), array_to_string(list_transform(range(0, octet_length(html)), lambda i: CASE WHEN ('0x' || substr(hex(html), 2 * i + 1, 2))::INTEGER < 128
THEN chr(('0x' || substr(hex(html), 2 * i + 1, 2))::INTEGER) ELSE ({_CYRILLIC})[('0x' || substr(hex(html), 2 * i + 1, 2))::INTEGER - 127] END), ''))"""
_PAGES = f"""(SELECT url, arg_min(html, md5(html)) AS html FROM (SELECT url, {_DECODED} AS html FROM pages WHERE url IS NOT NULL) WHERE length(html) > 0 GROUP BY url)"""
_STRIPPED = """regexp_replace(regexp_replace(html, '[-'']<', ' <', 'g'), '<[^>]*>?', '', 'g')"""
_PAGE_TERMS = f"(SELECT url, {_term('token')} AS term FROM (SELECT url, unnest({_TOKENS.format(_STRIPPED)}) AS token FROM {_PAGES}))"
_UNITS = "strlen({0}) - length(regexp_replace({0}, '[^Ѐ-ѿ]', '', 'g'))"

_ALPHAS = "(SELECT 0.8::DOUBLE + 0.02::DOUBLE * i AS alpha FROM range(20) t(i))"
_SUMS = f"""(SELECT b, count(*) AS n, sum(l) AS sl, sum(l * l) AS sll, sum(y) AS sy, sum(y * y) AS syy, sum(l * y) AS sly
FROM (SELECT b, ln(freq) AS y, ln(rank + b) AS l FROM {_RANKED}, (SELECT 0.5::DOUBLE * i AS b FROM range(21) t(i))) GROUP BY b)"""
_FIT = f"""(SELECT alpha, b, exp(lc) AS c, syy + n * lc * lc + alpha * alpha * sll - 2 * lc * sy + 2 * alpha * sly - 2 * alpha * lc * sl AS error
FROM (SELECT *, (sy * sll - sl * sly) / (n * sll - sl * sl) AS lc FROM {_SUMS}), {_ALPHAS} ORDER BY error, alpha, b LIMIT 1)"""


def _has(term: str) -> str:
    return f"doc_id IN (SELECT doc_id FROM {_DOC_TERMS} WHERE term = '{term}')"


def _where(condition: str) -> str:
    return f"SELECT doc_id FROM documents WHERE {condition} ORDER BY doc_id"


_HOST = r"lower(regexp_replace(regexp_replace(regexp_extract({0}, '^(?:[A-Za-z][A-Za-z0-9+.\-]*://)?([^/?#]*)', 1), '^.*@', ''), ':\d*$', ''))"
_PATH = r"regexp_extract({0}, '^(?:[A-Za-z][A-Za-z0-9+.\-]*://)?[^/?#]*([^?#]*)', 1)"
_QUEUE = "(SELECT * FROM queue WHERE url IS NOT NULL)"
_NOW, _DUE = 1_772_000_000, 1_772_000_000 - 90 * 86_400

SQL: dict[str, str] = {
    "tokenize_documents": f"SELECT doc_id, pos - 1 AS pos, {_term('tokens[pos]')} AS term FROM (SELECT doc_id, tokens, unnest(range(1, len(tokens) + 1)) AS pos FROM (SELECT doc_id, {_TOKENS.format('text')} AS tokens FROM documents WHERE text IS NOT NULL))",
    "doc_token_counts": f"SELECT doc_id, coalesce(len({_TOKENS.format('text')}), 0) AS tokens, coalesce({_UNITS.format('text')}, 0) AS input_units FROM documents",
    "term_frequency": f"SELECT term, tf FROM {_TF}",
    "term_frequency_unstemmed": f"SELECT {_LOWER.format('token')} AS term, count(*) AS tf FROM (SELECT unnest({_TOKENS.format('text')}) AS token FROM documents) GROUP BY 1",
    "inverted_index": f"SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df, array_to_string(list_sort(list(DISTINCT doc_id)), ',') AS postings FROM {_DOC_TERMS} GROUP BY term",
    "inverted_index_chunks": f"SELECT term, doc_id // 4096 AS chunk, count(*) AS tf, count(DISTINCT doc_id) AS df, array_to_string(list_sort(list(DISTINCT doc_id)), ',') AS postings FROM {_DOC_TERMS} GROUP BY term, doc_id // 4096",
    "docs_table": "SELECT row_number() OVER (ORDER BY url) - 1 AS doc_id, url FROM (SELECT DISTINCT url FROM docs WHERE length(url) > 0)",
    "docs_lookup": f"SELECT DISTINCT doc_id, url FROM docs WHERE url IS NOT NULL AND {_has('вирус')} AND {_has('архив')}",
    "index_stats": f"""SELECT (SELECT count(*) FROM documents WHERE length(text) > 0) AS docs, count(*) AS terms, CAST(sum(tf) AS BIGINT) AS tokens, round(sum(tf * strlen(term)) / sum(tf), 6) AS avg_token_len,
round((SELECT sum({_UNITS.format('text')}) FROM documents WHERE length(text) > 0) / 1024.0, 6) AS input_kb, (SELECT CAST(sum(strlen(text)) AS BIGINT) FROM documents WHERE length(text) > 0) AS input_bytes FROM {_TF}""",
    "zipf_rank": f"SELECT rank, term, freq, round(zipf, 6) AS zipf FROM {_RANKED}",
    "mandelbrot_fit": f"SELECT round(alpha, 4) AS alpha, round(b, 4) AS b, round(c, 2) AS c, round(error, 2) AS error FROM {_FIT}",
    "mandelbrot_fit_free": f"""SELECT round(-slope, 4) AS alpha, round(b, 4) AS b, round(exp(lc), 2) AS c, round(error, 2) AS error FROM (
SELECT *, syy - lc * sy - slope * sly AS error FROM (SELECT *, (sy - slope * sl) / n AS lc FROM (SELECT *, (n * sly - sl * sy) / (n * sll - sl * sl) AS slope FROM {_SUMS})) ORDER BY error, b LIMIT 1)""",
    "mandelbrot_curve": f"SELECT rank, freq, round(zipf, 4) AS zipf, round(c / pow(rank + b, alpha), 4) AS mandelbrot FROM {_RANKED}, {_FIT}",
    "html_terms": f"SELECT term, count(*) AS tf FROM {_PAGE_TERMS} GROUP BY term",
    "html_inverted_index": f"SELECT term, count(*) AS tf, count(DISTINCT url) AS df, md5(array_to_string(list_sort(list(DISTINCT url)), ' ')) AS postings_md5 FROM {_PAGE_TERMS} GROUP BY term",
    "html_input_units": f"SELECT url, strlen(html) - length(regexp_replace({_STRIPPED}, '[^Ѐ-ѿ]', '', 'g')) AS input_units FROM {_PAGES}",
    "body_choice": f"SELECT article_id, CASE WHEN length(text) > 0 THEN 'text' WHEN strlen(html) > 0 THEN 'html' END AS body_kind FROM articles LEFT JOIN {_PAGES} p USING (url) WHERE url IS NOT NULL",
    "indexable": "SELECT article_id, url FROM articles a WHERE length(url) > 0 AND (length(text) > 0 OR EXISTS (SELECT 1 FROM pages p WHERE p.url = a.url AND octet_length(p.html) > 0))",
    "scan_limit": "SELECT article_id FROM (SELECT * FROM articles ORDER BY article_id LIMIT 500) WHERE length(text) > 0",
    "universe": "SELECT doc_id FROM documents",
    "bool_and": _where(f"{_has('вирус')} AND {_has('архив')}"),
    "bool_or": _where(f"{_has('архив')} OR {_has('system')}"),
    "bool_not": _where(f"NOT {_has('архив')}"),
    "bool_nested": _where(f"({_has('архив')} OR {_has('мост')}) AND NOT ({_has('граф')} OR {_has('the')})"),
    "bool_precedence": _where(f"{_has('архив')} OR ({_has('мост')} AND {_has('граф')})"),
    "bool_implicit_and": _where(f"{_has('нов')} AND {_has('архив')} AND {_has('мост')}"),
    "bool_missing_term": _where(f"{_has('архив')} AND {_has('несуществующееслов')}"),
    "bool_empty_term": _where(_has("")),
    "search_page_top50": f"SELECT doc_id, count(*) OVER () AS total FROM documents WHERE {_has('архив')} OR {_has('the')} ORDER BY doc_id LIMIT 50",
    "query_lexer": """SELECT * FROM (VALUES
('(linux or windows) and not python', 0, '(', ''), ('(linux or windows) and not python', 1, 'TERM', 'linux'), ('(linux or windows) and not python', 2, 'OR', ''), ('(linux or windows) and not python', 3, 'TERM', 'windows'),
('(linux or windows) and not python', 4, ')', ''), ('(linux or windows) and not python', 5, 'AND', ''), ('(linux or windows) and not python', 6, 'NOT', ''), ('(linux or windows) and not python', 7, 'TERM', 'python'),
('e-mail- c++', 0, 'TERM', 'e-mail-'), ('e-mail- c++', 1, 'AND', ''), ('e-mail- c++', 2, 'TERM', 'c'),
('Дом и не домами', 0, 'TERM', 'д'), ('Дом и не домами', 1, 'AND', ''), ('Дом и не домами', 2, 'NOT', ''), ('Дом и не домами', 3, 'TERM', 'дом'),
('linux)', 0, 'TERM', 'linux'), ('linux)', 1, ')', ''), ('не не а', 0, 'NOT', ''), ('не не а', 1, 'NOT', ''), ('не не а', 2, 'TERM', '')) t(query, pos, kind, term)""",
    "query_postfix": """SELECT * FROM (VALUES ('(linux or windows) and not python', 'linux windows OR python NOT AND'), ('e-mail- c++', 'e-mail- c AND'), ('Дом и не домами', 'д дом NOT AND'), ('linux)', 'linux'), ('не не а', ' NOT NOT'),
('вирус и архив', 'вирус архив AND'), ('архив или system', 'архив system OR'), ('не архив', 'архив NOT'), ('(архив или мост) и не (граф или the)', 'архив мост OR граф the OR NOT AND'), ('архив or мост and граф', 'архив мост граф AND OR'),
('новый архив -мост', 'нов архив AND мост AND'), ('архив и несуществующееслово', 'архив несуществующееслов AND'), ('я или а', '  OR')) t(query, postfix)""",
    "ru_lower": f"SELECT article_id, token, {_LOWER.format('token')} AS lowered FROM (SELECT article_id, unnest({_TOKENS.format('text')}) AS token FROM articles)",
    "ru_stem": f"SELECT article_id, token, {_term('token')} AS term FROM (SELECT article_id, unnest({_TOKENS.format('text')}) AS token FROM articles)",
    "extract_links": f"""SELECT url, CAST(pos - 1 AS INTEGER) AS pos, links[pos] AS link FROM (SELECT url, links, unnest(range(1, len(links) + 1)) AS pos FROM (
SELECT url, list_filter(regexp_extract_all(html, '(?is)href\\s*=\\s*"([^"]*)"', 1), lambda v: regexp_matches(v, '^https?://') AND strlen(v) < 2048)[1:200] AS links FROM {_PAGES}))""",
    "normalize_url": r"""SELECT DISTINCT url, CASE WHEN authority = '' THEN url ELSE concat(scheme, '://', CASE scheme WHEN 'http' THEN regexp_replace(authority, ':(80)?$', '') WHEN 'https' THEN regexp_replace(authority, ':(443)?$', '') ELSE authority END,
CASE path WHEN '' THEN '/' ELSE path END, rest) END AS normal FROM (SELECT url, CASE p[1] WHEN '' THEN 'http' ELSE lower(p[1]) END AS scheme, lower(p[2]) AS authority, p[3] AS path, p[4] AS rest FROM (
SELECT url, [regexp_extract(url, '^(?:([A-Za-z][A-Za-z0-9+.\-]*)://)?([^/?#]*)([^?#]*)(.*)$', i, 's') FOR i IN [1, 2, 3, 4]] AS p FROM queue))""".replace(
        "[regexp_extract(url, '^(?:([A-Za-z][A-Za-z0-9+.\\-]*)://)?([^/?#]*)([^?#]*)(.*)$', i, 's') FOR i IN [1, 2, 3, 4]]",
        "[" + ", ".join(f"regexp_extract(url, '^(?:([A-Za-z][A-Za-z0-9+.\\-]*)://)?([^/?#]*)([^?#]*)(.*)$', {i}, 's')" for i in (1, 2, 3, 4)) + "]",
    ),
    "url_parts": f"SELECT article_id, {_HOST.format('url')} AS host, {_PATH.format('url')} AS path FROM articles",
    "url_allowed": f"""SELECT url, coalesce(h <> '' AND (h IN ('example.org', 'kodoved.example', 'svodopediya.example.net') OR h LIKE '%.example.org' OR h LIKE '%.kodoved.example' OR h LIKE '%.svodopediya.example.net'), false)
AND NOT coalesce(regexp_matches(lower({_PATH.format('url')}), '\\.(pdf|jpg|png|zip)$'), false) AS allowed FROM (SELECT DISTINCT url, {_HOST.format('url')} AS h FROM queue)""",
    "is_article_url": f"""SELECT url, CASE WHEN ends_with(h, 'ru.wikipedia.org') THEN regexp_matches({_PATH.format('url')}, '^/wiki/[^:]+$') WHEN ends_with(h, 'habr.com') THEN regexp_matches({_PATH.format('url')}, '^/ru/articles/[0-9]+/') ELSE false END AS is_article
FROM (SELECT url, {_HOST.format('url')} AS h FROM (SELECT url FROM articles WHERE url IS NOT NULL UNION SELECT * FROM (VALUES ('https://ru.wikipedia.org/wiki/Архив'), ('https://ru.wikipedia.org/wiki/Файл:a'), ('https://m.ru.wikipedia.org/wiki/X'),
('https://xhabr.com/ru/articles/12/'), ('https://habr.com/ru/articles/a/'), ('https://habr.com/en/articles/1/'), ('http://other.example/wiki/A')) t(u)))""",
    "url_patterns": r"SELECT article_id, url FROM articles WHERE regexp_matches(url, '^https?://[^/]+/wiki/[^:#?]+$') OR regexp_matches(url, '^https?://[^/]+/articles/\d+')",
    "url_decode": "SELECT article_id, url_decode(replace(regexp_replace(url, '%([^0-9A-Fa-f]|$)', '%25\\1', 'g'), '+', ' ')) AS decoded FROM articles WHERE url IS NOT NULL",
    "safe_filename": "SELECT article_id, substr(CASE n WHEN '' THEN substr(sha256(url), 1, 16) ELSE n END, 1, 150) AS name FROM (SELECT article_id, url, trim(regexp_replace(url, '[^a-zA-Z0-9._-]+', '_', 'g'), '_') AS n FROM articles WHERE url IS NOT NULL)",
    "content_hash": "SELECT url, sha256(html) AS sha, sha256(html) = hash AS as_stored FROM pages WHERE html IS NOT NULL",
    "change_detection": """WITH r AS (SELECT url, fetched_at, sha256(html) AS sha FROM pages WHERE url IS NOT NULL AND html IS NOT NULL)
SELECT url, fetched_at, sha, sha IS DISTINCT FROM first_value(sha) OVER (PARTITION BY url ORDER BY fetched_at NULLS FIRST, sha) AS changed FROM r""",
    "store_pages": f"""WITH p AS (SELECT * FROM (SELECT url, coalesce(hash, '') AS hash, fetched_at, last_checked, row_number() OVER (PARTITION BY url ORDER BY coalesce(hash, '') DESC, coalesce(fetched_at, 0) DESC) AS k FROM pages WHERE url IS NOT NULL) WHERE k = 1),
n AS (SELECT url, max(sha256(text)) AS hash FROM articles WHERE url IS NOT NULL AND text IS NOT NULL GROUP BY url)
SELECT coalesce(p.url, n.url) AS url, coalesce(n.hash, p.hash) AS hash, CASE WHEN n.url IS NOT NULL AND n.hash IS DISTINCT FROM p.hash THEN {_NOW} ELSE p.fetched_at END AS fetched_at,
CASE WHEN n.hash = p.hash THEN {_NOW} ELSE p.last_checked END AS last_checked FROM p FULL JOIN n ON p.url = n.url""",
    "queue_insert_if_absent": f"SELECT url, source, depth FROM {_QUEUE} UNION ALL SELECT url, min(source), 0 FROM articles WHERE url IS NOT NULL AND url NOT IN (SELECT url FROM {_QUEUE}) GROUP BY url",
    "queue_reset": f"SELECT CASE status WHEN 'processing' THEN 'pending' ELSE status END AS status, count(*) AS rows FROM {_QUEUE} GROUP BY 1",
    "queue_claim": f"SELECT DISTINCT url, source, depth, status, enqueued_at FROM {_QUEUE} WHERE status = 'pending' ORDER BY enqueued_at NULLS LAST, url, depth NULLS FIRST, source NULLS FIRST LIMIT 100",
    "queue_dequeue": f"SELECT url, source, depth FROM {_QUEUE} WHERE url NOT IN (SELECT url FROM pages WHERE url IS NOT NULL)",
    "depth_gate": f"SELECT url, depth FROM {_QUEUE} WHERE depth < 2",
    "unique_urls": f"""SELECT url, depth, status, enqueued_at FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY coalesce(enqueued_at, 0) DESC, coalesce(depth, -1) DESC, coalesce(status, '') DESC) AS k FROM {_QUEUE}) WHERE k = 1""",
    "upsert_latest": """SELECT article_id, url FROM (SELECT article_id, url, row_number() OVER (PARTITION BY k ORDER BY article_id DESC) AS n FROM (SELECT article_id, url, coalesce(nullif(url, ''), nullif(text, '')) AS k FROM articles) WHERE k IS NOT NULL) WHERE n = 1""",
    "upsert_merge": """WITH d AS (SELECT doc_id, nullif(max(coalesce(url, '')), '') AS url FROM docs WHERE doc_id IS NOT NULL GROUP BY doc_id),
n AS (SELECT doc_id, max(concat('label:', coalesce(kind, ''), ':', coalesce(annotator, ''))) AS url FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id)
SELECT coalesce(n.doc_id, d.doc_id) AS doc_id, CASE WHEN n.doc_id IS NOT NULL THEN n.url ELSE d.url END AS url FROM d FULL JOIN n ON d.doc_id = n.doc_id""",
    "revisit_due": f"SELECT DISTINCT url, fetched_at FROM pages WHERE url IS NOT NULL AND fetched_at <= {_DUE} ORDER BY fetched_at, url LIMIT 200",
    "corpus_stats": """SELECT count(*) AS documents, (SELECT CAST(sum(octet_length(html)) AS BIGINT) FROM pages) AS raw_total_bytes, CAST(sum(strlen(text)) AS BIGINT) AS text_total_bytes,
round((SELECT sum(octet_length(html)) FROM pages) / count(*), 4) AS avg_raw_bytes, round(sum(strlen(text)) / count(*), 4) AS avg_text_bytes FROM articles""",
    "collection_counts": "SELECT 'articles' AS collection, count(*) AS rows FROM articles UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'queue', count(*) FROM queue UNION ALL SELECT 'docs', count(*) FROM docs",
    "sitemap_locs": "SELECT DISTINCT source, 'urlset' AS root, url AS loc FROM articles WHERE url IS NOT NULL",
    "rss_links": "SELECT article_id, url AS link FROM articles WHERE url IS NOT NULL",
    "jsonl_roundtrip": "SELECT source, url, title, author, published_at, text, raw_path, fetched_at FROM articles",
    "index_tsv_roundtrip": f"SELECT term, count(DISTINCT doc_id) AS df, array_to_string(list_sort(list(DISTINCT doc_id)), ',') AS postings FROM {_DOC_TERMS} GROUP BY term",
    "index_tsv_file": f"SELECT term, array_to_string(list_sort(list(DISTINCT doc_id)), ',') AS postings FROM {_DOC_TERMS} GROUP BY term",
    "docs_tsv_file": "SELECT DISTINCT doc_id, url FROM docs WHERE doc_id IS NOT NULL AND url IS NOT NULL",
    "freq_csv_file": f"SELECT rank, freq, round(printf('%.6f', zipf)::DOUBLE, 3) AS zipf, 0.0::DOUBLE AS mandelbrot FROM {_RANKED}",
    "sitemap_walk": "SELECT url FROM (SELECT DISTINCT source, trim(url) AS url FROM articles WHERE url IS NOT NULL AND source IS NOT NULL) WHERE url <> '' AND regexp_matches(url, '/wiki/|/articles?/')",
    "stream_upsert_pages": "SELECT url, max(hash) AS hash FROM pages WHERE url IS NOT NULL AND hash IS NOT NULL GROUP BY url",
    "freq_scan": "SELECT rank, coalesce(freq, 0) AS freq, printf('%.6f', coalesce(zipf, 0)) AS zipf, printf('%.6f', coalesce(mandelbrot, 0)) AS mandelbrot FROM freq",
    "report_stats_parse": f"""SELECT docs::DOUBLE AS "Docs", terms::DOUBLE AS "Terms", tokens::DOUBLE AS "Tokens", round(bytes / tokens, 5) AS "AvgTokenLen", round(kb, 5) AS "InputKB", 2.5::DOUBLE AS "Elapsed", round(kb / 2.5, 4) AS "SpeedKBps" FROM (
SELECT (SELECT count(*) FROM documents WHERE length(text) > 0) AS docs, count(*) AS terms, sum(tf) AS tokens, sum(tf * strlen(term)) AS bytes, (SELECT sum({_UNITS.format('text')}) FROM documents WHERE length(text) > 0) / 1024.0::DOUBLE AS kb FROM {_TF})""",
    "crawl_bfs": f"""WITH RECURSIVE page AS (SELECT url, html FROM {_PAGES}), link AS (SELECT DISTINCT url AS src, unnest(list_filter(regexp_extract_all(html, '(?is)href\\s*=\\s*"([^"]*)"', 1), lambda v: regexp_matches(v, '^https?://') AND strlen(v) < 2048)[1:200]) AS raw FROM page),
edge AS (SELECT src, {{norm}} AS dst FROM link), seed AS (SELECT DISTINCT {{norm_url}} AS url FROM page),
reach(url, depth) AS (SELECT url, 0 FROM seed UNION SELECT dst, depth + 1 FROM reach JOIN edge ON src = url WHERE depth < 2)
SELECT url, min(depth) AS depth FROM reach GROUP BY url""",
}


def _normal(url: str) -> str:
    part = lambda i: f"regexp_extract({url}, '^(?:([A-Za-z][A-Za-z0-9+.\\-]*)://)?([^/?#]*)([^?#]*)(.*)$', {i}, 's')"
    return f"concat(lower({part(1)}), '://', regexp_replace(lower({part(2)}), CASE lower({part(1)}) WHEN 'http' THEN ':(80)?$' ELSE ':(443)?$' END, ''), CASE {part(3)} WHEN '' THEN '/' ELSE {part(3)} END, {part(4)})"


SQL["stream_new_addresses"] = SQL["normalize_url"].replace("SELECT DISTINCT url, CASE WHEN authority", "SELECT DISTINCT CASE WHEN authority", 1).replace(" AS normal ", " AS url ").replace("FROM queue", "FROM queue WHERE url IS NOT NULL")
SQL["crawl_bfs"] = SQL["crawl_bfs"].replace("{norm}", _normal("raw")).replace("{norm_url}", _normal("url"))


def _meta(names: tuple[str, ...]) -> str:
    pattern = """(?is)<meta\\s[^>]*?{a}\\s*=\\s*["'']{n}["''][^>]*?content\\s*=\\s*["'']([^"'']*)["'']"""
    found = [f"nullif(trim(regexp_extract(html, '{pattern.format(a=a, n=n)}', 1)), '')" for n in names for a in ("name", "property")]
    return f"coalesce({', '.join(found)})"


SQL["meta_lookup"] = f"SELECT url, {_meta(('og:title', 'twitter:title'))} AS title, {_meta(('article:published_time', 'date', 'article:published'))} AS published_at FROM {_PAGES}"
