"""Registered queries of the core operators over the whole test tables, and the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from korvane import runtime
from korvane.functions import text as tx
from korvane.functions import urls as uf
from korvane.operators import boolean, corpus, crawl, index, keyed, timestamps, zipf
from korvane.sources import files
from korvane.streaming import crawl as streams

Query = Callable[[SparkSession, str], DataFrame]

#: Seconds since 1970 at which revisits are asked for, and the age that makes one due.
NOW, REVISIT_S = 1_772_000_000, 90 * 86_400
_DENIED = (".pdf", ".jpg", ".png", ".zip")
_DOMAINS = ("example.org", "kodoved.example", "svodopediya.example.net")
BOOLEAN = {
    "bool_and": "вирус и архив",
    "bool_or": "архив или system",
    "bool_not": "не архив",
    "bool_nested": "(архив или мост) и не (граф или the)",
    "bool_precedence": "архив or мост and граф",
    "bool_implicit_and": "новый архив -мост",
    "bool_missing_term": "архив и несуществующееслово",
    "bool_empty_term": "я или а",
}


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return runtime.spread(spark.read.parquet(f"{folder}/{table}.parquet"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return timestamps.normalize_instants(_read(spark, folder, "articles"), _read(spark, folder, "sources"), ("published_at", "fetched_at"))


def tokenize_documents(spark: SparkSession, folder: str) -> DataFrame:
    return index.positions(_read(spark, folder, "documents"))


def doc_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return index.doc_token_counts(_read(spark, folder, "documents"))


def term_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return index.term_frequency(_read(spark, folder, "documents"))


def term_frequency_unstemmed(spark: SparkSession, folder: str) -> DataFrame:
    return index.term_frequency(_read(spark, folder, "documents"), stem=False)


def _postings(spark: SparkSession, folder: str) -> DataFrame:
    return index.postings(_read(spark, folder, "documents"))


_STORED: dict[tuple[str, str], str] = {}


def _stored_postings(spark: SparkSession, folder: str) -> DataFrame:
    """The stored index of a folder's documents, built by the first query of a session that asks for it, as a search engine loads its index once."""
    name = (spark.sparkContext.applicationId, folder)
    if name not in _STORED:
        path = f"{runtime.shared_dir(spark)}/postings-{uuid.uuid4().hex}"
        index.write_postings(_postings(spark, folder), path)
        _STORED[name] = path
    return spark.read.schema("term string, doc_id bigint, tf bigint").parquet(_STORED[name])


def inverted_index(spark: SparkSession, folder: str) -> DataFrame:
    return index.inverted_index(_postings(spark, folder)).withColumn("postings", F.concat_ws(",", F.col("postings").cast("array<string>")))


def inverted_index_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return index.inverted_index(_postings(spark, folder), 4096).withColumn("postings", F.concat_ws(",", F.col("postings").cast("array<string>")))


def docs_table(spark: SparkSession, folder: str) -> DataFrame:
    return index.docs_table(_read(spark, folder, "docs").select("url").distinct())


def docs_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses of the hits of a query, by id."""
    docs = _read(spark, folder, "docs").where(F.col("doc_id").isNotNull() & F.col("url").isNotNull()).distinct()
    return boolean.search(_stored_postings(spark, folder), docs, BOOLEAN["bool_and"])


def index_stats(spark: SparkSession, folder: str) -> DataFrame:
    return index.index_stats(_read(spark, folder, "documents")).select("docs", "terms", "tokens", F.round("avg_token_len", 6).alias("avg_token_len"), F.round("input_kb", 6).alias("input_kb"), "input_bytes")


def _ranked(spark: SparkSession, folder: str) -> DataFrame:
    return zipf.zipf_rank(index.term_frequency(_read(spark, folder, "documents")))


def zipf_rank(spark: SparkSession, folder: str) -> DataFrame:
    return _ranked(spark, folder).withColumn("zipf", F.round("zipf", 6))


def mandelbrot_fit(spark: SparkSession, folder: str) -> DataFrame:
    return zipf.mandelbrot_fit(_ranked(spark, folder)).select(F.round("alpha", 4).alias("alpha"), F.round("b", 4).alias("b"), F.round("c", 2).alias("c"), F.round("error", 2).alias("error"))


def mandelbrot_fit_free(spark: SparkSession, folder: str) -> DataFrame:
    return zipf.mandelbrot_fit_free(_ranked(spark, folder)).select(F.round("alpha", 4).alias("alpha"), F.round("b", 4).alias("b"), F.round("c", 2).alias("c"), F.round("error", 2).alias("error"))


def mandelbrot_curve(spark: SparkSession, folder: str) -> DataFrame:
    ranked = runtime.written(_ranked(spark, folder), "ranked")
    return zipf.mandelbrot_curve(ranked, zipf.mandelbrot_fit(ranked)).select("rank", "freq", F.round("zipf", 4).alias("zipf"), F.round("mandelbrot", 4).alias("mandelbrot"))


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    """Valid pages, one per url: that with the smallest hash of its bytes."""
    rows = _read(spark, folder, "pages").select("url", tx.page_text(F.col("html")).alias("html")).where(F.col("url").isNotNull() & (F.length("html") > 0))
    return rows.groupBy("url").agg(F.min_by("html", F.struct(F.md5("html"))).alias("html"))


def html_terms(spark: SparkSession, folder: str) -> DataFrame:
    return index.term_frequency(_pages(spark, folder), "url", None, "html")


def html_inverted_index(spark: SparkSession, folder: str) -> DataFrame:
    rows = index.postings(_pages(spark, folder), "url", None, "html")
    return index.inverted_index(rows).select("term", "tf", "df", F.md5(F.concat_ws(" ", "postings")).alias("postings_md5"))


def html_input_units(spark: SparkSession, folder: str) -> DataFrame:
    return _pages(spark, folder).select("url", tx.html_input_units(F.col("html")).alias("input_units"))


def body_choice(spark: SparkSession, folder: str) -> DataFrame:
    """Of each article: its text, else its page's, and how many terms that gives."""
    rows = _read(spark, folder, "articles").join(_pages(spark, folder), "url", "left").where(F.col("url").isNotNull())
    return index.body_choice(rows).select("article_id", "body_kind")


def indexable(spark: SparkSession, folder: str) -> DataFrame:
    """Articles that an index takes, with the pages saved under their addresses."""
    pages = _read(spark, folder, "pages").where(F.col("url").isNotNull()).groupBy("url").agg(F.max_by("html", F.octet_length("html")).alias("html"))
    return index.indexable(_read(spark, folder, "articles").join(pages, "url", "left")).select("article_id", "url")


def scan_limit(spark: SparkSession, folder: str) -> DataFrame:
    """The limit comes before the filter: of the first 500 rows those with text."""
    return _read(spark, folder, "articles").orderBy("article_id").limit(500).where(F.length("text") > 0).select("article_id")


def _documents_ids(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "documents").select("doc_id")


def _boolean(query: str) -> Query:
    return lambda spark, folder: boolean.search(_stored_postings(spark, folder), _documents_ids(spark, folder), query)


def search_page_top50(spark: SparkSession, folder: str) -> DataFrame:
    return boolean.search_page(_stored_postings(spark, folder), _documents_ids(spark, folder), "архив or the")


def universe(spark: SparkSession, folder: str) -> DataFrame:
    return _documents_ids(spark, folder)


_LEXED = ("(linux or windows) and not python", "e-mail- c++", "Дом и не домами", "linux)", "не не а")


def query_lexer(spark: SparkSession, folder: str) -> DataFrame:
    rows = [(q, i, t.kind, t.text) for q in _LEXED for i, t in enumerate(boolean.lex(q))]
    return spark.createDataFrame(rows, "query string, pos int, kind string, term string")


def query_postfix(spark: SparkSession, folder: str) -> DataFrame:
    rows = [(q, " ".join(t.text if t.kind == "TERM" else t.kind for t in boolean.postfix(boolean.lex(q)))) for q in (*_LEXED, *BOOLEAN.values())]
    return spark.createDataFrame(rows, "query string, postfix string")


def ru_lower(spark: SparkSession, folder: str) -> DataFrame:
    return index.body_tokens(_read(spark, folder, "articles"), "article_id").select(F.col("doc_id").alias("article_id"), "token", tx.ru_lower(F.col("token")).alias("lowered"))


def ru_stem(spark: SparkSession, folder: str) -> DataFrame:
    return index.body_tokens(_read(spark, folder, "articles"), "article_id").select(F.col("doc_id").alias("article_id"), "token", tx.term(F.col("token")).alias("term"))


def extract_links(spark: SparkSession, folder: str) -> DataFrame:
    return _pages(spark, folder).select("url", F.posexplode(uf.extract_links(F.col("html"), 200)).alias("pos", "link"))


def normalize_url(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "queue").select("url", uf.normalize_url(F.col("url")).alias("normal")).distinct()


def url_parts(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "articles").select("article_id", uf.host(F.col("url")).alias("host"), uf.path(F.col("url")).alias("path"))


def url_allowed(spark: SparkSession, folder: str) -> DataFrame:
    rows = _read(spark, folder, "queue").select("url").distinct()
    return rows.select("url", uf.url_allowed(F.col("url"), _DOMAINS, _DENIED).alias("allowed"))


_ARTICLE_URLS = ("https://ru.wikipedia.org/wiki/Архив", "https://ru.wikipedia.org/wiki/Файл:a", "https://m.ru.wikipedia.org/wiki/X", "https://xhabr.com/ru/articles/12/", "https://habr.com/ru/articles/a/", "https://habr.com/en/articles/1/", "http://other.example/wiki/A")


def is_article_url(spark: SparkSession, folder: str) -> DataFrame:
    fixed = spark.createDataFrame([(u,) for u in _ARTICLE_URLS], "url string")
    rows = _read(spark, folder, "articles").select("url").where(F.col("url").isNotNull()).unionByName(fixed).distinct()
    return rows.select("url", uf.is_article_url(F.col("url")).alias("is_article"))


def url_patterns(spark: SparkSession, folder: str) -> DataFrame:
    rows = _read(spark, folder, "articles").where(uf.matches_any(F.col("url"), (r"^https?://[^/]+/wiki/[^:#?]+$", r"^https?://[^/]+/articles/\d+")))
    return rows.select("article_id", "url")


def url_decode(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "articles").where(F.col("url").isNotNull()).select("article_id", uf.url_decode(F.col("url")).alias("decoded"))


def safe_filename(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "articles").where(F.col("url").isNotNull()).select("article_id", uf.safe_filename(F.col("url")).alias("name"))


def content_hash(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "pages").where(F.col("html").isNotNull()).select("url", uf.content_hash(F.col("html")).alias("sha"), (uf.content_hash(F.col("html")) == F.col("hash")).alias("as_stored"))


def change_detection(spark: SparkSession, folder: str) -> DataFrame:
    """Every later crawl of a page against the first: whether its body is new."""
    rows = _read(spark, folder, "pages").where(F.col("url").isNotNull() & F.col("html").isNotNull()).select("url", "fetched_at", uf.content_hash(F.col("html")).alias("sha"))
    first = rows.groupBy("url").agg(F.min(F.struct("fetched_at", "sha")).alias("first"))
    return rows.join(first, "url").select("url", "fetched_at", "sha", (~F.col("sha").eqNullSafe(F.col("first.sha"))).alias("changed"))


def store_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The saved pages after the articles' texts came in as new bodies of their addresses."""
    pages = keyed.latest(_read(spark, folder, "pages").where(F.col("url").isNotNull()).withColumn("hash", F.coalesce("hash", F.lit(""))), ["url"], [F.col("hash"), F.coalesce("fetched_at", F.lit(0))]).withColumn("html", F.col("html").cast("string"))
    new = _read(spark, folder, "articles").where(F.col("url").isNotNull() & F.col("text").isNotNull()).select("url", F.col("text").alias("html"), "source", uf.content_hash(F.col("text")).alias("hash"))
    return keyed.store_pages(pages, new, NOW).select("url", "hash", "fetched_at", "last_checked")


def _queue(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "queue").where(F.col("url").isNotNull())


def queue_insert_if_absent(spark: SparkSession, folder: str) -> DataFrame:
    """The queue's addresses with those of articles that it lacks, at depth 0."""
    queue = _queue(spark, folder).select("url", "source", "depth")
    new = _read(spark, folder, "articles").where(F.col("url").isNotNull()).select("url", "source", F.lit(0).alias("depth"))
    return keyed.insert_if_absent(queue, new, "url", [F.col("source")])


def queue_reset(spark: SparkSession, folder: str) -> DataFrame:
    return keyed.reset_processing(_queue(spark, folder)).groupBy("status").agg(F.count(F.lit(1)).alias("rows"))


def queue_claim(spark: SparkSession, folder: str) -> DataFrame:
    return keyed.claim(_queue(spark, folder).select("url", "source", "depth", "status", "enqueued_at").distinct(), 100)


def queue_dequeue(spark: SparkSession, folder: str) -> DataFrame:
    return keyed.dequeue(_queue(spark, folder), _read(spark, folder, "pages").where(F.col("url").isNotNull())).select("url", "source", "depth")


def depth_gate(spark: SparkSession, folder: str) -> DataFrame:
    return _queue(spark, folder).where(F.col("depth") < 2).select("url", "depth")


def unique_urls(spark: SparkSession, folder: str) -> DataFrame:
    """One row per address: the last that was enqueued."""
    order = [F.coalesce("enqueued_at", F.lit(0)), F.coalesce("depth", F.lit(-1)), F.coalesce("status", F.lit(""))]
    return keyed.latest(_queue(spark, folder).select("url", "depth", "status", "enqueued_at"), ["url"], order)


def upsert_latest(spark: SparkSession, folder: str) -> DataFrame:
    """Article records loaded by url, else by text; the last article_id wins."""
    rows = _read(spark, folder, "articles").select("article_id", "url", "text")
    return corpus.load_records(None, rows, [F.col("article_id")]).select("article_id", "url")


def upsert_merge(spark: SparkSession, folder: str) -> DataFrame:
    """The docs table with the ids of documents set again: known ids get a new address, others are added."""
    docs = keyed.latest(_read(spark, folder, "docs").where(F.col("doc_id").isNotNull()), ["doc_id"], [F.coalesce("url", F.lit(""))])
    new = _read(spark, folder, "labels").where(F.col("doc_id").isNotNull()).select("doc_id", F.concat(F.lit("label:"), F.coalesce("kind", F.lit("")), F.lit(":"), F.coalesce("annotator", F.lit(""))).alias("url"))
    return keyed.upsert(docs, new, "doc_id", [F.col("url")])


def revisit_due(spark: SparkSession, folder: str) -> DataFrame:
    rows = _read(spark, folder, "pages").where(F.col("url").isNotNull()).select("url", "fetched_at").distinct()
    return keyed.revisit_due(rows.withColumn("last_checked", F.lit(None).cast("bigint")), NOW, REVISIT_S).select("url", "fetched_at")


def crawl_bfs(spark: SparkSession, folder: str) -> DataFrame:
    """Least depth of every address reached in two steps from the saved pages, by the links of those pages."""
    pages = _pages(spark, folder)
    return crawl.bfs(pages.select("url"), crawl.saved_pages(pages), crawl.CrawlConfig(max_depth=2))


def article_extract(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.extract_articles(_pages(spark, folder), ("url",))


def meta_lookup(spark: SparkSession, folder: str) -> DataFrame:
    page = F.col("html")
    return _pages(spark, folder).select("url", corpus.meta_value(page, corpus.TITLE_METAS).alias("title"), corpus.meta_value(page, corpus.DATE_METAS).alias("published_at"))


def corpus_stats(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.corpus_stats(_read(spark, folder, "articles"), _read(spark, folder, "pages")).select("documents", "raw_total_bytes", "text_total_bytes", F.round("avg_raw_bytes", 4).alias("avg_raw_bytes"), F.round("avg_text_bytes", 4).alias("avg_text_bytes"))


def collection_counts(spark: SparkSession, folder: str) -> DataFrame:
    parts = [_read(spark, folder, t).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(t).alias("collection"), "rows") for t in ("articles", "pages", "queue", "docs")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _escaped(value: Column) -> Column:
    """As XML writes it."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        value = F.replace(value, F.lit(sign), F.lit(name))
    return value


def sitemap_locs(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses that come back from one sitemap for each source, written from the articles and read again."""
    rows = _read(spark, folder, "articles").where(F.col("url").isNotNull()).select("source", _escaped(F.col("url")).alias("url")).distinct()
    maps = rows.groupBy(F.col("source").alias("url"), F.pmod(F.xxhash64("url"), F.lit(64)).alias("piece")).agg(
        F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.array_join(F.transform(F.array_sort(F.collect_list("url")), lambda u: F.concat(F.lit("<url><loc> "), u, F.lit("\n</loc></url>"))), ""), F.lit("</urlset>")).alias("xml")
    )
    return files.sitemap_locations(maps).select(F.col("url").alias("source"), "root", "loc")


def rss_links(spark: SparkSession, folder: str) -> DataFrame:
    rows = _read(spark, folder, "articles").where(F.col("url").isNotNull())
    feeds = rows.select("article_id", F.concat(F.lit("<rss><channel><item><link>"), _escaped(F.col("url")), F.lit("</link></item></channel></rss>")).alias("xml"))
    return files.rss_links(feeds, "article_id").select("article_id", "link")


def jsonl_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{runtime.shared_dir(spark)}/jsonl-{abs(hash(folder)) % 10**8}"
    rows = _read(spark, folder, "articles").select("source", "url", "title", "author", "published_at", "text", "raw_path", "fetched_at")
    files.write_jsonl(rows, path)
    return files.read_jsonl(spark, path)


def index_tsv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    built = index.posting_lists(_read(spark, folder, "documents"))
    lines = built.select(F.concat_ws("\t", "term", F.col("df").cast("string"), F.concat_ws(",", F.col("postings").cast("array<string>"))).alias("value"))
    return files.index_lines(lines).select("term", F.size("postings").cast("bigint").alias("df"), F.concat_ws(",", F.col("postings").cast("array<string>")).alias("postings"))


def index_tsv_file(spark: SparkSession, folder: str) -> DataFrame:
    """The index written to a file of lines and read from it."""
    path = runtime.folder(spark, "index-tsv")
    files.write_index(index.inverted_index(_postings(spark, folder)), path)
    return files.read_index(spark, path).select("term", F.concat_ws(",", F.col("postings").cast("array<string>")).alias("postings"))


def docs_tsv_file(spark: SparkSession, folder: str) -> DataFrame:
    path = runtime.folder(spark, "docs-tsv")
    files.write_docs(_read(spark, folder, "docs").where(F.col("doc_id").isNotNull() & F.col("url").isNotNull()).distinct(), path)
    return files.read_docs(spark, path)


def freq_csv_file(spark: SparkSession, folder: str) -> DataFrame:
    path = runtime.folder(spark, "freq-csv")
    files.write_freq(zipf.mandelbrot_curve(_ranked(spark, folder), None), path)
    return files.read_freq(spark, path).withColumn("zipf", F.round("zipf", 3))


def sitemap_walk(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses found from a sitemap index through one sitemap for each source; the index and sitemaps are written from the articles."""
    rows = _read(spark, folder, "articles").where(F.col("url").isNotNull() & F.col("source").isNotNull()).select("source", _escaped(F.col("url")).alias("u")).distinct()
    name = F.concat(F.lit("http://maps.example/"), F.md5("source"), F.lit(".xml"))
    listed = lambda root, item, urls: F.concat(F.lit(f'<?xml version="1.0"?><{root} xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.array_join(F.transform(F.array_sort(urls), lambda u: F.concat(F.lit(f"<{item}><loc>"), u, F.lit(f"</loc></{item}>"))), ""), F.lit(f"</{root}>"))
    maps = rows.groupBy("source").agg(listed("urlset", "url", F.collect_list("u")).alias("xml")).select(name.alias("url"), "xml")
    top = rows.select(name.alias("n")).distinct().agg(listed("sitemapindex", "sitemap", F.collect_list("n")).alias("xml")).select(F.lit("http://maps.example/sitemap-index.xml").alias("url"), "xml")
    return files.collect_sitemap_urls(top, maps, (r"/wiki/", r"/articles?/"))


def scrape_records(spark: SparkSession, folder: str) -> DataFrame:
    """Article records of all article addresses whose page was saved."""
    pages = keyed.latest(_read(spark, folder, "pages").where(F.col("url").isNotNull() & F.col("html").isNotNull()), ["url"], [F.coalesce("fetched_at", F.lit(0)), F.sha2("html", 256)])
    return corpus.scrape(pages, _read(spark, folder, "articles").where(F.col("url").isNotNull()), "2026-01-01T00:00:00Z")


def _queue_stream(spark: SparkSession, folder: str, table: str) -> DataFrame:
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{table}.parque[t]")  # as a pattern, a table may be a file or a folder of parts


def stream_new_addresses(spark: SparkSession, folder: str) -> DataFrame:
    """The queue as a stream: every normal form of an address once."""
    stream = _queue_stream(spark, folder, "queue").where(F.col("url").isNotNull()).select("url", F.timestamp_seconds(F.lit(NOW)).alias("seen_at"))
    return streams.drained(spark, streams.new_addresses(stream), "addresses").select("url")


def stream_upsert_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Fetched pages as a stream that is stored by address, micro-batch by micro-batch."""
    table = runtime.folder(spark, "page-versions")
    stream = _queue_stream(spark, folder, "pages").where(F.col("url").isNotNull() & F.col("hash").isNotNull()).select("url", F.col("html").cast("string").alias("html"), "source", "hash", "fetched_at")
    streams.upsert_stream(stream, table, f"{table}-state").awaitTermination()
    return streams.newest_version(spark, table).select("url", "hash")


def freq_scan(spark: SparkSession, folder: str) -> DataFrame:
    return files.freq_rows(files.filled_freq(_read(spark, folder, "freq")))


def report_stats_parse(spark: SparkSession, folder: str) -> DataFrame:
    """The statistics of the index written as lines and read again."""
    s = index.index_stats(_read(spark, folder, "documents")).select(F.col("docs").alias("Docs"), F.col("terms").alias("Terms"), F.col("tokens").alias("Tokens"), F.round("avg_token_len", 5).alias("AvgTokenLen"), F.round("input_kb", 5).alias("InputKB"), F.lit(2.5).alias("Elapsed"), F.round(F.col("input_kb") / 2.5, 4).alias("SpeedKBps"))
    return files.parse_stats(files.stats_lines(s))


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """A nested Boolean query over the index of all documents."""
    return boolean.search(_postings(spark, folder), _documents_ids(spark, folder), BOOLEAN["bool_nested"])


_QUERIES = (
    p5_found, tokenize_documents, doc_token_counts, term_frequency, term_frequency_unstemmed, inverted_index, inverted_index_chunks, docs_table, docs_lookup, index_stats, zipf_rank, mandelbrot_fit,
    mandelbrot_fit_free, mandelbrot_curve, html_terms, html_inverted_index, html_input_units, body_choice, indexable, scan_limit, search_page_top50, universe, query_lexer, query_postfix, ru_lower, ru_stem,
    extract_links, normalize_url, url_parts, url_allowed, is_article_url, url_patterns, url_decode, safe_filename, content_hash, change_detection, store_pages, queue_insert_if_absent, queue_reset,
    queue_claim, queue_dequeue, depth_gate, unique_urls, upsert_latest, upsert_merge, revisit_due, crawl_bfs, article_extract, meta_lookup, corpus_stats, collection_counts, sitemap_locs, rss_links,
    jsonl_roundtrip, index_tsv_roundtrip, index_tsv_file, docs_tsv_file, freq_csv_file, sitemap_walk, scrape_records, stream_new_addresses, stream_upsert_pages, freq_scan, report_stats_parse,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in _QUERIES} | {name: _boolean(q) for name, q in BOOLEAN.items()}


def oracle_sql() -> dict[str, str]:
    from korvane.plans import core_sql

    return core_sql.SQL
