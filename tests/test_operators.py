from __future__ import annotations

import gzip
import time
from datetime import datetime, timezone

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from korvane import runtime
from korvane.functions import urls as uf
from korvane.operators import boolean, corpus, crawl, index, keyed, timestamps, zipf
from korvane.sources import fetch, files
from korvane.streaming import crawl as streams


def utc(*fields: int) -> int:
    return int(datetime(*fields, tzinfo=timezone.utc).timestamp() * 1_000_000)


@pytest.mark.parametrize(
    ("value", "tz", "order", "expected"),
    [
        ("2024-03-01T10:00:00Z", "Europe/Moscow", "dmy", utc(2024, 3, 1, 10)),
        ("2024-03-01 10:00", "Europe/Moscow", "dmy", utc(2024, 3, 1, 7)),
        ("2024-03-01", "Europe/Moscow", "dmy", utc(2024, 2, 29, 21)),
        ("03/04/2024 10:00", "Europe/London", "dmy", utc(2024, 4, 3, 9)),
        ("03/04/2024 10:00", "America/New_York", "mdy", utc(2024, 3, 4, 15)),
        ("25/04/2024 10:00", "America/New_York", "mdy", None),
        ("2024-10-27 01:30", "Europe/London", "dmy", utc(2024, 10, 27, 0, 30)),  # occurs twice: the earlier
        ("2024-03-31 01:30", "Europe/London", "dmy", utc(2024, 3, 31, 1, 30)),  # skipped: offset before
        ("2024-07-01 10:00 BST", "Europe/London", "dmy", utc(2024, 7, 1, 9)),
        ("Sat Jan 13 19:13:16 UTC+0500 2024", None, "dmy", utc(2024, 1, 13, 14, 13, 16)),
        ("Aug 10, 2023 5:52 PM UTC+3", None, "dmy", utc(2023, 8, 10, 14, 52)),
        ("20 ноября 2024 г. в 01:50", "Asia/Tbilisi", "dmy", utc(2024, 11, 19, 21, 50)),
        ("13. Januar 2024, 02:34 Uhr", "Europe/Berlin", "dmy", utc(2024, 1, 13, 1, 34)),
        ("July 14, 2022 9:57 p.m.", "America/New_York", "mdy", utc(2022, 7, 15, 1, 57)),
        ("1677069979", None, "dmy", 1_677_069_979_000_000),
        ("1677069979627", None, "dmy", 1_677_069_979_627_000),
        ("2022-05-21T13:46:24.123456789Z", None, "dmy", utc(2022, 5, 21, 13, 46, 24) + 123_456),
        ("вчера, 14:05", "Europe/Moscow", "dmy", None),
        ("0000-00-00 00:00:00", None, "dmy", None),
        ("2023-02-30", None, "dmy", None),
        ("2024-03-01 25:00", None, "dmy", None),
        ("", None, "dmy", None),
        ("x" * 10_000, None, "dmy", None),
        (None, None, "dmy", None),
    ],
)
def test_instants(value: str | None, tz: str | None, order: str, expected: int | None) -> None:
    assert timestamps.parse_instant(value, tz, order) == expected


def test_instants_of_a_table(spark: SparkSession) -> None:
    places = spark.createDataFrame([("s", "Europe/Moscow", "dmy")], "source string, tz string, date_order string")
    rows = [(1, "s", "2024-03-01 10:00", None, "x"), (1, "s", "2024-03-01 10:00", None, "x"), (2, None, "2024-03-01 10:00", "soon", "y"), (3, "other", None, "", "z")]
    df = spark.createDataFrame(rows, "article_id bigint, source string, published_at string, fetched_at string, tz string")
    got = timestamps.normalize_instants(df, places, ("published_at", "fetched_at"))
    assert sorted(map(tuple, got.collect())) == [(1, "published_at", utc(2024, 3, 1, 7))] * 2 + [(2, "published_at", utc(2024, 3, 1, 10))]
    assert timestamps.normalize_instants(df.limit(0), places, ("published_at",)).count() == 0


@pytest.mark.parametrize(
    ("url", "normal"),
    [
        ("HTTP://Example.ORG", "http://example.org/"), ("https://a.b:443/x?q#f", "https://a.b/x?q#f"), ("http://a:80", "http://a/"), ("http://a:8080/", "http://a:8080/"), ("https://a:80/", "https://a:80/"),
        ("a.b/c", "http://a.b/c"), ("http://a/b/../c/./d", "http://a/c/d"), ("http://a/b/c/../../d/..", "http://a/"), ("", ""),
    ],
)
def test_normalize_url(spark: SparkSession, url: str, normal: str) -> None:
    got = spark.createDataFrame([(url,)], "u string").select(uf.normalize_url(F.col("u"))).first()[0]
    assert got == normal


def test_links(spark: SparkSession) -> None:
    page = """<a href="http://a/x"> <a HREF = 'https://b'> <a href=/rel> <a href="/rel"> <i data-href='http://c'>"""
    df = spark.createDataFrame([(page,), (None,)], "h string")
    assert [r[0] for r in df.select(uf.extract_links(F.col("h"))).collect()] == [["http://a/x", "https://b", "http://c"], None]
    assert df.select(uf.extract_links(F.col("h"), 1)).first()[0] == ["http://a/x"]


def test_names_and_filters(spark: SparkSession) -> None:
    df = spark.createDataFrame([("Архив/x y",), ("///",)], "v string").select(uf.safe_filename(F.col("v")), uf.wiki_url(F.col("v"), ""))
    rows = df.collect()
    assert rows[0][0] == "x_y" and len(rows[1][0]) == 16 and rows[0][1].endswith("/x_y")
    hosts = spark.createDataFrame([("http://a.example.org/x.PDF?y",), ("http://badexample.org/",), ("nonsense",)], "u string")
    assert [r[0] for r in hosts.select(uf.url_allowed(F.col("u"), ["example.org"], [".pdf"])).collect()] == [False, False, False]
    assert [r[0] for r in hosts.select(uf.url_allowed(F.col("u"), ["example.org"])).collect()] == [True, False, False]


def test_article_extraction(spark: SparkSession) -> None:
    page = """<html><head><meta content=" T " property="og:title"><meta name="author" content="A"></head><body><p>out</p>
    <article><h1>H</h1><p>one <b>two</b></p><h2>three</h2><div>no</div><p></p></article><p>after</p></body></html>"""
    assert corpus.extract_article(page) == ("T", "A", None, "one two\nthree")
    assert corpus.extract_article("<h1>H</h1><p>x") == ("H", None, None, "x")
    assert corpus.extract_article(None) == (None, None, None, "")
    df = spark.createDataFrame([("u", bytearray(page.encode())), ("v", bytearray("<p>да".encode("cp1251"))), ("w", None), ("x", bytearray(b"<div>"))], "url string, html binary")
    assert {r["url"]: r["text"] for r in corpus.extract_articles(df, ("url",)).collect()} == {"u": "one two\nthree", "v": "да"}


def test_keyed_writes(spark: SparkSession) -> None:
    table = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, v int, kept string")
    new = spark.createDataFrame([("b", 5), ("b", 6), ("c", 7)], "k string, v int")
    assert sorted(map(tuple, keyed.upsert(table, new, "k", [F.col("v")]).collect())) == [("a", 1, "x"), ("b", 6, "y"), ("c", 7, None)]
    assert sorted(r["v"] for r in keyed.insert_if_absent(table, new, "k", [F.col("v")]).collect()) == [1, 2, 7]
    assert keyed.upsert(table, new.limit(0), "k", [F.col("v")]).count() == 2


def test_store_pages(spark: SparkSession) -> None:
    pages = spark.createDataFrame([("a", "1", "s", 10, "h1", None), ("b", "2", "s", 10, "h2", None)], "url string, html string, source string, fetched_at bigint, hash string, last_checked bigint")
    got = spark.createDataFrame([("a", "1", "s", "h1"), ("b", "3", "s", "h3"), ("c", "4", "s", "h4")], "url string, html string, source string, hash string")
    rows = {r["url"]: (r["html"], r["fetched_at"], r["last_checked"]) for r in keyed.store_pages(pages, got, 99).collect()}
    assert rows == {"a": ("1", 10, 99), "b": ("3", 99, None), "c": ("4", 99, None)}


def test_revisits(spark: SparkSession) -> None:
    pages = spark.createDataFrame([("a", "s", 10, 50), ("b", "s", 90, None)], "url string, source string, fetched_at bigint, last_checked bigint")
    assert [r["url"] for r in keyed.revisit_due(pages, 100, 20).collect()] == ["a"]
    assert keyed.revisit_due(pages, 100, 0).count() == 0
    assert keyed.revisit_due(pages, 60, 20, by_check=True).count() == 0
    queue = spark.createDataFrame([], "url string, source string, depth int, status string, enqueued_at bigint, started_at bigint, revisit boolean")
    assert keyed.enqueue_revisits(queue, keyed.revisit_due(pages, 100, 20), 100).first()["depth"] == 0


def test_bfs_ends_on_a_cycle(spark: SparkSession) -> None:
    pages = spark.createDataFrame([("http://a/", '<a href="http://b/">'), ("http://b/", '<a href="http://a/"><a href="http://c/">'), ("http://c/", "")], "url string, html string")
    config = crawl.CrawlConfig(max_depth=9)
    got = crawl.bfs(pages.where("url = 'http://a/'").select("url"), crawl.saved_pages(pages), config)
    assert {r["url"]: r["depth"] for r in got.collect()} == {"http://a/": 0, "http://b/": 1, "http://c/": 2}


def test_zipf_of_nothing(spark: SparkSession) -> None:
    tf = spark.createDataFrame([], "term string, tf bigint")
    assert zipf.zipf_rank(tf).count() == 0


def test_fit_equals_direct_grid(spark: SparkSession) -> None:
    import math

    freqs = [max(1, round(1000 / (r + 2) ** 1.1)) for r in range(1, 200)]
    ranked = spark.createDataFrame([(r, f, 0.0) for r, f in enumerate(freqs, 1)], "rank bigint, freq bigint, zipf double")
    best = None
    for b in zipf.SHIFTS:
        l, y = [math.log(r + b) for r in range(1, 200)], [math.log(f) for f in freqs]
        n, sl, sll, sy, sly = len(l), sum(l), sum(x * x for x in l), sum(y), sum(p * q for p, q in zip(l, y))
        lc = (sy * sll - sl * sly) / (n * sll - sl * sl)
        for alpha in zipf.ALPHAS:
            error = sum((v - (lc - alpha * x)) ** 2 for x, v in zip(l, y))
            if best is None or error < best[0] - 1e-9:
                best = (error, alpha, b)
    got = zipf.mandelbrot_fit(ranked).first()
    assert (round(got["alpha"], 6), got["b"]) == (round(best[1], 6), best[2])
    assert len(zipf.ALPHAS) == 20 and len(zipf.SHIFTS) == 21
    free = zipf.mandelbrot_fit_free(ranked).first()
    assert free["error"] <= got["error"] + 1e-9


def test_dense_ids(spark: SparkSession) -> None:
    df = spark.createDataFrame([(f"u{i:03d}",) for i in range(50)] + [(None,), ("",)], "url string")
    assert sorted(map(tuple, index.docs_table(df).collect())) == [(i, f"u{i:03d}") for i in range(50)]


def test_files(spark: SparkSession, tmp_path) -> None:
    docs = spark.createDataFrame([(0, "и и дом"), (1, "дома x")], "doc_id bigint, text string")
    built = index.inverted_index(index.postings(docs))
    files.write_index(built, f"{tmp_path}/index")
    back = {r["term"]: r["postings"] for r in files.read_index(spark, f"{tmp_path}/index").collect()}
    assert back == {r["term"]: r["postings"] for r in built.collect()}
    urls = docs.select("doc_id", F.concat(F.lit("http://a/"), "doc_id").alias("url"))
    files.write_docs(urls, f"{tmp_path}/docs")
    assert sorted(map(tuple, files.read_docs(spark, f"{tmp_path}/docs").collect())) == [(0, "http://a/0"), (1, "http://a/1")]
    ranked = zipf.zipf_rank(index.term_frequency(docs))
    files.write_freq(zipf.mandelbrot_curve(ranked, None), f"{tmp_path}/freq")
    assert files.read_freq(spark, f"{tmp_path}/freq").count() == ranked.count()
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.HTML").write_text("<p>да</p>")
    assert files.read_raw_pages(spark, f"{tmp_path}/raw", "s").first()["text"] == "да"
    with pytest.raises(Exception, match="no Docs"):
        files.parse_stats(spark.createDataFrame([("x",)], "value string"), ("Docs",)).collect()


def test_index_lines_of_long_postings(spark: SparkSession) -> None:
    lines = spark.createDataFrame([("b\t2\t10,9",), ("b\t9\t,9,1,",), ("\t1\t7",), ("c\t0\t",), ("d\t1",), (None,)], "value string")
    assert sorted(map(tuple, files.index_lines(lines).collect())) == [("", [7]), ("b", [1, 9, 10])]

    def seconds(rows: int, ids: int) -> float:
        df = spark.range(0, rows, 1, 1).select(F.concat(F.lit("t\t0\t"), F.concat_ws(",", F.transform(F.sequence(F.col("id") * ids, F.col("id") * ids + ids - 1), lambda x: x.cast("string")))).alias("value"))
        began = time.monotonic()
        assert files.index_lines(df.localCheckpoint()).select(F.size("postings")).first()[0] == rows * ids
        return time.monotonic() - began

    seconds(60, 1000)
    assert seconds(1, 60_000) < 5 + 3 * seconds(60, 1000)  # the time follows the ids, not the ids times the length of their line


def test_index_roundtrip_of_terms_in_every_document(spark: SparkSession, tmp_path) -> None:
    from korvane.plans import core_queries

    n = 60_000
    spark.range(n).select(F.col("id").alias("doc_id"), F.lit("и мост").alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    took = {}
    for query in (core_queries.inverted_index, core_queries.inverted_index, core_queries.index_tsv_roundtrip):
        began = time.monotonic()
        rows = {r["term"]: (r["df"], r["postings"]) for r in query(spark, str(tmp_path)).select("term", "df", "postings").collect()}
        took[query] = time.monotonic() - began
        assert rows == {t: (n, ",".join(map(str, range(n)))) for t in ("", "мост")}
    assert took[core_queries.index_tsv_roundtrip] < 5 + 3 * took[core_queries.inverted_index]


def test_posting_lists(spark: SparkSession) -> None:
    tokens = ["ДОМАМИ", "Ѐтой", "ЂОЙ", "ЁЛКАМИ", "ѝѠа", "и", "Ями", "rock'n'roll-ОЙ", "A1", "KELVIN"]
    texts = [" ".join(tokens), "", None, "И у я", "\u212aelvin \u0130и x", "домами " * 50, "😀 им 😀ям"]
    rows = [(i, t) for i, t in enumerate(texts * 3)] + [(3, "дом и дом"), (3, "дом"), (None, "дом")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    by_rows = index.inverted_index(index.postings(df.where("doc_id IS NOT NULL"))).select("term", "df", "postings")
    for held in (1, 7, index.HELD_POSTINGS):
        assert sorted(map(tuple, index.posting_lists(df, held_postings=held).collect())) == sorted(map(tuple, by_rows.collect()))
    assert index.posting_lists(df.limit(0)).count() == 0


def test_index_roundtrip_sends_no_row_for_each_posting(spark: SparkSession, tmp_path) -> None:
    from korvane.plans import core_queries

    def shuffled() -> int:
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty(30_000)
        gateway = spark.sparkContext._gateway
        stages = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    n = 20_000
    spark.range(0, n, 1, 2).select(F.col("id").alias("doc_id"), F.lit("и мост").alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    before = shuffled()
    assert [r["df"] for r in core_queries.index_tsv_roundtrip(spark, str(tmp_path)).collect()] == [n, n]
    assert shuffled() - before < n / 100


def test_sitemaps(spark: SparkSession) -> None:
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    top = spark.createDataFrame([("i", f"<?xml version='1.0'?><sitemapindex {ns}><sitemap><loc> m1 </loc></sitemap><sitemap><loc>m2</loc></sitemap></sitemapindex>")], "url string, xml string")
    maps = spark.createDataFrame([("m2", f"<urlset {ns}><url><loc>http://b/wiki/2</loc></url></urlset>"), ("m1", f"<urlset {ns}><url><loc>http://a/wiki/1</loc></url><url><loc>http://a/no</loc></url></urlset>")], "url string, xml string")
    assert [r["url"] for r in files.collect_sitemap_urls(top, maps, ["/wiki/"]).collect()] == ["http://a/wiki/1", "http://b/wiki/2"]
    assert [r["url"] for r in files.collect_sitemap_urls(top, maps, ["/wiki/"], 1).collect()] == ["http://a/wiki/1"]
    packed = spark.createDataFrame([("p", bytearray(gzip.compress(b"<a/>"))), ("q", bytearray(b"<b/>")), ("r", None)], "path string, content binary")
    assert {r["path"]: r["xml"] for r in files.gunzip(packed).collect()} == {"p": "<a/>", "q": "<b/>", "r": None}


def test_settings() -> None:
    config = files.read_config("logic:\n  max_depth: 3\n  allow_domains: [a.b]\nsources:\n  - {name: s, urls: ['http://a.b/']}\n")
    assert config.max_depth == 3 and config.seeds == [("http://a.b/", "s")]
    assert files.read_env(["A=1", "# x", "", "bad", "B = c=d"]) == {"A": "1", "B": "c=d"}
    once = files.patch_block("text", "stats", "one")
    assert files.patch_block(once, "stats", "two").count("two") == 1 and "one" not in files.patch_block(once, "stats", "two")


def test_streams(spark: SparkSession, tmp_path) -> None:
    folder = f"{tmp_path}/in"
    spark.createDataFrame([("http://a", "h1")], "url string, hash string").coalesce(1).write.mode("append").parquet(folder)
    first = streams.drain(spark, folder, "url string, hash string", streams.changed_pages, f"changes-{tmp_path.name}")
    assert [r["change"] for r in first.collect()] == ["new"]
    spark.createDataFrame([("http://a", "h2"), ("http://b", "h1")], "url string, hash string").coalesce(1).write.mode("append").parquet(folder)
    second = streams.drain(spark, folder, "url string, hash string", streams.changed_pages, f"changes-{tmp_path.name}")
    assert sorted((r["url"], r["change"]) for r in second.collect()) == [("http://a", "changed"), ("http://a", "new"), ("http://b", "new")]


def test_upsert_stream(spark: SparkSession, tmp_path) -> None:
    folder, schema = f"{tmp_path}/in", "url string, html string, source string, hash string, fetched_at bigint"
    spark.createDataFrame([("a", "1", "s", "h1", 5)], schema).coalesce(1).write.parquet(folder)
    streams.upsert_stream(spark.readStream.schema(schema).parquet(folder), f"{tmp_path}/table", f"{tmp_path}/state").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/table/version=0").first()["fetched_at"] == 5


def test_streamed_tables_in_parts(spark: SparkSession, data: str, tmp_path) -> None:
    from korvane.plans import core_queries

    for table, query in (("pages", core_queries.stream_upsert_pages), ("queue", core_queries.stream_new_addresses)):
        spark.read.parquet(f"{data}/{table}.parquet").repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
        parts, whole = sorted(map(tuple, query(spark, str(tmp_path)).collect())), sorted(map(tuple, query(spark, data).collect()))
        assert parts == whole and whole
    assert streams.newest_version(spark, f"{tmp_path}/none").count() == 0  # a stream without a batch stored nothing


def test_shared_folder_and_bitmap(spark: SparkSession) -> None:
    df = spark.range(10)
    kept = runtime.written(df, "t")
    assert kept.count() == 10
    assert runtime.clean(spark) >= 1 and runtime.clean(spark) == 0
    with pytest.raises(Exception, match="(?i)not exist|FILE_NOT"):
        kept.count()
    keys = spark.range(100).select(F.xxhash64("id").alias("h"))
    bits = runtime.bitmap(keys, "h")
    import numpy as np

    assert runtime.in_bitmap(bits, np.array([r["h"] for r in keys.collect()], dtype=np.int64)).all()
    assert len(bits) * 8 == runtime.BITMAP


def test_crawl_in_steps(spark: SparkSession) -> None:
    site = {"http://a/": (200, b'<a href="http://a/x"><a href="http://a/p.pdf"><a href="http://b/">'), "http://a/x": (200, b'<a href="http://a/"><a href="http://a/y">'), "http://a/y": (500, b"")}
    asked: list[str] = []

    def opener(url: str, timeout_s: float) -> tuple[int, bytes, str]:
        asked.append(url)
        return (*site[url], url)

    config = crawl.CrawlConfig(allowed_domains=("a",), denied_extensions=(".pdf",), max_depth=1, seeds=[("HTTP://A", "s")])
    queue = spark.createDataFrame([], "url string, source string, depth int, status string, enqueued_at bigint, started_at bigint, revisit boolean")
    pages = spark.createDataFrame([], "url string, html string, source string, fetched_at bigint, hash string, last_checked bigint")
    queue = crawl.seed_queue(queue, config, 1)
    get = fetch.http_fetcher(opener, pause_s=0.0)
    queue, pages = crawl.step(queue, pages, get, config, 2)
    assert [(r["url"], r["depth"], r["source"]) for r in queue.collect()] == [("http://a/x", 1, "s")]
    queue, pages = crawl.step(queue, pages, get, config, 3)
    assert queue.count() == 0 and {r["url"]: r["fetched_at"] for r in pages.collect()} == {"http://a/": 2, "http://a/x": 3}
    again = crawl.CrawlConfig(allowed_domains=("a",), max_depth=0, revisit_seconds=1)
    queue, pages = crawl.step(queue, pages, get, again, 10)
    assert queue.count() == 0 and {r["url"]: (r["fetched_at"], r["last_checked"]) for r in pages.collect()} == {"http://a/": (2, 10), "http://a/x": (3, 10)}


def test_retries() -> None:
    calls: list[str] = []

    def failing(url: str, timeout_s: float) -> tuple[int, bytes, str]:
        calls.append(url)
        if len(calls) < 3:
            raise OSError("down")
        return 200, b"ok", url

    assert fetch.with_retries(failing, "u", 1.0, 3, 0.0)[1] == b"ok" and len(calls) == 3
    calls.clear()
    with pytest.raises(OSError, match="down"):
        fetch.with_retries(failing, "u", 1.0, 2, 0.0)


def test_paginated_lists(spark: SparkSession) -> None:
    answers = {None: '{"query": {"allpages": [{"title": "А б"}]}, "continue": {"apcontinue": "x"}}', "x": '{"query": {"allpages": [{"title": "C"}]}}'}
    rows = files.wiki_titles(fetch.paginated(spark, answers.__getitem__)).collect()
    assert [r["title"] for r in rows] == ["А б", "C"] and rows[0]["url"].endswith("/wiki/%D0%90_%D0%B1") and rows[0]["next"] == "x"
    assert fetch.paginated(spark, answers.__getitem__, 1).count() == 1


CONFIG = """
db:
  uri: "mongodb://x"
logic:
  delay_ms: 1000
  revisit_seconds: 86400
  revisit_scan_seconds: 300
  user_agent: "crawler/1.0"
  request_timeout_seconds: 20
  follow_links: true
  max_depth: 2
  max_links_per_page: 50
  articles_only: 1
  allow_domains:
    - "ru.wikipedia.org"
    - "habr.com"
  deny_exts:
    - ".jpg"
    - ".js"
sources:
  - name: "wikipedia"
    urls:
      - "https://ru.wikipedia.org/wiki/"
  - name: "habr"
    urls:
      - "https://habr.com/ru/articles/"
"""


def test_config_as_it_is_written() -> None:
    c = files.read_config(CONFIG)
    assert c.allowed_domains == ("ru.wikipedia.org", "habr.com") and c.denied_extensions == (".jpg", ".js")
    assert c.seeds == [("https://ru.wikipedia.org/wiki/", "wikipedia"), ("https://habr.com/ru/articles/", "habr")]
    assert (c.delay_ms, c.revisit_seconds, c.revisit_scan_seconds, c.user_agent, c.timeout_s) == (1000, 86400, 300, "crawler/1.0", 20)
    assert (c.follow_links, c.max_depth, c.max_links_per_page, c.articles_only) == (True, 2, 50, True)
    for wrong in ("logic:\n  allowed_domains: [a.b]\n", "sources:\n  - {name: s, seed: 'http://a/'}\n", "logik: {}\n"):
        with pytest.raises(ValueError):
            files.read_config(wrong)
    assert files.read_config("") == crawl.CrawlConfig(seeds=[])


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<h1>foo <b>bar</b></h1><p>x <i>y</i></p>", ("foobar", None, None, "x y")),
        ("<meta name='author' content=''><meta name='author' content='late'><meta property='author' content='P'><p>t</p>", (None, "P", None, "t")),
        ("<meta name='og:title' content=' '><h1>H</h1><p>t</p>", ("H", None, None, "t")),
        ("<meta name='date' content=' 2020 '><main><p>in</p></main><p>out</p>", (None, None, "2020", "in")),
        ("<h1></h1><div id='mw-content-text'><h2>a</h2></div><article><p>b</p></article>", ("", None, None, "a")),
    ],
)
def test_extracted_article(page: str, want: tuple) -> None:
    assert corpus.extract_article(page)[1:] == want[1:] and (corpus.extract_article(page)[0] or "") == (want[0] or "")


def test_request_gate() -> None:
    assert boolean.query_of_request("GET", "/?q=a+b&x=1") == "a b&x=1" and boolean.query_of_request("GET", "/?x=1?q=a") == ""
    assert boolean.query_of_request("GET", "/?x=1&q=a") == "" and boolean.query_of_request("POST", "/?q=a") is None


def test_page_of_no_hits_has_its_total(spark: SparkSession) -> None:
    rows = spark.createDataFrame([("a", 1, 1), ("b", 2, 1)], "term string, doc_id bigint, tf bigint")
    docs = spark.createDataFrame([(1,), (2,)], "doc_id bigint")
    assert [tuple(r) for r in boolean.search_page(rows, docs, "nothing").collect()] == [(None, 0)]
    assert [tuple(r) for r in boolean.search_page(rows, docs, "a or b", 1).collect()] == [(1, 2)]


def test_dot_segments_of_any_number(spark: SparkSession) -> None:
    deep = "http://h/" + "a/" * 30 + "../" * 30 + "z"
    want = {deep: "http://h/z", "http://h/a/./b/../c": "http://h/a/c", "http://h/a/b/..": "http://h/a/", "http://h/../..": "http://h/", "http://h/a/.": "http://h/a/", "http://h/.a/..b": "http://h/.a/..b"}
    df = spark.createDataFrame([(u,) for u in want], "url string")
    assert {r[0]: r[1] for r in df.select("url", uf.normalize_url(F.col("url"))).collect()} == want


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("2024-01-02T03:04:05.1234567890123Z", 1_704_164_645_123_456), ("-1000000000", -1_000_000_000_000_000), ("1700000000", 1_700_000_000_000_000), ("1700000000123", 1_700_000_000_123_000),
        ("99999999999", 99_999_999_999_000), ("2024-01-02" + " " * 90 + "03:04 UTC", 1_704_164_640_000_000), ("12345", None),
    ],
)
def test_instants_without_limits(value: str, want: int | None) -> None:
    assert timestamps.parse_instant(value, "UTC") == want


def test_sitemap_under_its_other_name() -> None:
    asked = []

    def opener(url: str, timeout: float) -> tuple[int, bytes, str]:
        asked.append(url)
        return (200, gzip.compress(b"<urlset/>") if url.endswith(".gz") else b"<x/>", url) if "index" not in url else (404, b"", url)

    assert fetch.fetch_sitemap("http://h/sitemap-index.xml", opener, 1) == "<x/>" and asked == ["http://h/sitemap-index.xml", "http://h/sitemap.xml"]
    assert fetch.fetch_sitemap("http://h/a.xml.gz", opener, 1) == "<urlset/>"
    with pytest.raises(OSError):
        fetch.fetch_sitemap("http://h/index/other.xml", opener, 1)


def test_crawl_runs_in_rounds_and_scans_for_revisits(spark: SparkSession) -> None:
    pages = spark.createDataFrame([], "url string, html string, source string, fetched_at bigint, hash string, last_checked bigint")
    queue = spark.createDataFrame([], "url string, source string, depth int, status string, enqueued_at bigint, started_at bigint, revisit boolean")
    site = spark.createDataFrame([("http://a/", '<a href="http://a/b">'), ("http://a/b", "end")], "url string, html string")
    config = crawl.CrawlConfig(max_depth=1, seeds=[("http://a/", "s")], revisit_seconds=50, revisit_scan_seconds=100, delay_ms=5)
    times, paused = iter([1000, 1000, 1060, 1100, 1110]), []
    left, stored = crawl.run(queue, pages, crawl.saved_pages(site), config, 2, lambda: next(times), paused.append)
    assert left.count() == 0 and {r["url"] for r in stored.collect()} == {"http://a/", "http://a/b"} and paused == [0.005, 0.005]
    left, again = crawl.run(left, stored, crawl.saved_pages(site), config, 1, lambda: next(times), paused.append)  # 1110: due since 1060
    assert {r["last_checked"] for r in again.collect()} == {1110}


def test_time_and_speed_by_size(spark: SparkSession) -> None:
    rows = spark.createDataFrame([(20.0, 4.0), (10.0, 0.0), (5.0, 1.0)], "InputKB double, Elapsed double")
    assert [tuple(r) for r in files.performance(rows).collect()] == [(5.0, 1.0, 5.0), (10.0, 0.0, None), (20.0, 4.0, 5.0)]
