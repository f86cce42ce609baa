"""Crawl in batches: one level of the frontier at a time over saved or fetched pages."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korvane import runtime
from korvane.functions import urls as uf
from korvane.operators import keyed

#: (frontier with url) -> (url, status, body, final_url): what was fetched.
Fetcher = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class CrawlConfig:
    """What a crawl follows and stores."""

    allowed_domains: Sequence[str] = ()
    denied_extensions: Sequence[str] = ()
    articles_only: bool = False
    follow_links: bool = True
    max_depth: int = 2
    max_links_per_page: int = 200
    batch: int | None = None
    revisit_seconds: int = 0
    revisit_scan_seconds: int = 0
    delay_ms: int = 0
    timeout_s: float = 20.0
    user_agent: str = "korvane"
    seeds: Sequence[tuple[str, str]] = field(default_factory=tuple)


def saved_pages(pages: DataFrame) -> Fetcher:
    """A fetcher that looks addresses up among saved pages (url, html)."""

    def fetch(frontier: DataFrame) -> DataFrame:
        body = F.col("html").cast("string") if dict(pages.dtypes)["html"] == "string" else F.decode("html", "UTF-8")
        got = pages.where(F.col("html").isNotNull()).groupBy("url").agg(F.max_by("html", F.col("html")).alias("html")).select(F.col("url").alias("p_url"), body.alias("body"))
        return frontier.join(got, F.col("url") == F.col("p_url"), "left").select("url", F.when(F.col("p_url").isNotNull(), 200).otherwise(404).alias("status"), "body", F.col("url").alias("final_url"))

    return fetch


def links(pages: DataFrame, config: CrawlConfig, url: str = "url", body: str = "body") -> DataFrame:
    """(from_url, url): normal forms of the allowed links of each page. The cap on links comes first, the filter looks at the link as
    written."""
    raw = pages.select(F.col(url).alias("from_url"), F.explode(uf.extract_links(F.col(body), config.max_links_per_page)).alias("link"))
    return raw.where(uf.url_allowed(F.col("link"), config.allowed_domains, config.denied_extensions)).select("from_url", uf.normalize_url(F.col("link")).alias("url"))


def bfs(seeds: DataFrame, fetch: Fetcher, config: CrawlConfig) -> DataFrame:
    """(url, depth): every address that is reached, with its least depth, up to max_depth.

    seeds: (url). A level is one join; visited addresses never come back, so cycles end. Each level is written to the shared folder.
    """
    frontier = seeds.where(uf.url_allowed(F.col("url"), config.allowed_domains, config.denied_extensions)).select(uf.normalize_url(F.col("url")).alias("url")).distinct().withColumn("depth", F.lit(0))
    visited = runtime.written(frontier, "visited")
    level = visited
    for depth in range(config.max_depth if config.follow_links else 0):
        got = fetch(level.select("url")).where((F.col("status") >= 200) & (F.col("status") < 400))
        found = links(got, config).select("url").distinct()
        level = runtime.written(found.join(visited.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth + 1)), "level")
        if level.isEmpty():
            break
        visited = visited.unionByName(level)
    return visited


def fetched_pages(frontier: DataFrame, fetch: Fetcher, config: CrawlConfig) -> DataFrame:
    """(url, source, html, hash) of what a frontier (url, source) brings: allowed before the fetch, fetched with success, stored under
    the normal form of the final address."""
    ready = frontier.where(uf.url_allowed(F.col("url"), config.allowed_domains, config.denied_extensions))
    got = fetch(ready.select("url")).where((F.col("status") >= 200) & (F.col("status") < 400))
    name = uf.normalize_url(F.col("final_url"))
    return got.join(ready.select("url", "source"), "url").where(uf.url_store_allowed(name, config.articles_only)).select(name.alias("url"), "source", F.col("body").alias("html"), uf.content_hash(F.col("body")).alias("hash"))


def seed_queue(queue: DataFrame, config: CrawlConfig, now: int) -> DataFrame:
    """The queue with the seeds as pending at depth 0, if it is empty; a seed is judged as written and stored in its normal form."""
    if not config.seeds or not queue.isEmpty():
        return queue
    rows = queue.sparkSession.createDataFrame(list(config.seeds), "url string, source string").where(uf.url_allowed(F.col("url"), config.allowed_domains, config.denied_extensions))
    return keyed.insert_if_absent(queue, _pending(rows.select(uf.normalize_url(F.col("url")).alias("url"), "source", F.lit(0).alias("depth")), now), "url", [F.col("source")])


def _pending(rows: DataFrame, now: int) -> DataFrame:
    return rows.select("url", "source", "depth", F.lit("pending").alias("status"), F.lit(now).cast("bigint").alias("enqueued_at"), F.lit(None).cast("bigint").alias("started_at"), F.lit(None).cast("boolean").alias("revisit"))


def step(queue: DataFrame, pages: DataFrame, fetch: Fetcher, config: CrawlConfig, now: int) -> tuple[DataFrame, DataFrame]:
    """One round of a crawl that can stop and go on: due pages come back at depth 0, a batch is claimed, fetched and stored, its links wait one
    level deeper, and what was claimed leaves the queue whether it came or not. Both tables are written to the shared folder.
    """
    ready = keyed.reset_processing(queue)
    if config.revisit_seconds > 0:
        ready = keyed.enqueue_revisits(ready, keyed.revisit_due(pages, now, config.revisit_seconds), now)
    ready = runtime.written(ready, "queue")
    claimed = runtime.written(keyed.claim(ready, config.batch) if config.batch else ready.where(F.col("status") == "pending"), "claimed")
    allowed = claimed.where(uf.url_allowed(F.col("url"), config.allowed_domains, config.denied_extensions))
    answers = fetch(allowed.select("url").distinct()).where((F.col("status") >= 200) & (F.col("status") < 400) & F.col("body").isNotNull())
    got = runtime.written(answers.join(keyed.latest(allowed.select("url", "source", "depth"), ["url"], [-F.col("depth")]), "url"), "answers")
    name = uf.normalize_url(F.col("final_url"))
    fetched = got.where(uf.url_store_allowed(name, config.articles_only)).select(name.alias("url"), F.col("body").alias("html"), "source", uf.content_hash(F.col("body")).alias("hash"))
    stored = runtime.written(keyed.store_pages(pages, fetched, now), "pages")
    rest = keyed.dequeue(ready, claimed)
    if config.follow_links:
        deeper = got.where(F.col("depth") < config.max_depth)
        found = links(deeper, config).join(deeper.select(F.col("url").alias("from_url"), "source", "depth"), "from_url").select("url", "source", (F.col("depth") + 1).alias("depth"))
        rest = keyed.insert_if_absent(rest, _pending(found, now), "url", [F.col("depth"), F.col("source")])
    return runtime.written(rest, "queue"), stored


def run(queue: DataFrame, pages: DataFrame, fetch: Fetcher, config: CrawlConfig, rounds: int, clock: Callable[[], float] = time.time, pause: Callable[[float], None] = time.sleep) -> tuple[DataFrame, DataFrame]:
    """`step` so many times, with seeds first if the queue is empty; due pages are looked for every revisit_scan_seconds (in no round if that is
    0), and delay_ms pass between rounds. The tables of a round are deleted once the next one has written its own.
    """
    spark, scanned = queue.sparkSession, None
    queue = seed_queue(queue, config, int(clock()))
    start = runtime.mark()
    for _ in range(rounds):
        now, before = int(clock()), runtime.mark()
        scan = config.revisit_scan_seconds > 0 and (scanned is None or now - scanned >= config.revisit_scan_seconds)
        scanned = now if scan else scanned
        queue, pages = step(queue, pages, fetch, config if scan else replace(config, revisit_seconds=0), now)
        runtime.clean(spark, start, before)
        if config.delay_ms:
            pause(config.delay_ms / 1000)
    return queue, pages
