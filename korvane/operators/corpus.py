"""Collection of a corpus: article extraction, records, statistics, loading."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korvane.functions import text as tx
from korvane.operators import keyed

# Names of meta tags in order of trial, and containers of an article in order of trial.
TITLE_METAS, AUTHOR_METAS, DATE_METAS = ("og:title", "twitter:title"), ("author", "article:author"), ("article:published_time", "date", "article:published")
CONTAINERS = (("id", "mw-content-text"), ("tag", "article"), ("tag", "main"))
ARTICLE_SCHEMA = "source string, url string, title string, author string, published_at string, text string, raw_path string, fetched_at string"


def meta_value(page: Column, names: Sequence[str]) -> Column:
    """Stripped content of the first meta tag with one of the names (as name, then as property), null where none has any.

    For tags whose name stands before their content; `extract_articles` reads any order.
    """
    found = []
    for name in names:
        for attribute in ("name", "property"):
            pattern = rf"""(?is)<meta\s[^>]*?{attribute}\s*=\s*["']{re.escape(name)}["'][^>]*?content\s*=\s*["']([^"']*)["']"""
            found.append(F.nullif(F.trim(F.regexp_extract(page, pattern, 1)), F.lit("")))
    return F.coalesce(*found)


class _Article(HTMLParser):
    """One pass over a page: meta tags, first heading, and the texts of p, h2 and h3 with the containers that hold them."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.metas: dict[tuple[str, str], str] = {}
        self.open: list[tuple[str, frozenset[int], int | None]] = []
        self.blocks: list[tuple[frozenset[int], list[str]]] = []
        self.heading: list[str] | None = None
        self.in_heading = False
        self.seen: set[int] = set()
        self.skipped = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        own = {k: v or "" for k, v in attrs}
        if tag == "meta":
            for attribute in ("name", "property"):
                if own.get(attribute):
                    self.metas.setdefault((attribute, own[attribute]), own.get("content", ""))
        if tag in self.VOID:
            return
        if tag in ("script", "style"):
            self.skipped += 1
        held = self.open[-1][1] if self.open else frozenset()
        for i, (kind, name) in enumerate(CONTAINERS):
            # Only the first element of a kind is the container.
            if (own.get("id") if kind == "id" else tag) == name and i not in self.seen:
                self.seen.add(i)
                held |= {i}
        block = None
        if tag in ("p", "h2", "h3"):
            block = len(self.blocks)
            self.blocks.append((held, []))
        if tag == "h1" and self.heading is None:
            self.heading, self.in_heading = [], True
        self.open.append((tag, held, block))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                for closed, _, _ in self.open[i:]:
                    self.in_heading &= closed != "h1"
                    self.skipped -= closed in ("script", "style")
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        if not (piece := data.strip()) or self.skipped:
            return
        if self.in_heading and self.heading is not None:
            self.heading.append(piece)
        for _, _, block in self.open:  # text of nested blocks belongs to each of them
            if block is not None:
                self.blocks[block][1].append(piece)

    def first_meta(self, names: Sequence[str]) -> str | None:
        for name in names:
            for attribute in ("name", "property"):
                if value := self.metas.get((attribute, name)):  # only the first tag of a name counts, and then the next attribute
                    return value.strip()
        return None

    def text(self) -> str:
        best = next((i for i in range(len(CONTAINERS)) if i in self.seen), None)
        return "\n".join(line for held, parts in self.blocks if (best is None or best in held) and (line := " ".join(parts)))


def extract_article(page: str | None) -> tuple[str | None, str | None, str | None, str]:
    """(title, author, published_at, text) of a page."""
    a = _Article()
    a.feed(page or "")
    a.close()
    return a.first_meta(TITLE_METAS) or ("".join(a.heading) if a.heading is not None else None), a.first_meta(AUTHOR_METAS), a.first_meta(DATE_METAS), a.text()


def extract_articles(pages: DataFrame, carry: Sequence[str] = ("url", "source"), page: str = "html") -> DataFrame:
    """Carried columns with title, author, published_at and text of each page; pages without text are dropped.

    Bytes are read as UTF-8, or as windows-1251 where they are none. Repeated pages give repeated rows.
    """
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for data in b["_k_page"]:
                if isinstance(data, (bytes, bytearray)):
                    try:
                        data = bytes(data).decode("utf-8")
                    except UnicodeDecodeError:
                        data = bytes(data).decode("windows-1251", "replace")
                found.append(extract_article(data))
            out = pd.concat([b.drop(columns="_k_page").reset_index(drop=True), pd.DataFrame(found, columns=["title", "author", "published_at", "text"])], axis=1)
            yield out[out["text"] != ""]

    fields = ", ".join(f"`{c}` {kinds[c]}" for c in carry)
    return pages.where(F.octet_length(page) > 0).select(*carry, F.col(page).alias("_k_page")).mapInPandas(run, f"{fields}, title string, author string, published_at string, text string")


def scrape(pages: DataFrame, urls: DataFrame, fetched_at: str, raw_dir: str = "raw") -> DataFrame:
    """Article records of the urls whose page is among the saved ones: fetch by key, extract, name the saved file."""
    from korvane.functions import urls as uf

    got = pages.join(urls.select("url").distinct(), "url", "left_semi")
    raw = F.concat(F.lit(raw_dir + "/"), F.coalesce("source", F.lit("")), F.lit("/"), uf.safe_filename(F.col("url")), F.lit(".html"))
    return extract_articles(got).select("source", "url", "title", "author", "published_at", "text", raw.alias("raw_path"), F.lit(fetched_at).alias("fetched_at"))


def corpus_stats(articles: DataFrame, pages: DataFrame, text: str = "text", page: str = "html") -> DataFrame:
    """One row: documents, raw_total_bytes, text_total_bytes, avg_raw_bytes, avg_text_bytes. Averages are over documents, 0 without any."""
    own = articles.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("text_total_bytes")).withColumn("_one", F.lit(1))
    raw = pages.agg(F.coalesce(F.sum(F.octet_length(page)), F.lit(0)).alias("raw_total_bytes")).withColumn("_one", F.lit(1))
    mean = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("documents")), F.lit(0.0))
    return own.join(raw, "_one").select("documents", "raw_total_bytes", "text_total_bytes", mean("raw_total_bytes").alias("avg_raw_bytes"), mean("text_total_bytes").alias("avg_text_bytes"))


def load_records(table: DataFrame | None, records: DataFrame, order: list[Column]) -> DataFrame:
    """Records upserted by url, else by text; records with neither are skipped; the last in the order wins."""
    keyed_rows = records.withColumn("_key", keyed.record_key(F.col("url"), F.col("text"))).where(F.col("_key").isNotNull())
    last = keyed.latest(keyed_rows, ["_key"], order)
    if table is not None:
        old = table.withColumn("_key", keyed.record_key(F.col("url"), F.col("text")))
        last = old.join(last.select("_key"), "_key", "left_anti").unionByName(last, allowMissingColumns=True)
    return last.drop("_key")


def transfer_pages(pages: DataFrame, fetched_at: str) -> DataFrame:
    """Crawled pages as article records; of several crawls of a url the newest."""
    last = keyed.latest(pages.where(F.col("url").isNotNull()), ["url"], [F.col("fetched_at"), F.col("hash")])
    return extract_articles(last).withColumn("fetched_at", F.lit(fetched_at))


def plain_page(page: Column) -> Column:
    """A page's characters without tags."""
    return tx.html_strip(tx.page_text(page))
