"""Readers and writers of records, index files, frequency tables, statistics and configuration."""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from korvane.functions import urls as uf
from korvane.operators.corpus import ARTICLE_SCHEMA, extract_articles
from korvane.operators.crawl import CrawlConfig

# Keys of a statistics file.
#: And of a crawl's configuration, with the names that they have here.
CONFIG_KEYS = {
    "delay_ms": "delay_ms", "revisit_seconds": "revisit_seconds", "revisit_scan_seconds": "revisit_scan_seconds", "user_agent": "user_agent", "request_timeout_seconds": "timeout_s",
    "follow_links": "follow_links", "max_depth": "max_depth", "max_links_per_page": "max_links_per_page", "articles_only": "articles_only", "allow_domains": "allowed_domains", "deny_exts": "denied_extensions",
}
STATS_KEYS = ("Docs", "Terms", "Tokens", "AvgTokenLen", "InputKB", "Elapsed", "SpeedKBps")


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object a line in UTF-8, nulls written."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str = ARTICLE_SCHEMA) -> DataFrame:
    """Records of a file or of a folder's *.jsonl and *.json files; blank lines are skipped."""
    return spark.read.schema(schema).option("pathGlobFilter", "*.json*").json(path)


def read_texts(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, text): whole files; folders are walked."""
    return spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text([paths] if isinstance(paths, str) else list(paths)).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_file_list(spark: SparkSession, path: str) -> DataFrame:
    """Whole files that a list names, one path a line; blanks are skipped, a missing file is an error."""
    names = [r["value"].strip() for r in spark.read.text(path).collect()]
    return read_texts(spark, [n for n in names if n])


def read_raw_pages(spark: SparkSession, folder: str, source: str) -> DataFrame:
    """Article records of a folder of saved *.html pages, those without text dropped."""
    pages = spark.read.format("binaryFile").option("pathGlobFilter", "*.[hH][tT][mM][lL]").option("recursiveFileLookup", "true").load(folder)
    rows = pages.select(F.lit(source).alias("source"), F.lit(None).cast("string").alias("url"), F.col("path").alias("raw_path"), F.col("content").alias("html"))
    return extract_articles(rows, ("source", "url", "raw_path"))


def write_docs(df: DataFrame, path: str) -> None:
    df.select("doc_id", "url").write.mode("overwrite").option("sep", "\t").option("quote", "").option("escape", "").csv(path)


def read_docs(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, url) of lines with a tab."""
    cut = F.split("value", "\t", 2)
    return spark.read.text(path).where(F.contains("value", F.lit("\t"))).select(F.try_to_number(cut[0], F.lit("999999999999999999")).cast("bigint").alias("doc_id"), F.regexp_replace(cut[1], r"[\r\n]+$", "").alias("url"))


def write_index(index: DataFrame, path: str) -> None:
    """Lines of term, df and joined postings, by falling tf and then term; an empty term is an empty field."""
    lines = index.orderBy(F.desc("tf"), "term").select(F.concat_ws("\t", "term", F.col("df").cast("string"), F.concat_ws(",", F.col("postings").cast("array<string>"))).alias("value"))
    lines.write.mode("overwrite").text(path)


def index_lines(lines: DataFrame) -> DataFrame:
    """(term, postings) of lines of an index file; the stated df is not used, lines of one term are joined."""
    # Exploded from an array of one, a line is made and cut once; a filter on the cut alone would be moved to before it and do both again.
    cut = lines.select(F.explode(F.array(F.split("value", "\t", 3))).alias("cut")).where(F.size("cut") >= 3)
    rows = cut.select(F.col("cut")[0].alias("term"), F.col("cut")[2].alias("ids")).where(F.col("ids").rlike("[^,]"))
    # A line is never taken apart into rows: its term would be cut from the whole line again for each of its ids.
    joined = rows.groupBy("term").agg(F.concat_ws(",", F.collect_list("ids")).alias("ids"))
    ids = F.array_remove(F.split("ids", ","), "").cast("array<bigint>")
    return joined.select("term", F.sort_array(F.array_distinct(ids)).alias("postings"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return index_lines(spark.read.text(path))


def freq_rows(df: DataFrame) -> DataFrame:
    """A frequency table with its numbers as text of six digits."""
    six = [F.format_string("%.6f", F.col(c)).alias(c) for c in df.columns if c in ("zipf", "mandelbrot")]
    return df.select("rank", "freq", *six)


def write_freq(df: DataFrame, path: str) -> None:
    """In order of rank over the parts, each part a range."""
    freq_rows(df).orderBy("rank").write.mode("overwrite").option("header", "true").csv(path)


def read_freq(spark: SparkSession, path: str) -> DataFrame:
    """(rank, freq, zipf, mandelbrot); missing values are 0."""
    rows = spark.read.option("header", "true").schema("rank bigint, freq bigint, zipf double, mandelbrot double").option("enforceSchema", "false").csv(path)
    return filled_freq(rows)


def filled_freq(rows: DataFrame) -> DataFrame:
    return rows.select("rank", F.coalesce("freq", F.lit(0)).alias("freq"), F.coalesce("zipf", F.lit(0.0)).alias("zipf"), F.coalesce("mandelbrot", F.lit(0.0)).alias("mandelbrot"))


def performance(stats: DataFrame) -> DataFrame:
    """(InputKB, Elapsed, SpeedKBps): time and speed against the size of the collection, a row for each run, smallest first; speed is
    worked out where a run does not state it."""
    speed = F.coalesce(F.col("SpeedKBps"), F.try_divide(F.col("InputKB"), F.col("Elapsed"))) if "SpeedKBps" in stats.columns else F.try_divide(F.col("InputKB"), F.col("Elapsed"))
    return stats.select("InputKB", "Elapsed", speed.alias("SpeedKBps")).orderBy("InputKB", "Elapsed")


def stats_lines(stats: DataFrame) -> DataFrame:
    """(value): `Key: number` lines of a one-row frame with columns named like the keys."""
    return stats.select(F.explode(F.array(*(F.concat(F.lit(f"{k}: "), F.col(k).cast("string")) for k in STATS_KEYS if k in stats.columns))).alias("value"))


def parse_stats(lines: DataFrame, keys: Sequence[str] = STATS_KEYS) -> DataFrame:
    """One row with a double for each key of `Key: number` lines (value); a missing key is an error."""
    one = lines.agg(*(F.max(F.nullif(F.regexp_extract("value", rf"^{k}:\s*([0-9.]+)", 1), F.lit(""))).alias(k) for k in keys))
    return one.select(*(F.coalesce(F.col(k).cast("double"), F.raise_error(F.lit(f"no {k} in the statistics")).cast("double")).alias(k) for k in keys))


def sitemap_locations(documents: DataFrame, key: str = "url", xml: str = "xml") -> DataFrame:
    """(key, root, pos, loc): stripped, non-empty loc texts of sitemaps and sitemap indexes in document order."""
    locs = F.filter(F.transform(F.xpath(F.col(xml), F.lit('//*[local-name()="loc"]/text()')), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != "")
    root = F.regexp_extract(xml, r"(?s)^(?:\s|<\?.*?\?>|<!.*?>)*<(?:[\w.-]+:)?([\w.-]+)", 1)
    return documents.select(F.col(key).alias(key), root.alias("root"), F.posexplode(locs).alias("pos", "loc"))


def collect_sitemap_urls(index: DataFrame, sitemaps: DataFrame, patterns: Sequence[str], max_sitemaps: int = 0, max_items: int = 0) -> DataFrame:
    """(url): addresses that match a pattern, in order of sitemap and place. index and sitemaps: (url, xml); 0 means no limit."""
    own = sitemap_locations(index)
    children = own.where(F.col("root") == "sitemapindex").select(F.col("pos").alias("map_pos"), F.col("loc").alias("map_url"))
    if max_sitemaps > 0:
        children = children.where(F.col("map_pos") < max_sitemaps)
    alone = own.where(F.col("root") != "sitemapindex").select(F.lit(0).alias("map_pos"), "pos", "loc")  # what is no index is its own sitemap
    listed = sitemap_locations(sitemaps).withColumnRenamed("url", "map_url").join(children, "map_url").select("map_pos", "pos", "loc")
    found = listed.unionByName(alone).where(uf.matches_any(F.col("loc"), patterns)).orderBy("map_pos", "pos")
    return (found.limit(max_items) if max_items > 0 else found).select(F.col("loc").alias("url"))


def rss_links(feeds: DataFrame, key: str = "url", xml: str = "xml", max_items: int = 0) -> DataFrame:
    """(key, pos, link): link texts of a feed's items in order."""
    found = F.xpath(F.col(xml), F.lit('//*[local-name()="item"]/*[local-name()="link"]/text()'))
    rows = feeds.select(F.col(key).alias(key), F.posexplode(F.slice(found, 1, max_items) if max_items > 0 else found).alias("pos", "link"))
    return rows.select(key, "pos", F.trim("link").alias("link"))


def wiki_titles(responses: DataFrame, json: str = "json") -> DataFrame:
    """(title, url, next): page titles of list responses, and the token that asks for what follows."""
    parsed = responses.select(F.from_json(json, "query struct<allpages: array<struct<title: string>>>, `continue` struct<apcontinue: string>").alias("r"))
    rows = parsed.select(F.explode("r.query.allpages.title").alias("title"), F.col("r.continue.apcontinue").alias("next"))
    return rows.select("title", uf.wiki_url(F.col("title")).alias("url"), "next")


def gunzip(df: DataFrame, data: str = "content", carry: Sequence[str] = ("path",)) -> DataFrame:
    """Carried columns and `xml`: bytes as text, unpacked where they are gzip; what is no UTF-8 is left out."""
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [None if x is None else (gzip.decompress(bytes(x)) if bytes(x[:2]) == b"\x1f\x8b" else bytes(x)).decode("utf-8", "ignore") for x in b["_k_data"]]
            yield b.drop(columns="_k_data").assign(xml=texts)

    return df.select(*carry, F.col(data).alias("_k_data")).mapInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), "xml string"]))


def alternate_sitemap(url: Column) -> Column:
    """The other usual name of a sitemap."""
    return F.when(F.contains(url, F.lit("sitemap-index.xml")), F.replace(url, F.lit("sitemap-index.xml"), F.lit("sitemap.xml"))).otherwise(F.replace(url, F.lit("sitemap.xml"), F.lit("sitemap-index.xml")))


def read_env(lines: Sequence[str]) -> dict[str, str]:
    """K=V lines; blanks, comments and lines without = are skipped."""
    out = {}
    for line in map(str.strip, lines):
        if line and not line.startswith("#") and "=" in line:
            name, _, value = line.partition("=")
            out[name.strip()] = value.strip()
    return out


def read_config(text: str) -> CrawlConfig:
    """A crawl's configuration from YAML: the keys of the section logic, and sources with a name and urls each. An unknown key is an error,
    as an allow-list that is not read would allow everything; the section db is not used."""
    import yaml

    data = yaml.safe_load(text) or {}
    logic, sources = data.get("logic") or {}, data.get("sources") or []
    unknown = [*(set(data) - {"db", "logic", "sources"}), *(set(logic) - set(CONFIG_KEYS)), *(k for s in sources for k in set(s) - {"name", "urls"})]
    if unknown:
        raise ValueError(f"unknown keys: {', '.join(sorted(map(str, unknown)))}")
    known: dict = {CONFIG_KEYS[k]: v for k, v in logic.items() if v is not None}
    for name in ("follow_links", "articles_only"):
        if name in known:
            known[name] = str(known[name]).lower() in ("true", "1")
    for name in ("allowed_domains", "denied_extensions"):
        if name in known:
            known[name] = tuple(map(str, known[name]))
    return CrawlConfig(seeds=[(str(u), str(s.get("name", ""))) for s in sources for u in s.get("urls") or ()], **known)


def patch_block(text: str, name: str, block: str) -> str:
    """text with what stands between the begin and end marks of a name replaced by block, or with both appended."""
    begin, end = f"<!-- {name}:begin -->", f"<!-- {name}:end -->"
    whole = f"{begin}\n{block}\n{end}"
    return re.sub(re.escape(begin) + r".*?" + re.escape(end), lambda _: whole, text, count=1, flags=re.DOTALL) if begin in text and end in text else (text.rstrip("\n") + "\n\n" if text else "") + whole + "\n"
