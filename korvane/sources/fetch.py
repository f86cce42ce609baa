"""Fetching over HTTP from Python workers, and lists that come in pages."""

from __future__ import annotations

import gzip
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from korvane.operators.crawl import Fetcher

#: (address, timeout) -> (status, body, final address); raises OSError where nothing came.
Opener = Callable[[str, float], tuple[int, bytes, str]]


def open_url(url: str, timeout_s: float, user_agent: str = "korvane") -> tuple[int, bytes, str]:
    """GET with redirects followed; an error status is an answer, not an error."""
    request = urllib.request.Request(url, headers={"User-Agent": user_agent})
    try:
        with urllib.request.urlopen(request, timeout=timeout_s) as answer:
            return answer.status, answer.read(), answer.url
    except urllib.error.HTTPError as e:
        return e.code, e.read(), e.url or url


def with_retries(opener: Opener, url: str, timeout_s: float, attempts: int, pause_s: float) -> tuple[int, bytes, str]:
    """The first answer below 400 of so many attempts, else the last answer; raises the last error where no attempt got one."""
    last: tuple[int, bytes, str] | None = None
    error: OSError | None = None
    for n in range(attempts):
        if n:
            time.sleep(pause_s)
        try:
            last = opener(url, timeout_s)
            if last[0] < 400:
                return last
        except OSError as e:
            error = e
    if last is None:
        raise error or OSError(url)
    return last


def http_fetcher(opener: Opener = open_url, attempts: int = 3, pause_s: float = 0.5, timeout_s: float = 20.0, delay_s: float = 0.0) -> Fetcher:
    """A fetcher for `crawl`: (url, status, body, final_url), status 0 and null body where nothing came. delay_s: pause of a worker
    after each address. Addresses are fetched where their partition is; bytes that are no UTF-8 are read as windows-1251."""

    def fetch(frontier: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = []
                for url in b["url"]:
                    try:
                        status, data, final = with_retries(opener, url, timeout_s, attempts, pause_s)
                        try:
                            body = data.decode("utf-8")
                        except UnicodeDecodeError:
                            body = data.decode("windows-1251", "replace")
                        rows.append((url, status, body, final))
                    except (OSError, ValueError):
                        rows.append((url, 0, None, url))
                    if delay_s:
                        time.sleep(delay_s)
                yield pd.DataFrame(rows, columns=["url", "status", "body", "final_url"])

        return frontier.select("url").mapInPandas(run, "url string, status int, body string, final_url string")

    return fetch


def fetch_sitemap(url: str, opener: Opener = open_url, attempts: int = 3, pause_s: float = 0.5, timeout_s: float = 20.0) -> str:
    """A sitemap as text: unpacked where its name ends in .gz; under its other usual name where the first answers with an error status."""

    def get(name: str) -> str:
        status, data, _ = with_retries(opener, name, timeout_s, attempts, pause_s)
        if status >= 400:
            raise urllib.error.HTTPError(name, status, "no sitemap", None, None)
        return (gzip.decompress(data) if name.endswith(".gz") else data).decode("utf-8", "ignore")

    try:
        return get(url)
    except urllib.error.HTTPError:
        for known, other in (("sitemap-index.xml", "sitemap.xml"), ("sitemap.xml", "sitemap-index.xml")):
            if url.endswith(known):
                return get(url.removesuffix(known) + other)
        raise


def paginated(spark: SparkSession, ask: Callable[[str | None], str], most: int = 0) -> DataFrame:
    """(json): answers of a list interface, asked again with the token of each answer until one has none; most > 0 bounds how many."""
    answers: list[tuple[str]] = []
    token: str | None = None
    while not most or len(answers) < most:
        answer = ask(token)
        answers.append((answer,))
        token = (json.loads(answer).get("continue") or {}).get("apcontinue")
        if token is None:
            break
    return spark.createDataFrame(answers, "json string")
