"""Main body of pages: lines that belong to a site's template go, the article's own stay.

A line of a text is what an element of its page became, so its normalised letters are the hash of a subtree. Spark counts in how many
records of its host each hash stands, for all records and exactly, and what recurs in many of them is deleted: LEAST records and SHARE
of the host's. That is sure but finds only what is the same on every page; bylines, counters and links to other articles differ from
page to page. What does not recur enough is left to a classifier, which saved pages teach: a page's tree is split at its own article's
container, elements lie inside or outside of it, and records whose page was saved show which of their lines these became. Their hashed
parts (the whole line, its ends, its parts between separators, its shape, what stood before it, how often it recurs) are counted inside and
outside, and a line goes if the weights of its parts say so. Pages of one host use different containers, so each is split at its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korvane import runtime
from korvane.llm import markup

#: Records of a host that must hold a line, at least, and their share of its records, for it to go as recurring.
LEAST, SHARE = 5, 0.05
#: Saved pages that teach the classifier, at most, in order of a hash of their address; slots of its counts; slots of the sketch that holds
#: lines back from the count (fixed sizes, whatever the input); parts in which it travels.
TRAIN_PAGES, SLOTS, SKETCH, PARTS = 20_000, 1 << 22, 1 << 20, 16
#: Factor of the weights (they overlap), and the sum above which a line is template.
FACTOR, THRESHOLD = 0.6, 3.0

_DIGITS, _BLANK, _TOKEN = re.compile(r"\d+"), re.compile(r"\s+"), re.compile(r"\w+|[^\w\s]")
_PARTING = re.compile(r"[|·/→›»>☰]|  +")
_SIGNS = "|·/→›»>—:#☰©<{[\\$"
_INLINE = re.compile(r"<[^<>]*>|&#?\w+;|\]\([^)\n]*\)|[\[\]*_~`'|]")
_WORDS = re.compile(r"\w+")
_LINKING = re.compile("[›→»☰/>]")


def _slot(key: str) -> int:
    return xxhash.xxh32_intdigest(key) & (SLOTS - 1)


def letters(line: str) -> str:
    """What two renderings of one element share."""
    return "".join(_WORDS.findall(line.lower()))


def _line_print(host: str, line: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{host}\n{_DIGITS.sub('0', line.lower()).strip()}")


def _ends(text: str) -> tuple[list[str], list[str], int]:
    """The first three tokens, the last three, and how many words there are, up to 17. A long line is not cut in tokens as a whole."""
    if len(text) < 200:
        tokens = _TOKEN.findall(text)
        return tokens[:3], tokens[-3:], sum(t[0].isalnum() for t in tokens)
    width = 64
    while len(last := _TOKEN.findall(text[-width:])) < 4 and width < len(text):
        width *= 2
    words = sum(1 for _ in islice(_WORDS.finditer(text), 17))
    return [m[0] for m in islice(_TOKEN.finditer(text), 3)], last[-3:], words


def subtrees(line: str, host: str, at: int, left: int, recurs: int) -> tuple[list[str], str]:
    """Keys of a line's subtrees, and its shape. at, left: lines before and after it; recurs: records of its host that hold it."""
    plain = _DIGITS.sub("0", line.lower())
    whole = _BLANK.sub(" ", plain).strip()
    first, last, n = _ends(whole)
    if not first:
        return ["empty"], "empty"
    end, lead = whole[-1:], whole[0] if not whole[0].isalnum() else "w"
    words = 1 if n <= 1 else 2 if n == 2 else 3 if n <= 5 else 4 if n <= 10 else 5 if n <= 16 else 6
    close = "." if end in ".!?…" else ";" if end in ";," else end if end in "):" else "w" if end.isalnum() else "o"
    shape = f"{words}{close}"
    signs = "".join(c for c in _SIGNS if c in whole) if words < 6 else ""
    times = min(8, recurs.bit_length())
    keys = [f"F{whole}", f"H{host}|{whole}", f"s{shape}{lead}{signs}", f"S{shape}{min(at, 3)}", f"E{shape}{min(left, 3)}", f"R{times}{shape}", f"P{first[0]}|{shape}", f"m{' '.join(last[-3:-1])}"]
    for j in (1, 2, 3):
        keys += (f"p{' '.join(first[:j])}", f"q{' '.join(last[-j:])}")
    parts = [x for x in map(str.strip, _PARTING.split(plain)) if x]
    if len(parts) > 1 or n <= 2:
        keys += [f"g{x}" for x in dict.fromkeys(parts)]
    return keys, shape


def is_headline(line: str, title: str | None, at: int) -> bool:
    """Whether a line is the record's own headline: most words of its title and no sign of a path; where the title is missing, a first
    line of some words without a stop or sign."""
    plain = _INLINE.sub(" ", line.lower())
    if _LINKING.search(plain):
        return False
    own = set(_WORDS.findall(plain))
    if title:
        named = set(_WORDS.findall(_INLINE.sub(" ", title.lower())))
        return bool(own) and len(own & named) >= 0.6 * max(len(own), len(named))
    return at == 0 and 3 <= len(own) <= 9 and not re.search(r"[.!?…;:—]\s*$|[,|·☰©]|  |\d{3}", line.strip())


def _sketch_slots(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    half = SKETCH // 2
    return (prints % np.uint64(half)).astype(np.int64), ((prints >> np.uint64(32)) % np.uint64(half)).astype(np.int64) + half


def _prints(text: str, host: str) -> np.ndarray:
    """Hashes of the distinct non-blank lines of a text, each whole."""
    own = {y for y in text.split("\n") if y.strip()}
    return np.unique(np.array([_line_print(host, x) for x in own], dtype=np.uint64))


def _line_sketch(rows: DataFrame) -> np.ndarray:
    """Sketch of in how many rows (host, text) each line stands: a fixed number of counters, never too low."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketch = np.zeros(SKETCH, dtype=np.uint32)
        for b in batches:
            prints = [_prints(t, h or "") for h, t in zip(b["host"], b["text"])]
            for slots in _sketch_slots(np.concatenate([np.empty(0, dtype=np.uint64), *prints])):
                sketch += np.bincount(slots, minlength=SKETCH).astype(np.uint32)
        yield pd.DataFrame({"part": np.arange(PARTS), "data": [x.tobytes() for x in np.split(sketch, PARTS)]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum((np.frombuffer(x, dtype=np.uint32).astype(np.uint64) for x in group["data"]), np.zeros(SKETCH // PARTS, dtype=np.uint64))
        return pd.DataFrame({"part": [group["part"].iloc[0]], "data": [np.minimum(total, (1 << 32) - 1).astype(np.uint32).tobytes()]})

    out = np.zeros((PARTS, SKETCH // PARTS), dtype=np.uint32)
    for r in rows.select("host", "text").mapInPandas(count, "part int, data binary").groupBy("part").applyInPandas(add, "part int, data binary").collect():
        out[r["part"]] = np.frombuffer(r["data"], dtype=np.uint32)
    return out.reshape(-1)


def recurring_lines(rows: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """(record, content, prints, times, much): for each row (record, content, host, title, text) with such lines, of any length, the hashes of its
    lines that stand in two or more records of its host, in how many exactly, and whether those are `least` and `share` of the host's.

    Records of one title count once. Distinct ones per line are counted by (line, title), then by line with partial counts, so a line that stands in a third of all
    records is spread over all tasks. Lines that the sketch shows once stand in one record, as it is never too low; they are not moved.
    """
    sketch = rows.sparkSession.sparkContext.broadcast(_line_sketch(rows))

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counters = sketch.value
        for b in batches:
            own = [_prints(t, h or "") for h, t in zip(b["host"], b["text"])]
            flat, at = np.concatenate([np.empty(0, dtype=np.uint64), *own]), np.repeat(np.arange(len(own)), [len(x) for x in own])
            x, y = _sketch_slots(flat)
            some = np.minimum(counters[x], counters[y]) > 1
            at = at[some]
            yield pd.DataFrame({"record": b["record"].to_numpy()[at], "content": b["content"].to_numpy()[at], "site": b["site"].to_numpy()[at], "work": b["work"].to_numpy()[at], "h": flat[some].view(np.int64)})

    name = F.lower(F.trim(F.col("title")))
    sited = rows.withColumn("site", F.xxhash64(F.coalesce("host", F.lit("")))).withColumn("work", F.when(F.length(name) > 0, F.xxhash64(name)).otherwise(F.col("record")))
    lines = runtime.written(sited.mapInPandas(held, "record bigint, content bigint, site bigint, work bigint, h bigint"), "line-prints")
    often = lines.select("h", "site", "work").distinct().groupBy("h", "site").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    totals = sited.select("site", "work").distinct().groupBy("site").agg(F.count(F.lit(1)).alias("records"))
    judged = often.join(totals, "site").select("h", "n", ((F.col("n") >= least) & (F.col("n") >= share * F.col("records"))).alias("much"))
    found = lines.join(judged, "h").groupBy("record", "content").agg(F.sort_array(F.collect_set(F.struct("h", "n", "much"))).alias("x"))
    return found.select("record", "content", F.col("x.h").alias("prints"), F.col("x.n").alias("times"), F.col("x.much").alias("much"))


def _counted(articles: DataFrame, key: str, url: str, text: str, host: str) -> DataFrame:
    """Written table (key, url, host, title, text, prints, times, much) of all rows with text: `recurring_lines` joined back. A record is what
    has the same key; rows without key are records of their own unless they are equal."""
    content = F.xxhash64(key, host, text)
    record = F.when(F.col(key).isNull(), content).otherwise(F.xxhash64(key))
    rows = articles.where(F.length(text) > 0).select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(host).alias("host"), "title", F.col(text).alias("text"), record.alias("record"), content.alias("content"))
    counts = recurring_lines(rows.select("record", "content", "host", "title", "text"))
    return runtime.written(rows.join(counts, ["record", "content"], "left").drop("record", "content"), "counted-lines")


def _lines(text: str, host: str, prints: np.ndarray | None, times: np.ndarray | None, much: np.ndarray | None) -> list[tuple[int, str, int, bool]]:
    """(number, line, recurrence, whether that is much) of each non-blank line."""
    often = {h: (n, m) for h, n, m in zip(prints.tolist(), times.tolist(), much.tolist())} if prints is not None else {}
    own = [(i, x) for i, x in enumerate(text.split("\n"), 1) if x.strip()]
    if not often:
        return [(i, x, 1, False) for i, x in own]
    hashes = np.array([_line_print(host, x) for _, x in own], dtype=np.uint64).view(np.int64).tolist()
    return [(i, x, *often.get(h, (1, False))) for (i, x), h in zip(own, hashes)]


def _page_sides(pages: DataFrame, url: str, page: str) -> DataFrame:
    """(url, inside, outside): hashed texts of the elements inside and outside of each page's article; one row per url, of the page
    with most elements. Pages in which nothing stands outside tell nothing and are left out."""

    def sides(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, data in zip(b["url"], b["page"]):
                tree = markup._Tree()
                tree.feed(markup.page_text(data) or "")
                best = markup.best_of(tree)
                within: set[int] = set()
                without: set[int] = set()
                for path, _, text in tree.parts:
                    side = within if best and (path == best or path.startswith(best + "/")) else without
                    side.update(xxhash.xxh3_64_intdigest(letters(x)) >> 1 for x in text.split("\n") if x.strip())
                if best and within and without and best.count("/") > 1:
                    rows.append((name, list(within), list(without - within), len(tree.parts)))
            yield pd.DataFrame(rows, columns=["url", "inside", "outside", "n"])

    out = pages.select(F.col(url).alias("url"), F.col(page).alias("page")).mapInPandas(sides, "url string, inside array<bigint>, outside array<bigint>, n int")
    return out.groupBy("url").agg(F.max_by(F.struct("inside", "outside"), F.struct("n", F.hash("outside"))).alias("x")).select("url", "x.inside", "x.outside")


class Weights:
    """Log odds of a line being template, for each slot of a subtree key."""

    def __init__(self, slots: np.ndarray, inside: np.ndarray, outside: np.ndarray, total: tuple[int, int]) -> None:
        self.slots, self.base = np.zeros(SLOTS, dtype=np.float32), 0.0
        self.known = sum(total) > 0
        if self.known:
            share = (max(1, total[1])) / (sum(total) + 1)
            self.base = float(np.log(share / (1 - share)))
            self.slots[slots] = np.log((outside + 1.4 * share) / (inside + 1.4 * (1 - share))) - self.base

    def score(self, keys: list[str]) -> float:
        return self.base + FACTOR * float(self.slots[[_slot(k) for k in keys]].sum())


def _known_lines(counted: DataFrame, pages: DataFrame, url: str, host: str, page: str) -> DataFrame:
    """(host, title, text, prints, times, much, inside, outside) of each record whose page was saved. What has no page is held back before the
    shuffle by a bitmap of the pages' addresses, of fixed size."""
    named = pages.where(F.col(url).isNotNull() & (F.octet_length(page) > 0))
    share = min(1.0, TRAIN_PAGES / max(1, named.select(url).distinct().count()))
    some = named.where(F.shiftrightunsigned(F.xxhash64(url), 1) <= min((1 << 63) - 1, int(share * (1 << 63))))
    sides = runtime.written(_page_sides(some, url, page), "page-sides")
    saved = runtime.bitmap(sides.select(F.xxhash64("url").alias("h")), "h")

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[runtime.in_bitmap(saved, b["h"].to_numpy())].drop(columns=["h"])

    rows = counted.where(F.col("url").isNotNull()).select("url", "host", "title", "text", "prints", "times", "much", F.xxhash64("url").alias("h"))
    return rows.mapInPandas(held, "url string, host string, title string, text string, prints array<bigint>, times array<bigint>, much array<boolean>").join(sides, "url")


def learn(counted: DataFrame, pages: DataFrame, url: str = "url", host: str = "source", page: str = "html") -> Weights:
    """Weights of subtrees from the records of at most TRAIN_PAGES saved pages. Counts are added up per slot in Spark; the driver gets their
    sums, SLOTS at most."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((2, SLOTS), dtype=np.int32)
        total = [0, 0]
        for b in batches:
            for host_name, title, body, prints, recur, much, within, without in zip(b["host"], b["title"], b["text"], b["prints"], b["times"], b["much"], b["inside"], b["outside"]):
                within, without = set(within.tolist()), set(without.tolist())
                lines = _lines(body, host_name or "", prints, recur, much)
                before, before_shape = "^", "^"
                for k, (_, line, times, _) in enumerate(lines):
                    name = xxhash.xxh3_64_intdigest(letters(line)) >> 1
                    side = 0 if name in within else 1 if name in without else None
                    keys, shape = subtrees(line, host_name or "", k, len(lines) - 1 - k, times)
                    if side is not None and is_headline(line, title, k):
                        side = 0
                    elif side is not None:
                        total[side] += 1
                        keys.append(f"T{before}{before_shape}>{shape}")
                        counts[side, list({_slot(x) for x in keys})] += 1
                    before, before_shape = "?" if side is None else str(side), shape
        some = np.flatnonzero(counts.any(axis=0))
        yield pd.DataFrame({"slot": np.r_[some, -1].astype(np.int64), "inside": np.r_[counts[0, some], total[0]], "outside": np.r_[counts[1, some], total[1]]})

    rows = _known_lines(counted, pages, url, host, page).mapInPandas(count, "slot bigint, inside bigint, outside bigint")
    sums = rows.groupBy("slot").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).where((F.col("slot") < 0) | (F.col("inside") + F.col("outside") >= 2)).toPandas()
    whole, own = sums[sums["slot"] < 0], sums[sums["slot"] >= 0]
    total = (int(whole["inside"].sum()), int(whole["outside"].sum()))
    return Weights(own["slot"].to_numpy(), own["inside"].to_numpy(dtype=np.float64), own["outside"].to_numpy(dtype=np.float64), total)


def template_line_numbers(text: str | None, title: str | None, host: str | None, weights: Weights, prints: np.ndarray | None, recur: np.ndarray | None, much: np.ndarray | None) -> list[int]:
    """Numbers of the non-blank lines of a text that are template. prints, recur, much: its recurring lines as `recurring_lines` gives them."""
    found: list[int] = []
    if not text:
        return found
    lines = _lines(text, host or "", prints, recur, much)
    before, before_shape = "^", "^"
    for k, (number, line, times, often) in enumerate(lines):
        keys, shape = subtrees(line, host or "", k, len(lines) - 1 - k, times)
        score = weights.score([*keys, f"T{before}{before_shape}>{shape}"]) if weights.known else 0.0
        side = "1" if not is_headline(line, title, k) and score > (-THRESHOLD if often else THRESHOLD) else "0"
        if side == "1":
            found.append(number)
        before, before_shape = side, shape
    return found


def template_lines(articles: DataFrame, pages: DataFrame, key: str = "article_id", url: str = "url", text: str = "text", host: str = "source", page: str = "html") -> DataFrame:
    """(key, line_no): each non-blank line of a record's text that is not main body.

    A line that stands in LEAST records and SHARE of the records with text of its host goes, unless saved pages say surely that it belongs to
    articles (a fence, a line of code); what recurs less is judged by weights that were learned from saved pages, and stays where there are
    none. Records of one title count once, so an article that comes again and again does not look like a template. Null, empty and blank texts have no such line; records without host
    count as one host. Repeated rows give repeated rows; an empty table gives none; of further columns only `title` is read. A host with
    a third of all rows is no group of its own: nothing is shuffled by host but one row for each recurring line.
    """
    spark = articles.sparkSession
    if "title" not in articles.columns:
        articles = articles.withColumn("title", F.lit(None).cast("string"))
    rows = _counted(articles, key, url, text, host)
    weights = spark.sparkContext.broadcast(learn(rows, pages, url, host, page))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(k, n) for k, h, t, x, p, r, m in zip(*(b[c] for c in ("key", "host", "title", "text", "prints", "times", "much"))) for n in template_line_numbers(x, t, h, weights.value, p, r, m)]
            yield pd.DataFrame(found, columns=["key", "line_no"])

    kind = dict(articles.dtypes)[key]
    return rows.select("key", "host", "title", "text", "prints", "times", "much").mapInPandas(run, f"key {kind}, line_no int").withColumnRenamed("key", key)


def main_texts(articles: DataFrame, pages: DataFrame, key: str = "article_id", text: str = "text", **names: str) -> DataFrame:
    """(key, text): each record's text without template lines; null texts stay null. Keys must be unique."""
    found = template_lines(articles, pages, key=key, text=text, **names).groupBy(F.col(key).alias("f_key")).agg(F.collect_set("line_no").alias("gone"))
    kept = F.filter(F.split(F.col(text), "\n", -1), lambda line, i: ~F.coalesce(F.array_contains("gone", i + 1), F.lit(False)))
    return articles.select(key, text).join(found, F.col(key) == F.col("f_key"), "left").select(key, F.array_join(kept, "\n").alias(text))
