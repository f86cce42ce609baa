"""Term frequencies, inverted index and its statistics."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korvane.functions import text as tx


def body_tokens(df: DataFrame, doc: str, text: str | None = "text", html: str | None = None) -> DataFrame:
    """(doc, token): a row for each raw token of each row's body: its text if not empty, else its page without tags."""
    body = _body(df, text, html)
    return df.select(F.col(doc).alias("doc_id"), F.explode(tx.raw_tokens(body)).alias("token"))


def _body(df: DataFrame, text: str | None, html: str | None) -> Column:
    plain = F.col(text) if text else F.lit(None).cast("string")
    if html is None:
        return plain
    page = F.col(html) if dict(df.dtypes)[html] == "string" else tx.page_text(F.col(html))
    return F.when(F.length(plain) > 0, plain).otherwise(tx.html_strip(page))


def body_choice(df: DataFrame, text: str = "text", html: str = "html") -> DataFrame:
    """df with `body_kind`: text, html, or null where neither has anything."""
    return df.withColumn("body_kind", F.when(F.length(text) > 0, "text").when(F.octet_length(html) > 0, "html"))


def indexable(df: DataFrame, url: str = "url", text: str = "text", html: str = "html") -> DataFrame:
    """Rows that an index takes: with a url, and with a text or, failing that, a page."""
    return df.where((F.length(url) > 0) & ((F.length(text) > 0) | (F.octet_length(html) > 0)))


def positions(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pos, term): every term of every text with its place from 0."""
    return df.select(F.col(doc).alias("doc_id"), F.posexplode(tx.raw_tokens(F.col(text))).alias("pos", "token")).select("doc_id", "pos", tx.term(F.col("token")).alias("term"))


def term_frequency(df: DataFrame, doc: str = "doc_id", text: str = "text", html: str | None = None, stem: bool = True) -> DataFrame:
    """(term, tf). Raw tokens are counted first, so case and stem are worked out once for each distinct one."""
    raw = body_tokens(df, doc, text, html).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    made = tx.term(F.col("token")) if stem else tx.ru_lower(F.col("token"))
    return raw.groupBy(made.alias("term")).agg(F.sum("n").alias("tf"))


def postings(df: DataFrame, doc: str = "doc_id", text: str | None = "text", html: str | None = None, limit: int | None = None) -> DataFrame:
    """(term, doc_id, tf): the index in rows. limit keeps the first rows in order of doc, before anything is dropped.

    The key of the shuffle is term and document, so a term that is in every document is spread like any other.
    """
    if limit is not None:
        df = df.orderBy(doc).limit(limit)
    return body_tokens(df, doc, text, html).groupBy(tx.term(F.col("token")).alias("term"), "doc_id").agg(F.count(F.lit(1)).alias("tf"))


def write_postings(rows: DataFrame, path: str) -> None:
    """Postings stored by term, ranges of terms apart, so that a query's terms reach few row groups of few files."""
    rows.repartitionByRange(F.col("term"), F.col("doc_id")).sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(path)


def inverted_index(rows: DataFrame, chunk: int | None = None) -> DataFrame:
    """(term, tf, df, postings) of postings rows, postings ascending. With chunk, a row for each term and run of `chunk` document ids
    (column `chunk`), so that no row grows with the collection."""
    keys = ["term"] if chunk is None else ["term", F.floor(F.col("doc_id") / chunk).alias("chunk")]
    return rows.groupBy(*keys).agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df"), F.array_sort(F.collect_list("doc_id")).alias("postings"))


#: Postings, and known tokens, that a worker holds at most before it sends or forgets them (one document may go beyond).
HELD_POSTINGS, HELD_TOKENS = 1 << 21, 1 << 18


class _Terms(dict):
    def __missing__(self, token: str) -> str:
        if len(self) >= HELD_TOKENS:
            self.clear()
        self[token] = made = tx.term_of(token)
        return made


def posting_lists(df: DataFrame, doc: str = "doc_id", text: str = "text", held_postings: int = HELD_POSTINGS) -> DataFrame:
    """(term, df, postings): what `inverted_index` of `postings` gives, without frequencies. Rows with a null id are left out.

    Workers turn runs of documents into lists for each term, so a row travels for each term of a run, not for each term of a document, and
    each token of a run is lowered and stemmed once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, terms, held, n, kind = re.compile(tx.TOKEN).findall, _Terms(), defaultdict(list), 0, None

        def packed() -> pa.RecordBatch:
            ends = np.cumsum([0, *map(len, held.values())])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(list(chain.from_iterable(held.values())), kind))
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), lists], ["term", "postings"])

        for b in batches:
            kind = b.schema.field(0).type
            for key, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = set(map(terms.__getitem__, set(find(x))))
                for t in own:
                    held[t].append(key)
                n += len(own)
                if n >= held_postings:
                    yield packed()
                    held.clear()
                    n = 0
        if held:
            yield packed()

    rows = df.where(F.col(doc).isNotNull() & F.col(text).isNotNull()).select(F.col(doc).alias("doc_id"), F.make_valid_utf8(text).alias("text"))
    lists = rows.mapInArrow(run, f"term string, postings array<{dict(df.dtypes)[doc]}>")
    joined = lists.groupBy("term").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("postings")))).alias("postings"))
    return joined.select("term", F.size("postings").cast("bigint").alias("df"), "postings")


def docs_table(df: DataFrame, url: str = "url") -> DataFrame:
    """(doc_id, url): dense ids from 0 in order of url, for rows with a url. Ranges of urls are numbered apart and then shifted, so no
    task sees all rows."""
    rows = df.where(F.length(url) > 0).select(F.col(url).alias("url"))
    return dense_rank_rows(rows, [F.col("url")], F.substring("url", 1, 40)).select((F.col("rank") - 1).alias("doc_id"), "url")


def dense_rank_rows(rows: DataFrame, order: list[Column], *groups: Column) -> DataFrame:
    """rows with `rank`, their place from 1 in the order. groups: columns, each a prefix of the order, that cut the rows into pieces of
    bearable size; a piece is numbered by itself and shifted by the sizes of those before it."""
    names = [f"_g{i}" for i in range(len(groups))]
    cut = rows.select("*", *(g.alias(n) for n, g in zip(names, groups)))
    sizes = cut.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    shifts = sizes.select(*(F.col(n).alias(f"_s{n}") for n in names), (F.sum("_n").over(Window.orderBy(*names)) - F.col("_n")).alias("_shift"))
    match = [F.col(n).eqNullSafe(F.col(f"_s{n}")) for n in names]
    joined = cut.join(shifts, match).select(*rows.columns, *names, "_shift")
    return joined.withColumn("rank", F.row_number().over(Window.partitionBy(*names).orderBy(*order)) + F.col("_shift")).drop("_shift", *names)


def index_stats(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row: docs, terms, tokens, avg_token_len (bytes after stemming), input_kb (scanner steps), input_bytes."""
    docs = df.where(F.length(text) > 0).agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(tx.input_units(F.col(text))), F.lit(0)).alias("units"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("input_bytes"))
    tf = term_frequency(df.where(F.length(text) > 0), doc, text)
    terms = tf.agg(F.count(F.lit(1)).alias("terms"), F.coalesce(F.sum("tf"), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.col("tf") * F.octet_length("term")), F.lit(0)).alias("bytes"))
    # Two frames of one row each, joined on a constant.
    both = docs.withColumn("_one", F.lit(1)).join(terms.withColumn("_one", F.lit(1)), "_one")
    return both.select("docs", "terms", "tokens", F.coalesce(F.try_divide(F.col("bytes").cast("double"), F.col("tokens")), F.lit(0.0)).alias("avg_token_len"), (F.col("units") / 1024.0).alias("input_kb"), "input_bytes")


def doc_token_counts(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tokens, input_units) of each row; 0 for null."""
    return df.select(F.col(doc).alias("doc_id"), F.coalesce(F.size(tx.raw_tokens(F.col(text))), F.lit(0)).alias("tokens"), F.coalesce(tx.input_units(F.col(text)), F.lit(0)).alias("input_units")).select("doc_id", F.greatest("tokens", F.lit(0)).cast("bigint").alias("tokens"), F.col("input_units").cast("bigint").alias("input_units"))
