"""Writes by key: insert if absent, upsert, partial update, conditional write, delete; and the crawler's queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the last in the order. The winner is found by an aggregate with partial results, so a hot key is no hot task."""
    whole = F.struct(*(F.col(c) for c in df.columns))
    best = df.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.max_by(whole, F.struct(*order)).alias("_row"))
    return best.select("_row.*")


def insert_if_absent(table: DataFrame, new: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """table with those new rows whose key it lacks; of several new rows of a key the first in the order."""
    first = new.groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*new.columns), F.struct(*order)).alias("_row")).select("_row.*")
    return table.unionByName(first.join(table.select(key), key, "left_anti"), allowMissingColumns=True)


def upsert(table: DataFrame, new: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """table with the listed columns of new rows set by key, other columns kept; keys it lacks are added. The last new row wins."""
    last = latest(new, [key], order)
    t, n = table.alias("t"), last.select(*(F.col(c).alias(f"_n_{c}") for c in last.columns)).alias("n")
    both = t.join(n, F.col(f"t.{key}") == F.col(f"_n_{key}"), "full")
    hit = F.col(f"_n_{key}").isNotNull()
    return both.select(*(F.when(hit, F.col(f"_n_{c}")).otherwise(F.col(f"t.{c}")).alias(c) if c in new.columns else F.col(f"t.{c}").alias(c) for c in table.columns))


def record_key(url: Column, text: Column) -> Column:
    """Key of a loaded record: its url, else its text."""
    return F.coalesce(F.when(url != "", url), F.when(text != "", text))


def store_pages(pages: DataFrame, fetched: DataFrame, now: int) -> DataFrame:
    """pages after a fetch (url, html, source, hash): unknown urls are added, changed bodies replaced, unchanged ones marked as checked.

    Of several fetches of one url the one with the last hash wins. fetched_at moves only when the body is new.
    """
    new = latest(fetched, ["url"], [F.col("hash")]).select(F.col("url").alias("n_url"), F.col("html").alias("n_html"), F.col("source").alias("n_source"), F.col("hash").alias("n_hash"))
    both = pages.join(new, F.col("url") == F.col("n_url"), "full")
    seen = F.col("n_url").isNotNull()
    fresh = seen & ~F.col("hash").eqNullSafe(F.col("n_hash"))
    same = seen & F.col("hash").eqNullSafe(F.col("n_hash"))
    return both.select(
        F.coalesce("url", "n_url").alias("url"),
        F.when(fresh, F.col("n_html")).otherwise(F.col("html")).alias("html"),
        F.when(fresh, F.col("n_source")).otherwise(F.col("source")).alias("source"),
        F.when(fresh, F.lit(now)).otherwise(F.col("fetched_at")).alias("fetched_at"),
        F.when(fresh, F.col("n_hash")).otherwise(F.col("hash")).alias("hash"),
        F.when(same, F.lit(now)).otherwise(F.col("last_checked")).alias("last_checked"),
    )


def reset_processing(queue: DataFrame) -> DataFrame:
    """The queue with all rows that were being processed pending again."""
    return queue.withColumn("status", F.when(F.col("status") == "processing", "pending").otherwise(F.col("status")))


def claim(queue: DataFrame, n: int) -> DataFrame:
    """The n pending rows that wait longest; ties by url, depth and source."""
    return queue.where(F.col("status") == "pending").orderBy(F.asc_nulls_last("enqueued_at"), "url", "depth", "source").limit(n)


def dequeue(queue: DataFrame, done: DataFrame) -> DataFrame:
    """The queue without the urls that are done."""
    return queue.join(done.select("url").distinct(), "url", "left_anti")


def revisit_due(pages: DataFrame, now: int, after_s: int, limit: int = 200, by_check: bool = False) -> DataFrame:
    """Pages fetched at least after_s ago, the oldest first; none if after_s is not positive. by_check: a check counts as a fetch."""
    at = F.greatest(F.col("fetched_at"), F.col("last_checked")) if by_check else F.col("fetched_at")
    if after_s <= 0:
        return pages.where(F.lit(False))
    return pages.where(at <= now - after_s).orderBy("fetched_at", "url").limit(limit)


def enqueue_revisits(queue: DataFrame, due: DataFrame, now: int) -> DataFrame:
    """The queue with due pages at depth 0, unless their url waits already."""
    rows = due.select("url", "source", F.lit(0).alias("depth"), F.lit("pending").alias("status"), F.lit(now).cast("bigint").alias("enqueued_at"), F.lit(None).cast("bigint").alias("started_at"), F.lit(True).alias("revisit"))
    return insert_if_absent(queue, rows, "url", [F.col("source")])
