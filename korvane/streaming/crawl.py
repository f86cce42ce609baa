"""The crawl's running forms on Structured Streaming: unique addresses, change detection, upsert by batch."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from korvane import runtime
from korvane.functions import urls as uf
from korvane.operators import keyed


def new_addresses(stream: DataFrame, event_time: str = "seen_at", delay: str = "1 day") -> DataFrame:
    """A stream of (url, event_time, ...) with each normal form once within the delay; later rows are dropped with the watermark, so
    the state stays bounded."""
    return stream.withColumn("url", uf.normalize_url(F.col("url"))).withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["url"])


def changed_pages(stream: DataFrame) -> DataFrame:
    """(url, hash, change): for each fetch of a stream (url, hash) whether the page is new, changed or the same, against the last hash
    that the state holds for its url."""

    def judge(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = []
        for b in batches:
            for h in b["hash"]:
                rows.append((key[0], h, "new" if last is None else "same" if h == last else "changed"))
                last = h
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(rows, columns=["url", "hash", "change"])

    return stream.where(F.col("hash").isNotNull()).groupBy("url").applyInPandasWithState(judge, "url string, hash string, change string", "hash string", "append", GroupStateTimeout.NoTimeout)


VERSION_SCHEMA = "url string, html string, source string, fetched_at bigint, hash string, last_checked bigint"


def upsert_stream(stream: DataFrame, table: str, checkpoint: str, **trigger: Any) -> StreamingQuery:
    """Each micro-batch of fetches (url, html, source, hash, fetched_at) stored into a folder of versions; a version is written whole
    before the next one reads it, so a batch that runs again gives the same version."""

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        empty = spark.createDataFrame([], VERSION_SCHEMA)
        before = spark.read.parquet(f"{table}/version={number - 1}") if number else empty
        now = batch.agg(F.max("fetched_at")).collect()[0][0] or 0
        keyed.store_pages(before, batch, now).write.mode("overwrite").parquet(f"{table}/version={number}")
        if number > 1:  # the version before the last is what a batch that runs again needs; older ones go
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/version={number - 2}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def newest_version(spark: SparkSession, table: str) -> DataFrame:
    """What `upsert_stream` stored last; no rows where its stream had no batch yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(table)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in system.listStatus(at)] if system.exists(at) else []
    versions = [int(n.partition("=")[2]) for n in names if n.startswith("version=")]
    return spark.read.parquet(f"{table}/version={max(versions)}") if versions else spark.createDataFrame([], VERSION_SCHEMA)


def drain(spark: SparkSession, folder: str, schema: str, build: Any, name: str) -> DataFrame:
    """Run a stream over the files of a folder to its end and return what it put out."""
    return drained(spark, build(spark.readStream.schema(schema).parquet(folder)), name)


def drained(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """What a stream puts out until its end."""
    out, state = runtime.folder(spark, f"{name}-out"), runtime.folder(spark, f"{name}-state")
    query = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
