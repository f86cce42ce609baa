"""Lines that recur in too many records of one source, and texts without them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def line_letters(line: Column) -> Column:
    """The letters of a line, lower-cased: what two lines must share to be the same."""
    return F.lower(F.regexp_replace(line, r"[^\p{L}]+", ""))


def _lines(df: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """(key, source, line_no, line): every line of every non-null text, numbered from 1."""
    return df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(source).alias("source"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line")).select("key", "source", (F.col("pos") + 1).alias("line_no"), "line")


def frequent_lines(df: DataFrame, key: str = "article_id", source: str = "source", text: str = "text", min_articles: int = 5, min_share: float = 0.05, min_letters: int = 4) -> DataFrame:
    """(key, line_no) of each line whose letters recur in at least min_articles records and min_share of the records with
    non-empty text of the same source.

    Hashed lines are counted per (source, hash) over distinct records with partial counts before the shuffle, so a source or line that
    holds a third of all rows is spread over all tasks by its hashes and reduced to one row a task. Records without source form a
    source of their own. Null and empty texts have no such line; a record counts once however often it repeats a line or is repeated
    itself under its key; an empty table gives no row; further columns are not read.
    """
    letters = _lines(df, key, source, text).select("key", "source", "line_no", line_letters(F.col("line")).alias("letters")).where(F.length("letters") >= min_letters).select("key", "source", "line_no", F.xxhash64("letters").alias("h"))
    totals = df.where(F.length(text) > 0).select(F.col(source).alias("source"), F.col(key).alias("key")).distinct().groupBy("source").agg(F.count(F.lit(1)).alias("articles"))
    counts = letters.select("source", "h", "key").distinct().groupBy("source", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_articles)
    # Exact in whole numbers: n >= share * articles, without the rounding of a product
    often = counts.alias("c").join(totals.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source"))).where(F.col("n") * F.lit(1.0) >= F.col("articles") * F.lit(float(min_share)) - F.lit(1e-9)).select(F.col("c.source").alias("f_source"), F.col("h").alias("f_h"))
    return letters.join(often, F.col("source").eqNullSafe(F.col("f_source")) & (F.col("h") == F.col("f_h")), "left_semi").select(F.col("key").alias(key), "line_no")


def without_frequent_lines(df: DataFrame, key: str = "article_id", source: str = "source", text: str = "text", **limits: float) -> DataFrame:
    """(key, text): each record's text rebuilt without the lines of frequent_lines; null texts stay null. Keys must be unique."""
    found = frequent_lines(df, key, source, text, **limits).groupBy(F.col(key).alias("f_key")).agg(F.collect_set("line_no").alias("gone"))
    kept = F.filter(F.split(F.col(text), "\n", -1), lambda line, i: ~F.coalesce(F.array_contains("gone", i + 1), F.lit(False)))
    return df.select(key, text).join(found, F.col(key) == F.col("f_key"), "left").select(key, F.array_join(kept, "\n").alias(text))
