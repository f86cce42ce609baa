"""Rank and frequency: Zipf values and the Zipf-Mandelbrot fit over a grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korvane.operators import index


def _grid(start: float, end: float, step: float) -> list[float]:
    """start, start + step, ... up to end, by repeated addition as the fitted values were made."""
    out, x = [], start
    while x <= end:
        out.append(x)
        x += step
    return out


ALPHAS, SHIFTS = _grid(0.8, 1.2, 0.02), _grid(0.0, 10.0, 0.5)


def zipf_rank(tf: DataFrame) -> DataFrame:
    """(rank, term, freq, zipf): terms by falling frequency, then by bytes; zipf is the first frequency over the rank."""
    ranked = index.dense_rank_rows(tf.select("term", "tf"), [F.desc("tf"), F.asc("term")], -F.col("tf"), F.substring("term", 1, 2))
    top = tf.agg(F.max("tf").alias("_top")).withColumn("_one", F.lit(1))
    return ranked.withColumn("_one", F.lit(1)).join(top, "_one").select("rank", "term", F.col("tf").alias("freq"), (F.col("_top") / F.col("rank")).alias("zipf"))


def mandelbrot_fit(ranked: DataFrame) -> DataFrame:
    """One row (alpha, b, c, error): the first pair of the grid with the least squared error of ln f against ln c - alpha ln(rank + b).

    The intercept is that of a free slope while the error is measured at the fixed one, which is how the published fits were made. For
    each b six sums over the ranks say all; the grid over alpha is worked out from those.
    """
    sums = (
        ranked.where(F.col("freq") > 0)
        .select(F.log("freq").alias("y"), "rank", F.explode(F.array(*map(F.lit, SHIFTS))).alias("b"))
        .select("b", "y", F.log(F.col("rank") + F.col("b")).alias("l"))
        .groupBy("b")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("l").alias("sl"), F.sum(F.col("l") * F.col("l")).alias("sll"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"), F.sum(F.col("l") * F.col("y")).alias("sly"))
    )
    at = sums.withColumn("lc", F.try_divide(F.expr("sy * sll - sl * sly"), F.expr("n * sll - sl * sl"))).where(F.col("lc").isNotNull())
    tried = at.select("*", F.explode(F.array(*map(F.lit, ALPHAS))).alias("alpha"))
    error = F.expr("syy + n * lc * lc + alpha * alpha * sll - 2 * lc * sy + 2 * alpha * sly - 2 * alpha * lc * sl")
    return tried.select("alpha", "b", F.exp("lc").alias("c"), error.alias("error")).orderBy("error", "alpha", "b").limit(1)


def mandelbrot_fit_free(ranked: DataFrame) -> DataFrame:
    """One row (alpha, b, c, error): for each b of the grid the least-squares slope and intercept together, and of those the best."""
    l, y = F.log(F.col("rank") + F.col("b")), F.col("y")
    rows = ranked.where(F.col("freq") > 0).select(F.log("freq").alias("y"), "rank", F.explode(F.array(*map(F.lit, SHIFTS))).alias("b"))
    sums = rows.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sum(l).alias("sl"), F.sum(l * l).alias("sll"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy"), F.sum(l * y).alias("sly"))
    fit = sums.withColumn("slope", F.try_divide(F.expr("n * sly - sl * sy"), F.expr("n * sll - sl * sl"))).where(F.col("slope").isNotNull()).withColumn("lc", F.expr("(sy - slope * sl) / n"))
    return fit.select((-F.col("slope")).alias("alpha"), "b", F.exp("lc").alias("c"), F.expr("syy - lc * sy - slope * sly").alias("error")).orderBy("error", "b").limit(1)


def mandelbrot_curve(ranked: DataFrame, fit: DataFrame | None) -> DataFrame:
    """(rank, freq, zipf, mandelbrot) of each rank; mandelbrot is 0 without a fit."""
    if fit is None:
        return ranked.select("rank", "freq", "zipf", F.lit(0.0).alias("mandelbrot"))
    one = fit.select("alpha", "b", "c").withColumn("_one", F.lit(1))
    return ranked.withColumn("_one", F.lit(1)).join(one, "_one", "left").select("rank", "freq", "zipf", F.coalesce(F.col("c") / F.pow(F.col("rank") + F.col("b"), F.col("alpha")), F.lit(0.0)).alias("mandelbrot"))
