"""Histograms of durations and values: counts by bucket, which add up over days, partitions and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Upper bounds of the buckets where none are given (the usual ones of request durations, in seconds).
BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)


def bucket(value: Column, bounds: tuple[float, ...] = BOUNDS) -> Column:
    """The least bound that the value doesn't exceed; infinity beyond the last one."""
    found = F.lit(float("inf"))
    for b in reversed(bounds):
        found = F.when(value <= b, b).otherwise(found)
    return found


def histogram(log: DataFrame, value: str, by: list[str], bounds: tuple[float, ...] = BOUNDS) -> DataFrame:
    """(by, le, n, total): rows and their sum in each bucket that has any. Null values are in none."""
    rows = log.where(F.col(value).isNotNull()).withColumn("le", bucket(F.col(value), bounds))
    return rows.groupBy(*by, "le").agg(F.count("*").alias("n"), F.sum(F.col(value).cast("double")).alias("total"))


def merged(*histograms: DataFrame, by: list[str]) -> DataFrame:
    """Histograms of the same bounds as one, by fewer columns if need be."""
    both = histograms[0].select(*by, "le", "n", "total")
    for h in histograms[1:]:
        both = both.unionByName(h.select(*by, "le", "n", "total"))
    return both.groupBy(*by, "le").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def cumulative(histogram: DataFrame, by: list[str], bounds: tuple[float, ...] = BOUNDS) -> DataFrame:
    """(by, le, n): how many values are at most ``le``, for every bound and infinity, as scrapers expect it."""
    every = F.explode(F.array(*map(F.lit, [*bounds, float("inf")])))
    frame = histogram.select(*by).distinct().select(*by, every.alias("le")).join(histogram.select(*by, "le", "n"), [*by, "le"], "left")
    return frame.select(*by, "le", F.sum(F.coalesce("n", F.lit(0))).over(W.partitionBy(*by).orderBy("le")).alias("n"))


def quantiles(histogram: DataFrame, by: list[str], q: float, bounds: tuple[float, ...] = BOUNDS) -> DataFrame:
    """(by, value): the q-quantile by linear interpolation inside its bucket; the last bound for what lies beyond it."""
    c = cumulative(histogram, by, bounds).withColumn("before", F.lag("n", 1, 0).over(W.partitionBy(*by).orderBy("le"))).withColumn("low", F.lag("le", 1, 0.0).over(W.partitionBy(*by).orderBy("le")))
    want = F.max("n").over(W.partitionBy(*by)) * q
    inside = F.when(F.col("le") == float("inf"), F.col("low")).otherwise(F.col("low") + (F.col("le") - F.col("low")) * (F.col("want") - F.col("before")) / (F.col("n") - F.col("before")))
    return c.withColumn("want", want).where("n >= want and before < want").select(*by, inside.alias("value"))
