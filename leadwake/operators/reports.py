"""Input tables of the charts and the metric report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from leadwake.operators.discovery import by_band


def gross_and_net(book: DataFrame) -> DataFrame:
    """Long form with one row per (book, session, series)."""
    parts = F.explode(F.array(F.struct(F.lit("bruto").alias("series"), F.col("gross_pnl").alias("value")),
                              F.struct(F.lit("liquido").alias("series"), F.col("net_pnl").alias("value"))))
    return book.withColumn("__p", parts).select("rule", "mode", "pos", "date", "turnover", "__p.series", "__p.value")


def median_beta_by_band(network: DataFrame, bands: Sequence[int]) -> DataFrame:
    return (by_band(network, bands).groupBy("window", "band")
            .agg(F.median("beta").alias("median_beta"), F.count("beta").alias("pairs")))


def median_beta_by_lag(networks: DataFrame, bands: Sequence[int]) -> DataFrame:
    return by_band(networks, bands).groupBy("lag", "band").agg(F.median("beta").alias("median_beta"))


def cumulative_pnl(book: DataFrame) -> DataFrame:
    run = W.partitionBy("rule", "mode").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    return book.select("rule", "mode", "date", F.sum("gross_pnl").over(run).alias("cumulative_gross"),
                       F.sum("net_pnl").over(run).alias("cumulative_net"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Equal-width counts; the upper edge belongs to the last bin."""
    b = F.least(F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins))
    return df.filter(F.col(value).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def approval_signs(controlled: DataFrame) -> DataFrame:
    return controlled.groupBy("window").agg(
        F.count_if(F.col("approved") & (F.col("beta") > 0)).alias("positive"),
        F.count_if(F.col("approved") & (F.col("beta") <= 0)).alias("negative"))
