"""Descriptive metrics and inference on daily series, grouped by series keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from leadwake.config import Metrics
from leadwake.functions.scalars import hash_int
from leadwake.operators.regression import least_squares, mean_hac


def strategy_summary(series: DataFrame, keys: Sequence[str], value: str, turnover: str | None = None,
                     cfg: Metrics | None = None) -> DataFrame:
    """Days, totals, Sharpe, drawdown of the running sum, active share.

    A key's series has one row per session, so its window is bounded by the calendar.
    """
    cfg = cfg or Metrics()
    seq = W.partitionBy(*keys).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    run = series.withColumn("__cum", F.sum(value).over(seq)).withColumn("__dd", F.col("__cum") - F.max("__cum").over(seq))
    aggs = [F.count(value).alias("days"), F.sum(value).alias("total"), (F.avg(value) * 252).alias("annual_mean"),
            F.stddev_samp(value).alias("__sd"), F.avg(value).alias("__m"), F.min("__dd").alias("max_drawdown"),
            F.avg((F.col(value) != 0).cast("int")).alias("active_share")]
    aggs.append((F.avg(turnover) if turnover else F.lit(None).cast("double")).alias("mean_turnover"))
    out = run.groupBy(*keys).agg(*aggs)
    excess = F.col("__m") - cfg.risk_free_annual / 252
    flat = F.col("__sd").isNull() | (F.col("__sd") < 1e-12)
    return out.select(*keys, "days", "total", "annual_mean", (F.col("__sd") * F.sqrt(F.lit(252.0))).alias("annual_vol"),
                      F.when(flat, 0.0).otherwise(excess / F.col("__sd") * F.sqrt(F.lit(252.0))).alias("sharpe"),
                      "max_drawdown", "active_share", "mean_turnover")


def alpha_beta(series: DataFrame, benchmark: DataFrame, keys: Sequence[str], value: str, cfg: Metrics | None = None) -> DataFrame:
    """Regression of a P&L series on the benchmark with robust errors; too few rows give nulls."""
    cfg = cfg or Metrics()
    rows = (series.join(benchmark.select("date", "bench"), "date")
            .filter(F.col(value).isNotNull() & F.col("bench").isNotNull())
            .select(*keys, "date", "pos", F.col("bench").alias("x"), F.col(value).alias("y")))
    est = least_squares(rows, keys, "HAC", cfg.hac_lags, min_obs=cfg.min_observations)
    return est.select(*keys, "n", F.col("alpha").alias("daily_alpha"), (F.col("alpha") * 252).alias("annual_alpha"),
                      "beta", "alpha_t", "alpha_p")


def newey_west(series: DataFrame, keys: Sequence[str], value: str, cfg: Metrics | None = None) -> DataFrame:
    cfg = cfg or Metrics()
    return mean_hac(series, keys, value, cfg.hac_lags, min_obs=cfg.min_observations)


def block_bootstrap(series: DataFrame, keys: Sequence[str], value: str, seed: int, cfg: Metrics | None = None,
                    holding: int | None = None) -> DataFrame:
    """Moving-block bootstrap of the mean.

    A block's sum is a difference of two prefix sums, so a replicate costs one lookup per block.
    The prefix sums of a series are one array per key: its length is the calendar, the number of
    keys is the number of books, which bounds the broadcast.  Replicates are spread over tasks.
    """
    cfg = cfg or Metrics()
    block = cfg.bootstrap_block
    if holding is not None and block <= holding:
        raise ValueError(f"block of {block} sessions <= holding of {holding}")
    seq = W.partitionBy(*keys).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    obs = series.filter(F.col(value).isNotNull())
    prefix = (obs.withColumn("__c", F.sum(value).over(seq)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"),
        F.concat(F.array(F.lit(0.0)), F.transform(F.array_sort(F.collect_list(F.struct("pos", "__c"))), lambda s: s["__c"])).alias("csum")))
    reps = (prefix.filter(F.col("n") >= 2 * block)
            .select(*keys, F.explode(F.sequence(F.lit(1), F.lit(cfg.bootstrap_replicates))).alias("rep"))
            .repartition("rep").join(F.broadcast(prefix), list(keys)))
    blocks = F.ceil(F.col("n") / block)

    def block_sum(b):
        start = hash_int(F.col("n") - block + 1, seed, *[F.col(k) for k in keys], F.col("rep"), b)
        length = F.least(F.lit(block), F.col("n") - b * block)
        return F.get(F.col("csum"), (start + length).cast("int")) - F.get(F.col("csum"), start.cast("int"))

    total = F.aggregate(F.sequence(F.lit(0).cast("long"), blocks - 1), F.lit(0.0), lambda acc, b: acc + block_sum(b))
    means = reps.select(*keys, (total / F.col("n")).alias("m"))
    a = cfg.bootstrap_alpha
    dist = means.groupBy(*keys).agg(
        F.percentile("m", F.lit(a / 2)).alias("ci_low"), F.percentile("m", F.lit(1 - a / 2)).alias("ci_high"),
        F.avg((F.col("m") <= 0).cast("int")).alias("lower_tail"), F.count(F.lit(1)).alias("replicates"))
    return (prefix.select(*keys, "n", "mean").join(dist, list(keys), "left")
            .withColumn("replicates", F.coalesce("replicates", F.lit(0))))


def event_car(events: DataFrame, returns: DataFrame, benchmark: DataFrame, calendar: DataFrame,
              holding: int, lag: int = 1) -> DataFrame:
    """Cumulative abnormal return per event over ``holding`` sessions from pos+lag+1.

    Events on dates outside the calendar, of unknown instruments or without any later session
    give null.  Missing abnormal returns are skipped; the tail of the calendar truncates.
    ``events`` needs a unique ``event_id``.
    """
    ab = (returns.join(benchmark, "date").select("instrument", "pos", (F.col("ret") - F.col("bench")).alias("ab")))
    known = returns.select("instrument").distinct().withColumn("known", F.lit(True))
    last = calendar.agg(F.max("pos")).scalar()
    ev = (events.join(calendar.select("date", F.col("pos").alias("event_pos")), "date", "left")
          .join(known, "instrument", "left"))
    due = (ev.filter("known and event_pos is not null")
           .select("event_id", "instrument", F.explode(F.sequence(
               F.col("event_pos") + lag + 1, F.col("event_pos") + lag + holding)).alias("pos")))
    sums = due.join(ab, ["instrument", "pos"]).groupBy("event_id").agg(F.sum("ab").alias("s"))
    ok = F.col("known") & F.col("event_pos").isNotNull() & (F.col("event_pos") + lag + 1 <= last)
    return (ev.join(sums, "event_id", "left")
            .withColumn("car", F.when(ok, F.coalesce("s", F.lit(0.0)))).drop("s", "known"))


def signed_car(cars: DataFrame) -> DataFrame:
    return cars.withColumn("signed_car", F.col("car") * F.col("direction"))
