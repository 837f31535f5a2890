"""Audit of quote series: measure, mark and report; nothing is corrected here."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from leadwake.config import Liquidity, StalePrice


def _records():
    return W.partitionBy("instrument").orderBy("date")


def suspect_days(quotes: DataFrame, cfg: StalePrice | None = None) -> DataFrame:
    """Flags per record; neighbours are previous records, not previous sessions."""
    cfg = cfg or StalePrice()
    low = F.percentile("volume", F.lit(cfg.low_volume_percentile)).over(W.partitionBy("instrument"))
    flags = quotes.withColumns({
        "zero_volume": F.coalesce("volume", F.lit(0.0)) <= 0,
        "few_trades": F.coalesce("trades", F.lit(0)) < cfg.min_trades,
        "low_volume": F.coalesce(F.col("volume") < low, F.lit(False)),
        "repeated_close": F.coalesce(F.col("close") == F.lag("close").over(_records()), F.lit(False))})
    n = sum((F.col(c).cast("int") for c in ("zero_volume", "few_trades", "low_volume", "repeated_close")), F.lit(0))
    return flags.withColumn("signals", n).withColumn("suspect", F.col("signals") >= 2)


def longest_equal_close(quotes: DataFrame) -> DataFrame:
    """Longest run of identical consecutive closes per instrument."""
    changed = F.coalesce((F.col("close") != F.lag("close").over(_records())).cast("int"), F.lit(1))
    runs = quotes.withColumn("c", changed).withColumn("run", F.sum("c").over(_records()))
    return (runs.groupBy("instrument", "run").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("instrument").agg(F.max("n").alias("longest_equal_run")))


def audit_instruments(quotes: DataFrame, calendar: DataFrame, stale: StalePrice | None = None,
                      liquidity: Liquidity | None = None) -> DataFrame:
    """One row per instrument with all that decides whether its series can be trusted.

    Coverage is measured inside the listing span.  Expected sessions are the difference of two
    calendar positions, looked up by date (every listing date is a quoted date).
    """
    stale, liquidity = stale or StalePrice(), liquidity or Liquidity()
    g = suspect_days(quotes, stale).groupBy("instrument").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("sessions_seen"),
        F.min_by("kind", "date").alias("kind"), F.substring(F.min_by("isin", "date"), 3, 4).alias("issuer"),
        F.min_by("name", "date").alias("name"), F.median("volume").alias("median_volume"), F.avg("volume").alias("mean_volume"),
        F.median("trades").alias("median_trades"), F.percentile("trades", F.lit(0.10)).alias("trades_p10"),
        F.median("close").alias("median_price"), F.count_if("zero_volume").alias("zero_volume_days"),
        F.count_if("few_trades").alias("few_trade_days"), F.count_if("repeated_close").alias("repeated_days"),
        F.count_if("suspect").alias("suspect_days"))
    # Sessions on or before each civil day; a calendar-sized running count.
    days = (calendar.agg(F.min("date").alias("a"), F.max("date").alias("b"))
            .select(F.explode(F.sequence("a", "b")).alias("day")))
    upto = (days.join(calendar.select(F.col("date").alias("day"), F.lit(1).alias("s")), "day", "left")
            .select("day", F.coalesce("s", F.lit(0)).alias("s"),
                    F.sum(F.coalesce("s", F.lit(0))).over(W.orderBy("day")).alias("upto")))
    lo = upto.select(F.col("day").alias("first_date"), (F.col("upto") - F.col("s")).alias("before_first"))
    hi = upto.select(F.col("day").alias("last_date"), F.col("upto").alias("upto_last"))
    total = calendar.agg(F.count(F.lit(1))).scalar()
    start = calendar.agg(F.min("date")).scalar()
    a = g.join(lo, "first_date", "left").join(hi, "last_date", "left")
    expected = (F.coalesce("upto_last", F.when(F.col("last_date") < start, F.lit(0)).otherwise(total))
                - F.coalesce("before_first", F.when(F.col("first_date") < start, F.lit(0)).otherwise(total)))
    a = a.withColumn("sessions_expected", expected).drop("before_first", "upto_last").join(longest_equal_close(quotes), "instrument")
    e = F.col("sessions_expected")
    a = a.withColumns({
        "sessions_untraded": F.greatest(e - F.col("sessions_seen"), F.lit(0)),
        "coverage": F.when(e > 0, F.col("sessions_seen") / e),
        "traded_share": F.when(e > 0, (F.col("sessions_seen") - F.col("zero_volume_days")) / e),
        "suspect_share": F.col("suspect_days") / F.col("sessions_seen"),
        "repeated_share": F.col("repeated_days") / F.col("sessions_seen")})
    ok = lambda c: F.coalesce(c, F.lit(False))
    a = a.withColumns({
        "eligible_coverage": ok(F.col("coverage") >= liquidity.min_coverage),
        "eligible_trading": ok(F.col("traded_share") >= liquidity.min_traded_share),
        "eligible_series": F.col("repeated_share") <= stale.max_repeated_share})
    return a.withColumn("eligible", F.col("eligible_coverage") & F.col("eligible_trading") & F.col("eligible_series"))


def audit_summary(audit: DataFrame) -> DataFrame:
    return audit.agg(F.count(F.lit(1)).alias("instruments"), F.count_if("eligible").alias("eligible"),
                     F.count_if(~F.col("eligible_coverage")).alias("failed_coverage"),
                     F.count_if(~F.col("eligible_trading")).alias("failed_trading"),
                     F.count_if(~F.col("eligible_series")).alias("failed_series"),
                     F.median("coverage").alias("median_coverage"), F.median("median_trades").alias("median_trades"),
                     F.median("suspect_share").alias("median_suspect_share"))
