"""Audit of the event mask at five grains from one pass: window and band, band, window, support per instrument, alerts.

A day of an instrument is candidate, removed, usable in the record or usable in the reference.  Days become one state per
(instrument, test window) in a map-side combined aggregate; every table is a sum or a share of these states.  Bands are
nested, so a state is counted from its smallest band upwards: a state is at most repeated once per band.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from leadwake.operators.returns import event_boundaries, simple_returns, traded_both_sessions
from leadwake.operators.sessions import in_windows
from leadwake.session import materialize

# Share of removed returns and coverage of a band beyond which a window is reported.
MAX_REMOVED_SHARE, MIN_COVERAGE = 0.15, 0.90


def day_states(panel: DataFrame, reference_returns: DataFrame, windows: DataFrame) -> DataFrame:
    """instrument, window (null outside of test windows): candidates, removed, record, reference, common, stored."""
    days = simple_returns(event_boundaries(panel)).withColumn("both", traded_both_sessions())
    ref = reference_returns.select("instrument", "date", F.col("ret").alias("ref"))
    joined = days.join(ref, ["instrument", "date"], "left")
    candidate = F.col("both") & F.col("ret").isNotNull()
    flags = joined.select("instrument", "date", candidate.alias("candidate"), (candidate & F.col("boundary")).alias("removed"),
                          (candidate & ~F.col("boundary")).alias("kept"), (F.col("both") & F.col("ref").isNotNull()).alias("referenced"))
    placed = in_windows(windows.select("window", "test_start", "test_end").withColumn("date", F.explode(F.sequence("test_start", F.date_sub("test_end", 1)))).select("date").distinct(), windows, "test").select("date", "window")
    return materialize(flags.join(placed, "date", "left").groupBy("instrument", "window").agg(
        F.count_if("candidate").alias("candidates"), F.count_if("removed").alias("removed"), F.count_if("kept").alias("record"),
        F.count_if("referenced").alias("reference"), F.count_if(F.col("kept") & F.col("referenced")).alias("common")))


def by_window_and_band(states: DataFrame, ranking: DataFrame, bands: Sequence[int]) -> DataFrame:
    """One row per window and band: the band's names, their returns, the removed share, and the names with a return in either source."""
    names = ranking.filter(F.col("eligible") & (F.col("position") <= max(bands))).select("window", "instrument", "position")
    joined = names.join(states.filter("window is not null"), ["window", "instrument"], "left")
    nested = joined.withColumn("band", F.explode(F.filter(F.array(*[F.lit(b) for b in bands]), lambda b: b >= F.col("position"))))
    g = nested.groupBy("window", "band").agg(
        F.count(F.lit(1)).alias("selected"), F.coalesce(F.sum("candidates"), F.lit(0)).alias("candidates"), F.coalesce(F.sum("removed"), F.lit(0)).alias("removed"),
        F.count_if(F.col("record") > 0).alias("with_record"), F.count_if(F.col("reference") > 0).alias("with_reference"))
    return g.withColumns({"removed_share": F.round(F.try_divide("removed", "candidates"), 4), "record_coverage": F.round(F.col("with_record") / F.col("selected"), 4),
                          "reference_coverage": F.round(F.col("with_reference") / F.col("selected"), 4)})


def band_summary(audit: DataFrame) -> DataFrame:
    return audit.groupBy("band").agg(
        F.avg("removed_share").alias("removed_mean"), F.max("removed_share").alias("removed_max"), F.min("record_coverage").alias("record_min"), F.median("record_coverage").alias("record_median"),
        F.min("reference_coverage").alias("reference_min"), F.median("reference_coverage").alias("reference_median"))


def window_summary(audit: DataFrame) -> DataFrame:
    return audit.groupBy("window").agg(F.avg("removed_share").alias("removed_mean"), F.min("record_coverage").alias("record_min"), F.min("reference_coverage").alias("reference_min"))


def common_support(states: DataFrame) -> DataFrame:
    """Per instrument: usable returns of the record, of the reference, of both, and the common share of the record."""
    g = states.groupBy("instrument").agg(F.sum("record").alias("record"), F.sum("reference").alias("reference"), F.sum("common").alias("common"))
    return g.withColumn("common_share", F.try_divide("common", "record"))


def alerts(audit: DataFrame, max_removed: float = MAX_REMOVED_SHARE, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(window, band, alert): each window and band over the limit of removal or under that of coverage, a row per breach."""
    found = F.array_compact(F.array(F.when(F.col("removed_share") > max_removed, F.lit("remocao_acima_do_limite")), F.when(F.col("record_coverage") < min_coverage, F.lit("cobertura_abaixo_do_limite"))))
    return audit.select("window", "band", F.explode(found).alias("alert"))
