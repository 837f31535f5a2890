"""Return and panel operators on sparse (date, instrument) rows.

The wide date x instrument panel is never built.  A row's neighbour in the panel is its own
previous row if and only if calendar positions differ by one, so gaps stay gaps without a
calendar x instrument product.  Where a value is due on a day without a quote, ``fill_sessions``
expands each row up to the next one, which is linear in the result.

All windows are partitioned by instrument and ordered by position; an instrument has at most
one row per session, so a partition is bounded by the calendar length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from leadwake.functions.scalars import event_token

def by_instrument():
    return W.partitionBy("instrument").orderBy("pos")


def panel(quotes: DataFrame, calendar: DataFrame) -> DataFrame:
    """One row per (session, instrument): last price, volume, trades, specification.

    Quotes are unique per (date, instrument), which the value audit enforces, so attaching the
    calendar position is all there is to do: no aggregate, no extra shuffle.
    """
    return (quotes.select("date", "instrument", "close", "volume", "trades", "spec")
            .join(calendar.select("date", "pos"), "date"))


def previous(col: Column | str) -> Column:
    """Value on the previous *session*; null when the instrument has no row there."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.lag("pos").over(by_instrument()) == F.col("pos") - 1, F.lag(c).over(by_instrument()))


def simple_returns(panel: DataFrame, price: str = "close") -> DataFrame:
    """p(t)/p(t-1)-1 between consecutive sessions; non-positive prices are missing."""
    p = F.when(F.col(price) > 0, F.col(price))
    return (panel.withColumn("__p", p)
            .withColumn("ret", F.col("__p") / previous("__p") - 1).drop("__p"))


def log_returns(panel: DataFrame, price: str = "close") -> DataFrame:
    p = F.when(F.col(price) > 0, F.col(price))
    return (panel.withColumn("__p", p)
            .withColumn("log_ret", F.log(F.col("__p") / previous("__p"))).drop("__p"))


def traded_both_sessions() -> Column:
    """True where the instrument traded on this session and on the previous one."""
    traded = F.coalesce(F.col("volume") > 0, F.lit(False))
    return traded & F.coalesce(previous(traded), F.lit(False))


def event_boundaries(panel: DataFrame) -> DataFrame:
    """Event token and the sessions on which it changes to a new non-empty token."""
    tok = panel.withColumn("token", F.coalesce(event_token(F.col("spec")), F.lit("")))
    prev = F.coalesce(previous("token"), F.lit(""))
    return tok.withColumn("boundary", (F.col("token") != "") & (F.col("token") != prev))


def estimation_returns(panel: DataFrame, mask_next_session: bool = False) -> DataFrame:
    """Returns for estimation: event boundaries and untraded sessions removed."""
    marked = event_boundaries(panel)
    blocked = F.col("boundary")
    if mask_next_session:
        blocked = blocked | F.coalesce(previous("boundary"), F.lit(False))
    raw = simple_returns(marked)
    keep = ~blocked & traded_both_sessions()
    return raw.withColumn("ret", F.when(keep, F.col("ret")))


def marked_returns(panel: DataFrame) -> DataFrame:
    """P&L returns marked to the last traded price.

    On sessions without a trade the return is zero and is left implicit; the first trade after
    a gap carries the whole move.  Rows without a valid price are dropped before the lag.
    """
    traded = panel.filter(F.col("close") > 0)
    return traded.withColumn("ret", F.col("close") / F.lag("close").over(by_instrument()) - 1)


def fill_sessions(rows: DataFrame, last_pos: Column | int, value_zero: tuple[str, ...] = ()) -> DataFrame:
    """Expand each row over the sessions up to the instrument's next row (or ``last_pos``).

    Columns in ``value_zero`` are set to zero on the filled sessions, all others carry forward.
    """
    stop = F.coalesce(F.lead("pos").over(by_instrument()) - 1, F.lit(last_pos) if isinstance(last_pos, int) else last_pos)
    spread = (rows.withColumn("__stop", F.greatest(stop, F.col("pos")))
              .withColumn("__at", F.explode(F.sequence("pos", "__stop"))))
    for c in value_zero:
        spread = spread.withColumn(c, F.when(F.col("__at") == F.col("pos"), F.col(c)).otherwise(F.lit(0.0)))
    return spread.withColumn("filled", F.col("__at") > F.col("pos")).drop("pos", "__stop").withColumnRenamed("__at", "pos")


def volumes_in_reach(panel: DataFrame, calendar: DataFrame, window: int) -> DataFrame:
    """(instrument, pos, date, volume) of every session that a trailing window with a quote can end on; volume is null without a quote."""
    last = calendar.agg(F.max("pos")).scalar()
    due = fill_sessions(panel.select("instrument", "pos", "volume"), F.least(last, F.col("pos") + (window - 1)))
    due = due.withColumn("volume", F.when(~F.col("filled"), F.col("volume"))).drop("filled")
    return due.join(calendar.select("pos", "date"), "pos")


def _trailing(window: int) -> W:
    return W.partitionBy("instrument").orderBy("pos").rangeBetween(-(window - 1), 0)


def median_liquidity(panel: DataFrame, window: int, min_obs: int | None = None) -> DataFrame:
    """Rolling median volume over the last ``window`` sessions (frame on calendar positions)."""
    need = min_obs or max(1, window // 2)
    w = _trailing(window)
    return panel.withColumn("liquidity", F.when(
        F.count("volume").over(w) >= need, F.percentile("volume", F.lit(0.5)).over(w)))


def traded_share(panel: DataFrame, window: int) -> DataFrame:
    """Rolling share of quoted sessions that traded; missing volumes are ignored."""
    traded = F.when(F.col("volume").isNotNull(), (F.col("volume") > 0).cast("double"))
    return panel.withColumn("traded_share", F.avg(traded).over(_trailing(window)))


def realized_volatility(returns: DataFrame, window: int, days_per_year: int = 252,
                        min_obs: int | None = None, annualize: bool = True) -> DataFrame:
    """Rolling sample deviation of the last ``window`` sessions; expects one row per session."""
    need = min_obs or max(2, window // 2)
    w = _trailing(window)
    scale = F.sqrt(F.lit(float(days_per_year))) if annualize else F.lit(1.0)
    return returns.withColumn("vol", F.when(
        F.count("ret").over(w) >= need, F.stddev_samp("ret").over(w) * scale))


def event_crossings(positions: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Position-days, how many of them sit on an event boundary, and the share."""
    held = positions.filter(F.col("weight") != 0)
    hit = boundaries.filter("boundary").select("date", "instrument", F.lit(1).alias("hit"))
    return (held.join(hit, ["date", "instrument"], "left")
            .agg(F.count(F.lit(1)).alias("position_days"), F.count("hit").alias("crossings"))
            .withColumn("share", F.coalesce(F.try_divide("crossings", "position_days"), F.lit(0.0))))


def benchmark_returns(prices: DataFrame, price: str = "close") -> DataFrame:
    """Benchmark series over its observed rows (a calendar-sized table)."""
    w = W.orderBy("date")
    return prices.select("date", (F.col(price) / F.lag(price).over(w) - 1).alias("bench"))


def stale_days(panel: DataFrame, windows: DataFrame, cfg) -> DataFrame:
    """Sessions of likely stale prices inside each training window.

    The low-volume cut is the instrument's own percentile inside the window, compared strictly.
    Runs of equal closes restart at the window's first session.
    """
    from leadwake.operators.sessions import in_windows

    by = W.partitionBy("window", "instrument")
    seq = by.orderBy("pos")
    rows = in_windows(panel, windows, "train")
    cut = F.percentile(F.when(F.col("volume") > 0, F.col("volume")), F.lit(cfg.low_volume_percentile)).over(by)
    same = F.coalesce((F.lag("pos").over(seq) == F.col("pos") - 1) & (F.lag("close").over(seq) == F.col("close")),
                      F.lit(False))
    runs = (rows.withColumns({"low_cut": cut, "same": same})
            .withColumn("island", F.sum(F.when(F.col("same"), 0).otherwise(1)).over(seq)))
    length = F.row_number().over(W.partitionBy("window", "instrument", "island").orderBy("pos"))
    few = F.coalesce(F.col("trades") < cfg.min_trades, F.lit(False))
    none = ~F.coalesce(F.col("volume") > 0, F.lit(False))
    rare = F.coalesce(F.col("volume") < F.col("low_cut"), F.lit(False))
    return (runs.withColumn("stale", few | none | rare | (length >= cfg.max_equal_closes))
            .drop("island", "same", "low_cut"))


def drop_stale(returns: DataFrame, stale: DataFrame) -> DataFrame:
    """Window returns with the marked session and the following one set to null.

    A session without a row has no volume and counts as stale, so a return whose previous
    session is absent is already null.
    """
    seq = W.partitionBy("window", "instrument").orderBy("pos")
    before = F.when(F.lag("pos").over(seq) == F.col("pos") - 1, F.lag("stale").over(seq))
    marked = stale.select("window", "instrument", "pos", (
        F.col("stale") | F.coalesce(before, F.lit(False))).alias("bad"))
    joined = returns.join(marked, ["window", "instrument", "pos"], "left")
    return joined.withColumn("ret", F.when(~F.coalesce("bad", F.lit(False)), F.col("ret"))).drop("bad")
