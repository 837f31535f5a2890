"""Signals to overlapping cohort positions, and the daily book."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leadwake.config import Costs, Strategy

BOOK = ("rule", "mode")


def daily_signals(selected: DataFrame, signal_returns: DataFrame, volatility: DataFrame, windows: DataFrame,
                  cfg: Strategy | None = None) -> DataFrame:
    """One row per (rule, mode, window, session, leader, follower) inside the test window.

    ``status`` keeps the discards: no signal return, no volatility.  Zero returns and, in long
    only, negative ones give no row.
    """
    cfg = cfg or Strategy()
    w = windows.select("window", "test_start", "test_end")
    chosen = selected.select("rule", "window", "leader", "follower").join(w, "window")
    r = signal_returns.select(F.col("instrument").alias("leader"), "date", "pos", "ret")
    hits = (chosen.join(r, "leader")
            .filter((F.col("date") >= F.col("test_start")) & (F.col("date") < F.col("test_end")))
            .withColumn("direction", F.signum("ret"))
            .filter(F.col("ret").isNull() | (F.col("ret") != 0)))
    modes = hits.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in cfg.modes])))
    modes = modes.filter(F.col("ret").isNull() | (F.col("mode") != "long_only") | (F.col("direction") > 0))
    v = volatility.select(F.col("instrument").alias("follower"), "pos", "vol")
    out = modes.join(v, ["follower", "pos"], "left")
    return out.withColumn("status", F.when(F.col("ret").isNull(), "sem_retorno_sinal")
                          .when(F.col("vol").isNull() | (F.col("vol") <= 0), "sem_vol").otherwise("ok"))


def signal_diagnostics(signals: DataFrame) -> DataFrame:
    """Counts per window and book.  Signals count distinct followers per session, as weights do."""
    ok = F.col("status") == "ok"
    return signals.groupBy(*BOOK, "window").agg(
        F.count_distinct(F.when(ok, F.struct("pos", "follower"))).alias("signals"),
        F.count_if(ok).alias("events"),
        F.count_if(F.col("status") == "sem_vol").alias("without_vol"),
        F.count_if(F.col("status") == "sem_retorno_sinal").alias("without_return"))


def cohort_weights(signals: DataFrame, cfg: Strategy | None = None) -> DataFrame:
    """Inverse-volatility weights netted per follower, gross one per cohort, clipped, not rescaled."""
    cfg = cfg or Strategy()
    key = [*BOOK, "window", "pos"]
    raw = (signals.filter(F.col("status") == "ok").groupBy(*key, "follower")
           .agg(F.sum(F.col("direction") / F.col("vol")).alias("raw")))
    gross = raw.groupBy(*key).agg(F.sum(F.abs("raw")).alias("gross"))
    share = F.coalesce(F.try_divide(F.abs("raw"), "gross"), F.lit(0.0))
    return (raw.join(gross, key)
            .select(*key, F.col("follower").alias("instrument"),
                    (F.signum("raw") * F.least(share, F.lit(cfg.max_weight))).alias("weight")))


def overlapping_positions(cohorts: DataFrame, calendar: DataFrame, cfg: Strategy | None = None,
                          execution_lag: int = 1) -> DataFrame:
    """Each cohort is held for k sessions at weight 1/k; sessions past the calendar drop out.

    Windows of one book add up, because a cohort may outlive its test window.
    """
    cfg = cfg or Strategy()
    k = cfg.holding
    steps = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    held = (cohorts.withColumn("step", steps)
            .withColumn("pos", F.col("pos") + F.lit(execution_lag) + F.col("step"))
            .groupBy(*BOOK, "pos", "instrument").agg(F.sum(F.col("weight") / k).alias("weight")))
    return held.join(calendar.select("date", "pos"), "pos")


def book_calendar(positions: DataFrame, calendar: DataFrame) -> DataFrame:
    """Every session for every book: a handful of books times the calendar."""
    books = positions.select(*BOOK).distinct()
    span = calendar.agg(F.min("pos").alias("a"), F.max("pos").alias("b"))
    filled = books.withColumn("pos", F.explode(F.sequence(
        span.select("a").scalar(), span.select("b").scalar())))
    return filled.join(calendar.select("pos", "date"), "pos")


def daily_book(positions: DataFrame, marked: DataFrame, calendar: DataFrame) -> DataFrame:
    """P&L, legs, turnover and exposure per (rule, mode, session).

    Yesterday's weight earns today's marked return.  Turnover pairs each weight with the negated
    weight of the previous session in one union, so one aggregate replaces a self join.
    """
    w = positions.select(*BOOK, "pos", "instrument", "weight")
    shifted = w.withColumn("pos", F.col("pos") + 1)
    earned = shifted.join(marked.select("pos", "instrument", "ret"), ["pos", "instrument"], "left")
    gain = F.col("weight") * F.coalesce("ret", F.lit(0.0))
    pnl = earned.groupBy(*BOOK, "pos").agg(
        F.sum(gain).alias("gross_pnl"),
        F.sum(F.when(F.col("weight") > 0, gain).otherwise(0.0)).alias("long_leg"),
        F.sum(F.when(F.col("weight") < 0, gain).otherwise(0.0)).alias("short_leg"),
        F.count_if((F.col("weight") != 0) & F.col("ret").isNull()).alias("missing_returns"))
    moves = (w.unionByName(shifted.withColumn("weight", -F.col("weight")))
             .groupBy(*BOOK, "pos", "instrument").agg(F.sum("weight").alias("delta"))
             .groupBy(*BOOK, "pos").agg(F.sum(F.abs("delta")).alias("turnover")))
    exposure = w.groupBy(*BOOK, "pos").agg(
        F.sum(F.abs("weight")).alias("gross_exposure"), F.sum("weight").alias("net_exposure"),
        F.sum(F.abs(F.least("weight", F.lit(0.0)))).alias("short_exposure"))
    key = [*BOOK, "pos"]
    out = book_calendar(positions, calendar)
    for part in (pnl, moves, exposure):
        out = out.join(part, key, "left")
    values = [c for c in out.columns if c not in (*key, "date")]
    return out.fillna(0, subset=values)


def with_costs(book: DataFrame, cfg: Costs | None = None, rate: float | None = None) -> DataFrame:
    """Turnover cost, borrow on the short side pro rata, and net P&L (never above gross)."""
    cfg = cfg or Costs()
    r = cfg.borrow_base if rate is None else rate
    return (book.withColumns({
        "turnover_cost": F.abs("turnover") * cfg.one_way_bps / 1e4,
        "borrow_cost": F.col("short_exposure") * r / cfg.days_per_year})
        .withColumn("net_pnl", F.col("gross_pnl") - F.col("turnover_cost") - F.col("borrow_cost")))


def borrow_scenarios(book: DataFrame, cfg: Costs | None = None) -> DataFrame:
    """Net P&L under every borrow rate, long form."""
    cfg = cfg or Costs()
    rates = book.withColumn("rate", F.explode(F.array(*[F.lit(float(x)) for x in cfg.borrow_scenarios])))
    net = (F.col("gross_pnl") - F.abs("turnover") * cfg.one_way_bps / 1e4
           - F.col("short_exposure") * F.col("rate") / cfg.days_per_year)
    return rates.withColumn("net_pnl", net).select(*BOOK, "pos", "date", "rate", "net_pnl")


def illustrative_tax(book: DataFrame, value: str = "net_pnl", cfg: Costs | None = None) -> DataFrame:
    """Tax on positive years, without carrying losses over."""
    cfg = cfg or Costs()
    y = book.groupBy(*BOOK, F.year("date").alias("year")).agg(F.sum(value).alias("annual"))
    return y.withColumn("after_tax", F.col("annual") - F.greatest("annual", F.lit(0.0)) * cfg.illustrative_tax)
