"""Event backtest: fan-out, netting, price gate, per-session flows.  Arms, horizons and borrow
rates are columns of one plan, so all runs share the joins."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Window as W, functions as F

from leadwake.config import Costs, Strategy
from leadwake.functions.exact import exact_sum
from leadwake.functions.scalars import valid_price

NO_FOLLOWERS = "lider_sem_seguidoras_estruturais"
OUTSIDE_CALENDAR = "sessao_disponivel_fora_do_calendario"
PAST_END = "holding_ultrapassa_fim_do_calendario"
NET_ZERO = "contribuicao_liquida_zero_na_coorte"
NO_ENTRY = "preco_entrada_ausente_ou_suspensao"
NO_CLOSE = "preco_fechamento_ausente_ou_suspensao"
# Fixed value.  Nets are summed exactly; what is left of parts that cancel, such as 1/3 + 1/3 + 1/3 - 1, is the rounding of 1/3.
ZERO_NET = 1e-15


class EventResult(NamedTuple):
    candidates: DataFrame
    operations: DataFrame
    flows: DataFrame
    daily: DataFrame
    diagnostics: DataFrame


def event_backtest(signals: DataFrame, pairs: DataFrame, prices: DataFrame, calendar: DataFrame,
                   horizons: Sequence[int] = (3,), keys: Sequence[str] = ("arm",), strategy: Strategy | None = None,
                   costs: Costs | None = None, rates: Sequence[float] | None = None) -> EventResult:
    """``signals``: keys, window, session, leader, direction.  ``pairs``: keys, window, leader, follower.
    ``prices``: instrument, pos, open, close.  A signal is identified by window, session and leader."""
    strategy, costs = strategy or Strategy(), costs or Costs()
    rates = (costs.borrow_base,) if rates is None else tuple(rates)
    k = list(keys)
    run = [*k, "h"]
    n_cal = calendar.agg(F.count(F.lit(1))).scalar()
    cal = calendar.select(F.col("date").alias("session"), F.col("pos").alias("start"))
    edges = pairs.select(*k, "window", "leader", "follower").distinct()
    width = edges.groupBy(*k, "window", "leader").agg(F.count(F.lit(1)).alias("followers"))
    sig = (signals.select(*k, "window", "session", "leader", "direction")
           .withColumn("h", F.explode(F.array(*[F.lit(int(h)) for h in horizons])))
           .join(cal, "session", "left").join(width, [*k, "window", "leader"], "left"))
    why = (F.when(F.col("start").isNull(), OUTSIDE_CALENDAR).when(F.col("start") + F.col("h") > n_cal, PAST_END)
           .when(F.col("followers").isNull(), NO_FOLLOWERS))
    sig = sig.withColumn("reason", why)
    diag_signal = sig.filter("reason is not null").select(*run, "window", "session", "leader", F.lit(None).cast("string").alias("follower"),
                                                          F.lit(1).cast("long").alias("signals"), "reason")
    parts = (sig.filter("reason is null").join(edges, [*k, "window", "leader"])
             .withColumn("part", F.col("direction") / F.col("followers")))
    cohort = [*run, "window", "session", "start"]
    # Origins of a netted position: at most one per leader of the window, so the list is bounded.
    origin = F.array_sort(F.collect_list(F.struct("leader", "part")))
    net = parts.groupBy(*cohort, "follower").agg(exact_sum("part").alias("net"), F.count(F.lit(1)).alias("signals"), origin.alias("origins"))
    zero = F.abs("net") <= ZERO_NET
    diag_zero = net.filter(zero).select(*run, "window", "session", F.when(F.size("origins") == 1, F.col("origins")[0]["leader"]).alias("leader"),
                                        "follower", "signals", F.lit(NET_ZERO).alias("reason"))
    by = W.partitionBy(*run, "window", "session")
    live = net.filter(~zero).withColumn("gross_before", exact_sum(F.abs("net"), by))
    live = live.withColumn("normalised", F.col("net") / F.col("gross_before"))
    live = live.withColumn("capped", F.signum("normalised") * F.least(F.abs("normalised"), F.lit(strategy.max_weight)))
    live = live.withColumns({"gross_after": exact_sum(F.abs("capped"), by), "weight": F.col("capped") / F.col("h")})

    p = prices.select(F.col("instrument").alias("follower"), "pos", "open", "close")
    steps = (live.withColumn("step", F.explode(F.sequence(F.lit(1), F.col("h")))).withColumn("pos", F.col("start") + F.col("step") - 1)
             .join(p, ["follower", "pos"], "left").join(calendar.select("pos", "date"), "pos"))
    op = [*cohort, "follower"]
    gate = steps.groupBy(*op).agg(
        F.max(F.when((F.col("step") == 1) & valid_price(F.col("open")), F.col("open"))).alias("entry"),
        F.count_if(~valid_price(F.col("close"))).alias("bad_closes"),
        F.max(F.when(F.col("step") == F.col("h"), F.col("close"))).alias("exit"),
        F.min("date").alias("entry_date"), F.max("date").alias("exit_date"))
    priced = live.join(gate, op)
    cause = F.when(F.col("entry").isNull(), NO_ENTRY).when(F.col("bad_closes") > 0, NO_CLOSE)
    priced = priced.withColumn("reason", cause)
    diag_price = priced.filter("reason is not null").select(
        *run, "window", "session", F.when(F.size("origins") == 1, F.col("origins")[0]["leader"]).alias("leader"), "follower", "signals", "reason")
    held = priced.filter("reason is null").drop("reason", "bad_closes")

    side = costs.one_way_bps / 1e4
    seq = W.partitionBy(*op).orderBy("step")
    live_steps = steps.join(held.select(*op, "entry"), op).withColumn(
        "from_price", F.when(F.col("step") == 1, F.col("entry")).otherwise(F.lag("close").over(seq)))
    fl = live_steps.withColumn("rate", F.explode(F.array(*[F.lit(float(r)) for r in rates])))
    gain = F.col("weight") * (F.col("close") - F.col("from_price")) / F.col("entry")
    cost = F.abs("weight") * side
    flows = fl.select(*run, "rate", "window", "session", "follower", "date", "pos", "step", "from_price", F.col("close").alias("to_price"), "weight",
                      (F.col("close") / F.col("from_price") - 1).alias("asset_return"),
                      F.when(F.col("step") == 1, gain).otherwise(0.0).alias("open_close_pnl"),
                      F.when(F.col("step") > 1, gain).otherwise(0.0).alias("close_close_pnl"), gain.alias("gross_pnl"),
                      F.when(F.col("step") == 1, cost).otherwise(0.0).alias("entry_cost"),
                      F.when(F.col("step") == F.col("h"), cost).otherwise(0.0).alias("exit_cost"),
                      F.when(F.col("weight") < 0, F.abs("weight") * F.col("rate") / costs.days_per_year).otherwise(0.0).alias("borrow_cost"))
    flows = flows.withColumn("turnover_cost", F.col("entry_cost") + F.col("exit_cost"))
    flows = flows.withColumn("net_pnl", F.col("gross_pnl") - F.col("turnover_cost") - F.col("borrow_cost"))
    money = ("open_close_pnl", "close_close_pnl", "gross_pnl", "entry_cost", "exit_cost", "turnover_cost", "borrow_cost", "net_pnl")
    sums = flows.groupBy(*run, "rate", "window", "session", "follower").agg(*[exact_sum(c).alias(c) for c in money])
    operations = (held.join(sums, [*run, "window", "session", "follower"])
                  .withColumn("direction", F.when(F.col("weight") > 0, 1).otherwise(-1)).drop("start"))
    # Positions net per follower before exposures are taken.
    per_name = flows.groupBy(*run, "rate", "pos", "follower").agg(
        exact_sum("weight").alias("w"), F.count(F.lit(1)).alias("ops"), *[exact_sum(c).alias(c) for c in money])
    day = per_name.groupBy(*run, "rate", "pos").agg(
        *[exact_sum(c).alias(c) for c in money], F.sum("ops").alias("operations"), exact_sum(F.abs("w")).alias("gross_exposure"), exact_sum("w").alias("net_exposure"))
    runs = sig.select(*run).distinct().withColumn("rate", F.explode(F.array(*[F.lit(float(r)) for r in rates])))
    grid = runs.withColumn("pos", F.explode(F.sequence(F.lit(0).cast("long"), n_cal - 1))).join(calendar.select(F.col("pos").cast("long").alias("pos"), "date"), "pos")
    daily = grid.join(day, [*run, "rate", "pos"], "left").fillna(0, [*money, "operations", "gross_exposure", "net_exposure"])
    return EventResult(live, operations, flows, daily, diag_signal.unionByName(diag_zero).unionByName(diag_price))


def event_summary(signals: DataFrame, result: EventResult, keys: Sequence[str] = ("arm",)) -> DataFrame:
    """Counts and totals per run and borrow rate."""
    run = [*keys, "h"]
    d = result.daily.groupBy(*run, "rate").agg(
        *[exact_sum(c).alias(n) for c, n in (("gross_pnl", "gross_total"), ("net_pnl", "net_total"), ("turnover_cost", "turnover_cost_total"), ("borrow_cost", "borrow_cost_total"))], F.max("gross_exposure").alias("max_gross_exposure"),
        F.count_if(F.col("operations") > 0).alias("active_days"))
    o = result.operations.groupBy(*run, "rate").agg(F.count(F.lit(1)).alias("operations"), F.count_distinct("session").alias("cohorts_traded"))
    g = result.diagnostics.groupBy(*run).agg(F.count(F.lit(1)).alias("diagnostics"), F.count_if(F.col("reason") == NET_ZERO).alias("net_zero"))
    s = signals.groupBy(*keys).agg(F.count(F.lit(1)).alias("signals"), F.count_distinct("session").alias("cohorts"))
    return (d.join(o, [*run, "rate"], "left").join(g, run, "left").join(s, list(keys), "left")
            .fillna(0, ["operations", "cohorts_traded", "diagnostics", "net_zero"]))
