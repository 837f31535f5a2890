"""Filings, labels and the network to event P&L."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from leadwake.functions.exact import exact_sum
from leadwake.operators import event_book, events, placebo
from leadwake.session import materialize

ARMS = ("ia_mais_rede", "ia_sem_rede", "rede_sem_ia", "seguidora_aleatoria")


class EventStudy:
    def __init__(self, study, filings: DataFrame, labels: DataFrame, seed: int = 20260812):
        self.study, self.filings, self.labels, self.seed = study, filings, labels, seed

    @cached_property
    def pairs(self) -> DataFrame:
        return self.study.pairs

    @cached_property
    def funnel(self) -> tuple[DataFrame, DataFrame]:
        meta = self.filings.drop("text")
        return events.corpus_funnel(meta, self.study.calendar, self.study.windows, self.pairs)

    @cached_property
    def labelled(self) -> DataFrame:
        return self.funnel[0].join(self.labels, "doc_id")

    @cached_property
    def leader_days(self) -> DataFrame:
        return events.signals_from_labels(self.labelled)

    @cached_property
    def active(self) -> DataFrame:
        return materialize(self.leader_days.filter(~F.col("abstain"))
                           .select("window", "session", "leader", F.col("signal").alias("direction")))

    @cached_property
    def network_signals(self) -> DataFrame:
        return events.network_signals(self.pairs, self.study.estimation, self.study.windows, self.study.calendar)

    @cached_property
    def members(self) -> DataFrame:
        """At most max(bands) rows per window: every leader, follower and random follower is one of them."""
        top = max(self.study.cfg.liquidity.bands)
        return (self.study.selection_with_sector.filter((F.col("reason") == "") & (F.col("final_position") <= top))
                .select("window", "sector", "instrument"))

    def random_pairs(self, replicates: int) -> DataFrame:
        return placebo.random_followers(self.pairs, self.members, replicates, self.seed)

    @cached_property
    def prices(self) -> DataFrame:
        """Written once: the backtest reads the members' prices several times, and no others."""
        named = F.broadcast(self.members.select("instrument").distinct())
        return materialize(self.study.quotes.join(named, "instrument", "left_semi").join(self.study.calendar.select("date", "pos"), "date")
                           .select("instrument", "pos", "open", "close"))

    @cached_property
    def arms(self) -> tuple[DataFrame, DataFrame]:
        """(signals, pairs) of the four arms, told apart by ``arm``."""
        base = self.pairs.select("window", "leader", "follower")
        sets = {ARMS[0]: (self.active, base), ARMS[1]: (self.active, events.self_pairs(self.active)),
                ARMS[2]: (self.network_signals.drop("delivered"), base),
                ARMS[3]: (self.active, self.random_pairs(1).drop("replicate"))}
        sig = par = None
        for arm, (s, p) in sets.items():
            s, p = s.withColumn("arm", F.lit(arm)), p.withColumn("arm", F.lit(arm))
            sig, par = (s, p) if sig is None else (sig.unionByName(s), par.unionByName(p))
        return materialize(sig), materialize(par)

    def run(self, horizons=(3,), rates=None) -> event_book.EventResult:
        sig, par = self.arms
        return event_book.event_backtest(sig, par, self.prices, self.study.calendar, horizons, ("arm",),
                                         self.study.cfg.strategy, self.study.cfg.costs, rates)

    def real_total(self, arm: str = ARMS[0], horizon: int = 3):
        """Net total of one arm as a scalar, summed exactly from its flows."""
        return F.coalesce(self.run((horizon,)).flows.filter(F.col("arm") == arm).agg(exact_sum("net_pnl")).scalar(), F.lit(0.0))

    def randomised_totals(self, replicates: int, horizon: int = 3) -> DataFrame:
        """Net total per randomised network; replicates are a key of one plan.  Totals are exact sums of the flows, so that
        networks with equal positions tie with each other and with the real one, however rows are dealt."""
        rep = self.random_pairs(replicates)
        sig = self.active.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
        r = event_book.event_backtest(sig, rep, self.prices, self.study.calendar, (horizon,), ("replicate",),
                                      self.study.cfg.strategy, self.study.cfg.costs)
        return (r.flows.groupBy("replicate").agg(exact_sum("net_pnl").alias("net_total"), F.count_if(F.col("step") == 1).alias("operations"))
                .join(sig.select("replicate").distinct(), "replicate", "right").fillna(0))
