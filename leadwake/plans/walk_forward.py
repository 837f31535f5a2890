"""The walk-forward program: windows, rules and modes are columns, never driver loops."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from leadwake.config import Settings
from leadwake.operators import discovery, pairs as pair_ops, placebo, positions, regression, returns, rolling_network, sessions, universe
from leadwake.session import materialize


class Study:
    """Lazy stage tables of one study.  Each property is a plan over the quotes."""

    def __init__(self, quotes: DataFrame, sector_table: DataFrame, cfg: Settings, min_instruments: int = 20,
                 windows: DataFrame | None = None, written: bool = False):
        """``written`` says the quotes are already a stored table; otherwise they are stored once,
        because the calendar, the ranking and the returns all read them."""
        self._source, self._written, self.sector_table = quotes, written, sector_table
        self.cfg = cfg
        self.min_instruments = min_instruments
        self._windows = windows

    @property
    def spark(self) -> SparkSession:
        return self._source.sparkSession

    @cached_property
    def quotes(self) -> DataFrame:
        return self._source if self._written else materialize(self._source)

    @cached_property
    def windows(self) -> DataFrame:
        if self._windows is not None:
            return self._windows
        p = self.cfg.period
        return sessions.windows_of_period(self.quotes, p.start, p.end, self.cfg.walk_forward)

    @cached_property
    def calendar(self) -> DataFrame:
        return materialize(sessions.session_calendar(self.quotes.select("date", "instrument"), self.min_instruments))

    @cached_property
    def panel(self) -> DataFrame:
        return returns.panel(self.quotes, self.calendar)

    @cached_property
    def selection(self) -> DataFrame:
        return materialize(universe.select_universe(self.quotes, self.windows, self.cfg.liquidity))

    @cached_property
    def selection_with_sector(self) -> DataFrame:
        return pair_ops.with_sector_in_force(self.selection, self.sector_table)

    @cached_property
    def all_pairs(self) -> DataFrame:
        """Written once: every later stage reads it, and it is small (bounded by the bands)."""
        return materialize(pair_ops.candidate_pairs(self.selection_with_sector, self.cfg.liquidity.bands))

    @cached_property
    def pairs(self) -> DataFrame:
        return pair_ops.pairs_within(self.all_pairs, self.cfg.liquidity)

    @cached_property
    def member_panel(self) -> DataFrame:
        """Panel of the instruments that appear in a pair; everything else never reaches returns."""
        named = (self.all_pairs.select(F.explode(F.array("leader", "follower")).alias("instrument")).distinct())
        members = F.broadcast(named)  # at most max(bands) x windows rows
        return returns.panel(self.quotes.join(members, "instrument", "left_semi"), self.calendar)

    @cached_property
    def estimation(self) -> DataFrame:
        return returns.estimation_returns(self.member_panel)

    @cached_property
    def slices(self) -> DataFrame:
        return materialize(regression.member_returns(self.estimation, self.pairs, self.windows))

    @cached_property
    def network(self) -> DataFrame:
        c = self.cfg.lead_lag
        return regression.network_from_slices(self.slices, self.pairs, c, (c.lag,))

    @cached_property
    def controlled(self) -> DataFrame:
        """Written once: all rules and modes derive from the same frozen network."""
        return materialize(discovery.control_discoveries(self.network, self.cfg.discovery))

    @cached_property
    def selected(self) -> DataFrame:
        return discovery.select_pairs(self.controlled, cfg=self.cfg.discovery)

    def network_of_months(self, lengths: Sequence[int]) -> DataFrame:
        """Networks of several training lengths: universes and pairs of all their windows in one plan, moments in one pass.

        ``months`` names the length; window labels carry it too, as test periods of several lengths share their names.
        """
        p = self.cfg.period
        windows = None
        for m in lengths:
            some = sessions.walk_forward_windows(self.spark, p.start, p.end, self.cfg.walk_forward, m).withColumn("window", F.concat(F.lit(f"{m}|"), "window"))
            windows = some if windows is None else windows.unionByName(some)
        chosen = pair_ops.with_sector_in_force(universe.select_universe(self.quotes, windows, self.cfg.liquidity), self.sector_table)
        pairs = materialize(pair_ops.pairs_within(pair_ops.candidate_pairs(chosen, self.cfg.liquidity.bands), self.cfg.liquidity))
        named = pairs.select(F.explode(F.array("leader", "follower")).alias("instrument")).distinct()
        r = returns.estimation_returns(returns.panel(self.quotes.join(named, "instrument", "left_semi"), self.calendar))
        c = self.cfg.lead_lag
        found = rolling_network.network_of_lengths(r, pairs, windows, c.lag, c.hac_lags, c.min_observations)
        label = F.split("window", r"\|")
        return found.withColumns({"months": label[0].cast("int"), "window": label[1]})

    # ---- placebo ---------------------------------------------------------------------------

    @cached_property
    def ordered_betas(self) -> DataFrame:
        """Betas of every ordered pair of the groups: real pairs and all shuffles look up here."""
        every = pair_ops.ordered_pairs(self.selection_with_sector, self.cfg.liquidity.bands)
        sliced = regression.member_returns(self.estimation, every, self.windows)
        c = self.cfg.lead_lag
        return regression.batch_betas(sliced, every, c.lag, c.min_observations)

    def placebo(self, replicates: int | None = None) -> tuple[DataFrame, DataFrame]:
        c = self.cfg.placebo
        betas = materialize(self.ordered_betas)
        shuffled = placebo.shuffled_pairs(self.pairs, replicates or c.replicates, self.cfg.seed, c.max_attempts)
        dist = placebo.placebo_distribution(shuffled, betas)
        real = self.pairs.select("window", "leader", "follower").join(betas, ["window", "leader", "follower"], "left")
        return dist, placebo.placebo_summary(dist, real)

    # ---- positions and P&L -------------------------------------------------------------------

    @cached_property
    def last_pos(self):
        return self.calendar.agg(F.max("pos")).scalar()

    @cached_property
    def marked(self) -> DataFrame:
        """Marked returns of the members on every session from their first price on."""
        rows = returns.marked_returns(self.member_panel).select("instrument", "pos", "ret", "close")
        return returns.fill_sessions(rows, self.last_pos, ("ret",))

    @cached_property
    def volatility(self) -> DataFrame:
        return returns.realized_volatility(self.marked, self.cfg.strategy.volatility_window,
                                           self.cfg.costs.days_per_year)

    @cached_property
    def signals(self) -> DataFrame:
        return positions.daily_signals(self.selected, self.estimation, self.volatility, self.windows, self.cfg.strategy)

    @cached_property
    def cohorts(self) -> DataFrame:
        return positions.cohort_weights(self.signals, self.cfg.strategy)

    @cached_property
    def positions(self) -> DataFrame:
        """Written once: P&L, turnover, exposure and crossings all start here."""
        return materialize(positions.overlapping_positions(
            self.cohorts, self.calendar, self.cfg.strategy, self.cfg.walk_forward.execution_lag))

    @cached_property
    def book(self) -> DataFrame:
        return materialize(positions.with_costs(
            positions.daily_book(self.positions, self.marked, self.calendar), self.cfg.costs))

    @cached_property
    def boundaries(self) -> DataFrame:
        return returns.event_boundaries(self.member_panel)

    def summary(self) -> DataFrame:
        """Totals per (rule, mode), with event crossings of the held positions."""
        totals = self.book.groupBy("rule", "mode").agg(
            F.sum("gross_pnl").alias("gross_total"), F.sum("net_pnl").alias("net_total"),
            F.avg("turnover").alias("mean_turnover"), F.sum("missing_returns").alias("missing_returns"))
        hit = self.boundaries.filter("boundary").select("date", "instrument", F.lit(1).alias("hit"))
        crossed = (self.positions.filter(F.col("weight") != 0).join(hit, ["date", "instrument"], "left")
                   .groupBy("rule", "mode").agg(F.count(F.lit(1)).alias("position_days"), F.count("hit").alias("crossings")))
        return totals.join(crossed, ["rule", "mode"], "left")
