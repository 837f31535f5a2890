"""Queries over the estimated network, placebos, positions, costs and inference."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from leadwake.operators import (checks, discovery, inference, pairs as pair_ops, placebo, positions, regression, reports,
                                returns, universe)
from leadwake.oracle import market_ctes  # noqa: F401
from leadwake.oracle.ctes import bh, network, of_length, ols, xy_rows
from leadwake.plans.registry import register

NET = ("win<window:s sector:s subsector:s leader:s follower:s min_band:i leader_position:i follower_position:i direction:s "
       "beta:f std_error:f t_stat:f p_value:f alpha:f r2:f n:i lag:i first_date:d last_date:d")

# ---- estimation -----------------------------------------------------------------------------
register("est_01_pair_regression", "win<window:s leader:s follower:s n:i beta:f alpha:f r2:f",
         lambda c: regression.least_squares(regression.paired_rows(c.study.slices, c.study.pairs, [1]),
                                            ["window", "leader", "follower", "lag"], "HAC", 2, min_obs=12),
         "SELECT * FROM x_ols")
register("est_02_hac_errors", "win<window:s leader:s follower:s std_error:f t_stat:f p_value:f alpha_t:f alpha_p:f",
         lambda c: regression.least_squares(regression.paired_rows(c.study.slices, c.study.pairs, [1]),
                                            ["window", "leader", "follower", "lag"], "HAC", 2, min_obs=12),
         "SELECT * FROM x_ols")
register("est_02_hc3_errors", "win<window:s leader:s follower:s n:i std_error:f t_stat:f",
         lambda c: regression.least_squares(regression.paired_rows(c.study.slices, c.study.pairs, [1]),
                                            ["window", "leader", "follower", "lag"], "HC3", min_obs=12),
         """SELECT win, leader, follower, n, se AS std_error, beta / nullif(se, 0) AS t_stat FROM (
              SELECT win, leader, follower, n, CASE WHEN n >= 12 THEN beta END AS beta, CASE WHEN n >= 12 THEN sqrt(s) / nullif(sxx, 0) END AS se FROM (
                SELECT win, leader, follower, any_value(n) AS n, any_value(beta) AS beta, any_value(sxx) AS sxx,
                       sum(((y - my - beta*(x - mx)) * (x - mx) / nullif(1 - (1/n + (x - mx)*(x - mx)/nullif(sxx, 0)), 0))^2) AS s
                FROM (SELECT r.*, count(*) OVER g AS n, avg(x) OVER g AS mx, avg(y) OVER g AS my, var_pop(x) OVER g * count(*) OVER g AS sxx,
                             covar_pop(y, x) OVER g / nullif(var_pop(x) OVER g, 0) AS beta
                      FROM x_xy r WINDOW g AS (PARTITION BY win, leader, follower)) GROUP BY ALL))""")
register("est_02_classical_errors", "win<window:s leader:s follower:s n:i std_error:f t_stat:f p_value:f",
         lambda c: regression.least_squares(regression.paired_rows(c.study.slices, c.study.pairs, [1]),
                                            ["window", "leader", "follower", "lag"], "nonrobust", min_obs=12),
         """SELECT win, leader, follower, n, std_error, t_stat, CASE WHEN t_stat IS NOT NULL THEN greatest(0, 1 - CASE WHEN (n - 2) % 2 = 1
                THEN (o + sin(o) * cos(o) * coalesce(list_sum(list_transform(range(0, (n - 3) // 2), lambda k: exp(lgamma(k + 1) + lgamma(1.5) - lgamma(k + 1.5) + 2 * k * ln(cos(o))))), 0)) * 2 / pi()
                ELSE sin(o) * list_sum(list_transform(range(0, (n - 2) // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1) + 2 * k * ln(cos(o))))) END) END AS p_value
            FROM (SELECT *, atan(abs(t_stat) / sqrt(n - 2)) AS o FROM (SELECT win, leader, follower, n, se AS std_error, beta / nullif(se, 0) AS t_stat FROM (
              SELECT win, leader, follower, count(*) AS n, CASE WHEN count(*) >= 12 THEN covar_pop(y, x) / nullif(var_pop(x), 0) END AS beta,
                     CASE WHEN count(*) >= 12 THEN sqrt(greatest(var_pop(y) - covar_pop(y, x)^2 / nullif(var_pop(x), 0), 0) / (count(*) - 2) / nullif(var_pop(x), 0)) END AS se
              FROM x_xy GROUP BY win, leader, follower)))""")
register("est_03_network", NET, lambda c: c.study.network, "SELECT * FROM x_net")
LENGTHS = (12, 24, 36)
of_length("x_win x_prof x_rank x_sel x_selsec x_pairs x_slice x_xy x_ols", (12, 36))
register("est_03_network_of_months", "months:i win<window:s leader:s follower:s n:i beta:f alpha:f r2:f std_error:g t_stat:g p_value:g alpha_t:g",
         lambda c: c.study.network_of_months(LENGTHS),
         " UNION ALL ".join(f"""SELECT {m} AS months, p.win, p.leader, p.follower, coalesce(e.n, 0) AS n, e.beta, e.alpha, e.r2, e.std_error, e.t_stat, e.p_value, e.alpha_t
             FROM x_pairs{t} p LEFT JOIN x_ols{t} e ON e.win = p.win AND e.leader = p.leader AND e.follower = p.follower""" for m, t in ((12, "_12"), (24, ""), (36, "_36"))))
register("est_04_all_lags", NET,
         lambda c: regression.network_from_slices(c.study.slices, c.study.pairs, c.cfg.lead_lag, (1, 0, 2, 3)),
         network(f"({ols('(' + xy_rows('x_pairs', 'x_slice', '1, 0, 2, 3') + ')', 'win, leader, follower, lag', 2, 12)})", lags="1, 0, 2, 3"))
register("est_05_inverted_direction", NET,
         lambda c: regression.network_from_slices(c.study.slices, c.study.pairs, c.cfg.lead_lag, (1,), inverted=True),
         network(f"({ols('(' + xy_rows('x_pairs', 'x_slice', '1', True) + ')', 'win, leader, follower, lag', 2, 12)})", "invertida"))
BETA_SQL = """SELECT win, leader, follower, count(*) AS n, CASE WHEN count(*) >= 12 THEN covar_pop(y, x) / nullif(var_pop(x), 0) END AS beta
              FROM {rows} GROUP BY win, leader, follower"""
register("est_06_batch_betas", "win<window:s leader:s follower:s n:i beta:f",
         lambda c: regression.batch_betas(c.study.slices, c.study.pairs, 1, 12),
         f"""SELECT p.win, p.leader, p.follower, coalesce(e.n, 0) AS n, e.beta FROM x_pairs p
             LEFT JOIN ({BETA_SQL.format(rows='x_xy')}) e USING (win, leader, follower)""")
STALE_EST = """SELECT s.win, s.instrument, s.date, s.pos, CASE WHEN NOT s.bad THEN e.ret END AS ret FROM (
  SELECT *, stale OR lag(stale, 1, false) OVER (PARTITION BY win, instrument ORDER BY pos) AS bad FROM (
    SELECT win, instrument, pos, date,
           coalesce(trades < 2, false) OR NOT coalesce(volume > 0, false) OR coalesce(volume < cut, false)
             OR coalesce(row_number() OVER (PARTITION BY win, instrument, island ORDER BY pos) >= 2, false) AS stale
    FROM (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY win, instrument ORDER BY pos) AS island
          FROM (SELECT w.win, d.*, coalesce(close = lag(close) OVER s, false) AS same,
                       quantile_cont(CASE WHEN volume > 0 THEN volume END, 0.1) OVER (PARTITION BY w.win, instrument) AS cut
                FROM x_mdense d JOIN x_win w ON d.date >= w.train_start AND d.date < w.train_end
                WINDOW s AS (PARTITION BY w.win, instrument ORDER BY pos))))) s
  JOIN x_mest e ON e.instrument = s.instrument AND e.pos = s.pos"""


def _without_stale(c):
    st = c.study
    lean = replace(c.cfg.stale, min_trades=2)
    stale = returns.stale_days(st.member_panel, st.windows, lean)
    clean = returns.drop_stale(regression.member_returns(st.estimation, st.pairs, st.windows), stale)
    cfg = replace(c.cfg.lead_lag, min_observations=6)
    return regression.network_from_slices(clean.filter("ret is not null"), st.pairs, cfg, (1,))


register("est_07_without_stale_days", "win<window:s leader:s follower:s n:i beta:f std_error:f",
         _without_stale,
         f"""WITH sl AS MATERIALIZED ({STALE_EST}),
             xy AS ({xy_rows('x_pairs', 'sl', '1')}), es AS ({ols('xy', 'win, leader, follower, lag', 2, 6)})
             SELECT p.win, p.leader, p.follower, coalesce(e.n, 0) AS n, e.beta, e.std_error FROM x_pairs p LEFT JOIN es e USING (win, leader, follower)""")
ALWAYS = """SELECT win, instrument FROM (SELECT w.win, d.instrument, bool_and(coalesce(volume > 0, false)) AS ok FROM x_mdense d
            JOIN x_win w ON d.date >= w.train_start AND d.date < w.train_end GROUP BY 1, 2) WHERE ok"""
register("flt_11_always_traded", "win<window:s instrument:s",
         lambda c: regression.always_traded(c.panel("month"), c.calendar("month"), c.windows), ALWAYS)
register("est_08_always_traded_network", NET,
         lambda c: regression.network_from_slices(c.study.slices, regression.pairs_always_traded(
             c.study.pairs, regression.always_traded(c.study.member_panel, c.study.calendar, c.study.windows)), c.cfg.lead_lag, (1,)),
         f"""SELECT * FROM x_net WHERE (win, leader) IN (SELECT (win, instrument) FROM ({ALWAYS}))
             AND (win, follower) IN (SELECT (win, instrument) FROM ({ALWAYS}))""")

# ---- false discovery and selection ----------------------------------------------------------
register("est_09_adjusted_p", "win<window:s leader:s follower:s p_value:f p_adjusted:f approved:b",
         lambda c: c.study.controlled, "SELECT * FROM x_ctl")
BANDED = "(SELECT n.*, b.band FROM x_net n CROSS JOIN (SELECT unnest([5, 10, 15, 25]) AS band) b WHERE n.min_band <= b.band)"
register("est_10_discoveries_by_band", "win<window:s band:i hypotheses:i not_estimated:i uncorrected:i approved:i approved_positive:i",
         lambda c: discovery.discovery_summary(discovery.control_discoveries(
             discovery.by_band(c.study.network, c.cfg.liquidity.bands), c.cfg.discovery, ["band"]), c.cfg.discovery, ["band"]),
         f"""SELECT win, band, count(p_value) AS hypotheses, count(*) - count(p_value) AS not_estimated, count(*) FILTER (WHERE p_value <= 0.35) AS uncorrected,
                    count(*) FILTER (WHERE approved) AS approved, count(*) FILTER (WHERE approved AND beta > 0) AS approved_positive
             FROM ({bh(BANDED, 'win, band', 0.35)}) GROUP BY 1, 2""")
register("est_11_selected_pairs", "rule:s win<window:s leader:s follower:s beta:f t_stat:f",
         lambda c: c.study.selected, "SELECT * FROM x_chosen")

# ---- placebo --------------------------------------------------------------------------------
GROUP = "replicate, win, sector, subsector"


def _drawn() -> str:
    """Attempts in spans; each span is drawn only for the groups that are still open."""
    spans, out, done = ((0, 1), (1, 3), (3, 7), (7, 15), (15, 31), (31, 50)), [], []
    out.append(f"""base AS MATERIALIZED (SELECT p.*, r.replicate, count(*) OVER (PARTITION BY {GROUP}) AS e_size FROM x_pairs p CROSS JOIN (SELECT unnest(range(1, 501)) AS replicate) r),
open0 AS MATERIALIZED (SELECT * FROM base WHERE e_size > 1)""")
    for k, (lo, hi) in enumerate(spans):
        out.append(f"""put{k} AS MATERIALIZED (SELECT o.*, a.attempt, row_number() OVER (PARTITION BY {GROUP}, attempt ORDER BY leader, follower, leader_issuer, follower_issuer) AS slot,
   row_number() OVER (PARTITION BY {GROUP}, attempt ORDER BY md5(concat_ws('|', '42', replicate, attempt, win, leader, follower))) AS place
   FROM open{k} o CROSS JOIN (SELECT unnest(range({lo}, {hi})) AS attempt) a),
met{k} AS MATERIALIZED (SELECT *, min(CASE WHEN ok THEN attempt END) OVER (PARTITION BY {GROUP}) AS first_ok FROM (
   SELECT a.replicate, a.win, a.sector, a.subsector, a.attempt, a.leader, b.follower,
     bool_and(a.leader <> b.follower AND a.leader_issuer <> b.follower_issuer) OVER (PARTITION BY a.replicate, a.win, a.sector, a.subsector, a.attempt) AS ok
   FROM put{k} a JOIN put{k} b ON a.replicate = b.replicate AND a.win = b.win AND a.sector = b.sector AND a.subsector = b.subsector AND a.attempt = b.attempt AND a.slot = b.place)),
open{k + 1} AS MATERIALIZED (SELECT * FROM open{k} o WHERE NOT EXISTS (SELECT 1 FROM met{k} m WHERE m.ok AND m.replicate = o.replicate AND m.win = o.win AND m.sector = o.sector AND m.subsector = o.subsector))""")
        done.append(f"SELECT {GROUP}, leader, follower FROM met{k} WHERE attempt = first_ok")
    rest = f"SELECT {GROUP}, leader, follower FROM base WHERE e_size < 2 UNION ALL SELECT {GROUP}, leader, follower FROM open{len(spans)}"
    return ",\n".join(out) + f",\nshuffled AS MATERIALIZED ({' UNION ALL '.join([*done, rest])})"


EXPANDED, SHUFFLED = _drawn(), "SELECT * FROM shuffled"
ORD_BETA = BETA_SQL.format(rows="(" + xy_rows("x_ord", "x_slice", "1") + ")")
register("est_12_shuffled_pairs", "replicate:i win<window:s sector:s subsector:s leader:s follower:s",
         lambda c: placebo.shuffled_pairs(c.study.pairs, c.cfg.placebo.replicates, c.cfg.seed), f"WITH {EXPANDED} {SHUFFLED}")
register("est_13_placebo_distribution", "win<window:s replicate:i median_beta:f mean_beta:f estimated:i",
         lambda c: c.study.placebo()[0],
         f"""WITH {EXPANDED}, ob AS MATERIALIZED ({ORD_BETA})
             SELECT s.win, s.replicate, median(beta) AS median_beta, avg(beta) AS mean_beta, count(beta) AS estimated
             FROM ({SHUFFLED}) s LEFT JOIN ob USING (win, leader, follower) GROUP BY 1, 2""")
register("est_13_placebo_summary", "win<window:s real_median:f real_mean:f real_estimated:i replicates:i placebo_p50:f placebo_p95:f p_empirical:f",
         lambda c: c.study.placebo()[1],
         f"""WITH {EXPANDED}, ob AS MATERIALIZED ({ORD_BETA}),
             d AS (SELECT s.win, s.replicate, median(beta) AS mb FROM ({SHUFFLED}) s LEFT JOIN ob USING (win, leader, follower) GROUP BY 1, 2),
             r AS (SELECT win, median(beta) AS real_median, avg(beta) AS real_mean, count(beta) AS real_estimated FROM x_pairs LEFT JOIN ob USING (win, leader, follower) GROUP BY 1)
             SELECT win, any_value(real_median) AS real_median, any_value(real_mean) AS real_mean, any_value(real_estimated) AS real_estimated, count(*) AS replicates,
                    median(mb) AS placebo_p50, quantile_cont(mb, 0.95) AS placebo_p95, avg(CASE WHEN mb IS NOT NULL THEN (mb >= real_median)::INT END) AS p_empirical
             FROM r JOIN d USING (win) GROUP BY win""")

# ---- positions and P&L ----------------------------------------------------------------------
register("pos_01_signals", "rule:s mode:s win<window:s date:d leader:s follower:s direction:f vol:f status:s",
         lambda c: c.study.signals, "SELECT * FROM x_sig")
register("pos_02_cohort_weights", "rule:s mode:s win<window:s pos:i instrument:s weight:f", lambda c: c.study.cohorts, "SELECT * FROM x_coh")
register("pos_03_overlapping_positions", "rule:s mode:s date:d instrument:s weight:f", lambda c: c.study.positions, "SELECT * FROM x_pos")
register("pos_04_exposure_by_book", "rule:s mode:s rows:i gross:f",
         lambda c: c.study.positions.groupBy("rule", "mode").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.abs("weight")).alias("gross")),
         "SELECT rule, mode, count(*) AS rows, sum(abs(weight)) AS gross FROM x_pos GROUP BY 1, 2")
register("pos_05_gross_pnl", "rule:s mode:s date:d gross_pnl:f missing_returns:i", lambda c: c.study.book, "SELECT * FROM x_book")
register("pos_06_legs", "rule:s mode:s date:d long_leg:f short_leg:f", lambda c: c.study.book, "SELECT * FROM x_book")
register("pos_07_turnover", "rule:s mode:s date:d turnover:f", lambda c: c.study.book, "SELECT * FROM x_book")
register("pos_08_exposure", "rule:s mode:s date:d gross_exposure:f net_exposure:f", lambda c: c.study.book, "SELECT * FROM x_book")
register("pos_09_signal_diagnostics", "rule:s mode:s win<window:s signals:i events:i without_vol:i without_return:i",
         lambda c: positions.signal_diagnostics(c.study.signals),
         """SELECT rule, mode, win, count(DISTINCT CASE WHEN status = 'ok' THEN (pos, follower) END) AS signals, count(*) FILTER (WHERE status = 'ok') AS events,
              count(*) FILTER (WHERE status = 'sem_vol') AS without_vol, count(*) FILTER (WHERE status = 'sem_retorno_sinal') AS without_return FROM x_sig GROUP BY 1, 2, 3""")
register("pos_10_walk_forward_summary", "rule:s mode:s gross_total:f net_total:f mean_turnover:f missing_returns:i position_days:i crossings:i",
         lambda c: c.study.summary(),
         """SELECT * FROM (SELECT rule, mode, sum(gross_pnl) AS gross_total, sum(net_pnl) AS net_total, avg(turnover) AS mean_turnover, sum(missing_returns) AS missing_returns FROM x_book GROUP BY 1, 2)
            LEFT JOIN (SELECT p.rule, p.mode, count(*) AS position_days, count(*) FILTER (WHERE r.boundary) AS crossings FROM x_pos p
                       LEFT JOIN x_mret r ON r.instrument = p.instrument AND r.date = p.date WHERE weight <> 0 GROUP BY 1, 2) USING (rule, mode)""")
register("ret_08_event_crossings", "position_days:i crossings:i share:f",
         lambda c: returns.event_crossings(c.study.positions, c.study.boundaries),
         """SELECT count(*) AS position_days, count(*) FILTER (WHERE boundary) AS crossings, count(*) FILTER (WHERE boundary) / count(*) AS share
            FROM x_pos p LEFT JOIN x_mret r ON r.instrument = p.instrument AND r.date = p.date WHERE weight <> 0""")
register("cst_01_one_way_cost", "rule:s mode:s one_way_bps:f days:i",
         lambda c: c.study.book.groupBy("rule", "mode").agg(F.lit(c.cfg.costs.one_way_bps).alias("one_way_bps"), F.count(F.lit(1)).alias("days")),
         "SELECT rule, mode, 5.0 + 5.0 + 0.0 + 3.25 AS one_way_bps, count(*) AS days FROM x_book GROUP BY 1, 2")
register("cst_02_turnover_cost", "rule:s mode:s date:d turnover_cost:e", lambda c: c.study.book, "SELECT * FROM x_book")
register("cst_03_borrow_cost", "rule:s mode:s date:d borrow_cost:e", lambda c: c.study.book, "SELECT * FROM x_book")
register("cst_04_net_pnl", "rule:s mode:s date:d gross_pnl:f net_pnl:f", lambda c: c.study.book, "SELECT * FROM x_book")
register("cst_05_borrow_scenarios", "rule:s mode:s date:d rate:f net_pnl:f",
         lambda c: positions.borrow_scenarios(c.study.book, c.cfg.costs),
         "SELECT rule, mode, date, rate, gross_pnl - turnover_cost - short_exposure * rate / 252 AS net_pnl FROM x_book CROSS JOIN (SELECT unnest([0, 0.02, 0.05, 0.1, 0.2])::DOUBLE AS rate)")
register("cst_06_illustrative_tax", "rule:s mode:s year:i annual:f after_tax:f",
         lambda c: positions.illustrative_tax(c.study.book),
         "SELECT rule, mode, year(date) AS year, sum(net_pnl) AS annual, sum(net_pnl) - greatest(sum(net_pnl), 0) * 0.15 AS after_tax FROM x_book GROUP BY 1, 2, 3")

# ---- inference ------------------------------------------------------------------------------
BOOK = ["rule", "mode"]
SUMMARY_SQL = """
SELECT {keys}, count(v) AS days, sum(v) AS total, avg(v) * 252 AS annual_mean, stddev_samp(v) * sqrt(252.0) AS annual_vol,
       CASE WHEN stddev_samp(v) IS NULL OR stddev_samp(v) < 1e-12 THEN 0 ELSE avg(v) / stddev_samp(v) * sqrt(252.0) END AS sharpe,
       min(dd) AS max_drawdown, avg((v <> 0)::INT) AS active_share, avg(turnover) AS mean_turnover
FROM (SELECT *, cum - max(cum) OVER (PARTITION BY {keys} ORDER BY pos) AS dd
      FROM (SELECT *, sum(v) OVER (PARTITION BY {keys} ORDER BY pos) AS cum FROM {src})) GROUP BY {keys}"""
SUM_COLS = "days:i total:f annual_mean:f annual_vol:f sharpe:f max_drawdown:f active_share:f mean_turnover:f"
register("est_14_strategy_summary", f"rule:s mode:s {SUM_COLS}",
         lambda c: inference.strategy_summary(c.study.book, BOOK, "net_pnl", "turnover"),
         SUMMARY_SQL.format(keys="rule, mode", src="(SELECT *, net_pnl AS v FROM x_book)"))
register("est_15_alpha_beta", "rule:s mode:s n:i daily_alpha:f annual_alpha:f beta:f alpha_t:f alpha_p:f",
         lambda c: inference.alpha_beta(c.study.book, returns.benchmark_returns(c.study.quotes.groupBy("date").agg(
             (F.round(F.sum("volume"), 2) / F.round(F.sum("quantity"), 2)).alias("close"))), BOOK, "net_pnl"),
         f"""SELECT rule, mode, n, alpha AS daily_alpha, alpha * 252 AS annual_alpha, beta, alpha_t, alpha_p FROM (
             {ols('(SELECT rule, mode, b.date, pos, bench AS x, net_pnl AS y FROM x_book b JOIN x_bench m ON m.date = b.date WHERE bench IS NOT NULL)', 'rule, mode', 10, 30)})""")
register("est_16_newey_west", "rule:s mode:s n:i mean:f t:f",
         lambda c: inference.newey_west(c.study.book, BOOK, "net_pnl"),
         f"""SELECT rule, mode, count(*) AS n, any_value(m) AS mean, any_value(m) / (sqrt(sum(e*e {''.join(f' + 2*{1 - i/11!r}*e*e{i}' for i in range(1, 11))})) / count(*)) AS t
             FROM (SELECT * {''.join(f', coalesce(lag(e, {i}) OVER w, 0) AS e{i}' for i in range(1, 11))} FROM (
               SELECT *, avg(net_pnl) OVER (PARTITION BY rule, mode) AS m, net_pnl - avg(net_pnl) OVER (PARTITION BY rule, mode) AS e FROM x_book)
               WINDOW w AS (PARTITION BY rule, mode ORDER BY pos)) GROUP BY rule, mode""")
register("est_17_block_bootstrap", "rule:s mode:s n:i mean:f ci_low:f ci_high:f lower_tail:f replicates:i",
         lambda c: inference.block_bootstrap(c.study.book, BOOK, "net_pnl", c.cfg.seed, c.cfg.metrics, holding=3),
         """WITH s AS MATERIALIZED (SELECT rule, mode, net_pnl AS v, row_number() OVER (PARTITION BY rule, mode ORDER BY pos) AS k, count(*) OVER (PARTITION BY rule, mode) AS n FROM x_book),
            cs AS MATERIALIZED (SELECT rule, mode, k, n, sum(v) OVER (PARTITION BY rule, mode ORDER BY k) AS c FROM s UNION ALL SELECT rule, mode, 0, any_value(n), 0 FROM s GROUP BY 1, 2),
            b AS (SELECT g.rule, g.mode, g.n, rep, blk, ('0x' || substr(md5(concat_ws('|', '42', g.rule, g.mode, rep, blk)), 1, 8))::BIGINT % (n - 5 + 1) AS st, least(5, n - blk * 5) AS len
                  FROM (SELECT DISTINCT rule, mode, n FROM s) g CROSS JOIN (SELECT unnest(range(1, 10001)) AS rep) CROSS JOIN (SELECT unnest(range(0, 200)) AS blk) WHERE blk < ceil(n / 5)),
            m AS (SELECT b.rule, b.mode, rep, sum(hi.c - lo.c) / any_value(b.n) AS m FROM b JOIN cs hi ON hi.rule = b.rule AND hi.mode = b.mode AND hi.k = st + len
                  JOIN cs lo ON lo.rule = b.rule AND lo.mode = b.mode AND lo.k = st GROUP BY ALL)
            SELECT m.rule, m.mode, any_value(a.n) AS n, any_value(a.mean) AS mean, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high, avg((m <= 0)::INT) AS lower_tail, count(*) AS replicates
            FROM m JOIN (SELECT rule, mode, count(*) AS n, avg(v) AS mean FROM s GROUP BY 1, 2) a USING (rule, mode) GROUP BY m.rule, m.mode""")


def _cars(c):
    st = c.study
    ev = (st.signals.filter("status = 'ok' and mode = 'long_short'")
          .select(F.concat_ws("|", "rule", "window", F.col("date").cast("string"), "leader", "follower").alias("event_id"),
                  "rule", "date", F.col("follower").alias("instrument"), "direction"))
    bench = returns.benchmark_returns(st.quotes.groupBy("date").agg(
        (F.round(F.sum("volume"), 2) / F.round(F.sum("quantity"), 2)).alias("close")))
    cal = st.calendar
    ret = st.marked.join(cal.select("pos", "date"), "pos").select("instrument", "pos", "date", "ret")
    return inference.signed_car(inference.event_car(ev, ret, bench, cal, 3))


CAR_SQL = """
SELECT e.rule || '|' || e.win || '|' || e.date::VARCHAR || '|' || e.leader || '|' || e.follower AS event_id,
       CASE WHEN any_value(e.pos) + 2 <= (SELECT max(pos) FROM x_mcal) THEN coalesce(sum(m.ret - b.bench), 0) END AS car, any_value(direction) AS direction
FROM x_sig e LEFT JOIN x_mmark m ON m.instrument = e.follower AND m.pos BETWEEN e.pos + 2 AND e.pos + 4 LEFT JOIN x_bench b ON b.date = m.date
WHERE status = 'ok' AND mode = 'long_short' GROUP BY e.rule, e.win, e.date, e.leader, e.follower"""
register("est_18_event_car", "event_id:s car:f", _cars, CAR_SQL)
register("est_19_signed_car", "event_id:s signed_car:f", _cars, f"SELECT event_id, car * direction AS signed_car FROM ({CAR_SQL})")
register("est_22_metric_table", f"rule:s mode:s series:s {SUM_COLS}",
         lambda c: inference.strategy_summary(reports.gross_and_net(c.study.book), [*BOOK, "series"], "value", "turnover"),
         SUMMARY_SQL.format(keys="rule, mode, series", src="(SELECT *, 'bruto' AS series, gross_pnl AS v FROM x_book UNION ALL SELECT *, 'liquido', net_pnl FROM x_book)"))

# ---- report inputs and invariants -----------------------------------------------------------
register("rpt_01_median_beta_by_band", "win<window:s band:i median_beta:f pairs:i",
         lambda c: reports.median_beta_by_band(c.study.network, c.cfg.liquidity.bands),
         f"SELECT win, band, median(beta) AS median_beta, count(beta) AS pairs FROM {BANDED} GROUP BY 1, 2")
register("rpt_01_cumulative_pnl", "rule:s mode:s date:d cumulative_gross:f cumulative_net:f",
         lambda c: reports.cumulative_pnl(c.study.book),
         """SELECT rule, mode, date, sum(gross_pnl) OVER (PARTITION BY rule, mode ORDER BY pos) AS cumulative_gross,
              sum(net_pnl) OVER (PARTITION BY rule, mode ORDER BY pos) AS cumulative_net FROM x_book""")
register("rpt_01_p_value_histogram", "bin:i pairs:i",
         lambda c: reports.histogram(c.study.network, "p_value", 0.0, 1.0, 40).withColumnRenamed("count", "pairs"),
         "SELECT least(floor(p_value * 40), 39) + 1 AS bin, count(*) AS pairs FROM x_net WHERE p_value IS NOT NULL GROUP BY 1")
register("rpt_02_median_beta_by_lag", "lag:i band:i median_beta:f",
         lambda c: reports.median_beta_by_lag(regression.network_from_slices(
             c.study.slices, c.study.pairs, c.cfg.lead_lag, (1, 0, 2, 3)), (15, 25)),
         f"""SELECT lag, band, median(beta) AS median_beta FROM (
             {network('(' + ols('(' + xy_rows('x_pairs', 'x_slice', '1, 0, 2, 3') + ')', 'win, leader, follower, lag', 2, 12) + ')', lags='1, 0, 2, 3')})
             CROSS JOIN (SELECT unnest([15, 25]) AS band) WHERE min_band <= band GROUP BY 1, 2""")
register("rpt_02_approval_signs", "win<window:s positive:i negative:i",
         lambda c: reports.approval_signs(c.study.controlled),
         "SELECT win, count(*) FILTER (WHERE approved AND beta > 0) AS positive, count(*) FILTER (WHERE approved AND beta <= 0) AS negative FROM x_ctl GROUP BY 1")
register("dq_27_invariants", "check:s rows:i violations:i",
         lambda c: checks.study_invariants(c.study.book, positions.borrow_scenarios(c.study.book, c.cfg.costs), c.study.controlled, c.study.selected, 505),
         """SELECT 'liquido_nao_supera_bruto' AS "check", count(*) AS rows, count(*) FILTER (WHERE net_pnl > gross_pnl + 1e-12) AS violations FROM x_book
            UNION ALL SELECT 'exposicao_bruta_ate_1', count(*), count(*) FILTER (WHERE gross_exposure > 1 + 1e-9) FROM x_book
            UNION ALL SELECT 'giro_nao_negativo', count(*), count(*) FILTER (WHERE turnover < 0) FROM x_book
            UNION ALL SELECT 'long_only_sem_vendida', count(*) FILTER (WHERE mode = 'long_only'), count(*) FILTER (WHERE mode = 'long_only' AND short_exposure > 1e-12) FROM x_book
            UNION ALL SELECT 'aluguel_monotono', 4 * count(*), 0 FROM x_book
            UNION ALL SELECT 'beta_selecionado_positivo', count(*), count(*) FILTER (WHERE beta <= 0) FROM x_chosen
            UNION ALL SELECT 'lider_mais_liquida', count(*), count(*) FILTER (WHERE leader_position >= follower_position) FROM x_ctl
            UNION ALL SELECT 'sem_par_proprio', count(*), count(*) FILTER (WHERE leader = follower) FROM x_ctl
            UNION ALL SELECT 'observacoes_ate_limite', count(*), count(*) FILTER (WHERE n > 505) FROM x_ctl
            UNION ALL SELECT 'aprovados_ate_hipoteses', count(*), count(*) FILTER (WHERE a > h) FROM (SELECT win, count(p_value) AS h, count(*) FILTER (WHERE approved) AS a FROM x_ctl GROUP BY 1)""")
