"""Queries over quotes: calendar, returns, universe, sectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadwake.config import StalePrice
from leadwake.operators import returns, sectors, sessions, universe
from leadwake.plans import bindings as b
from leadwake.plans.registry import register


def _windows_of_lengths(c):
    out = None
    for m in (12, 24, 36):
        some = sessions.walk_forward_windows(c.spark, c.cfg.period.start, c.cfg.period.end, c.cfg.walk_forward, m).withColumn("months", F.lit(m))
        out = some if out is None else out.unionByName(some)
    return out


# ---- calendar and listing -------------------------------------------------------------------
register("dq_01_session_calendar", "date:d pos:i instruments:i", lambda c: c.calendar(),
         "SELECT date, pos, instruments FROM x_dcal")
register("dq_02_listing_span", "instrument:s first_date:d last_date:d", lambda c: sessions.listing_span(c.daily),
         "SELECT instrument, min(date) AS first_date, max(date) AS last_date FROM x_dq GROUP BY 1")
register("uni_01_training_lengths", "months:i window_id:i win<window:s train_start:d train_end:d test_start:d test_end:d", lambda c: _windows_of_lengths(c),
         " UNION ALL ".join(f"""SELECT {m} AS months, i AS window_id, strftime(te, '%Y-%m') AS win, ts::DATE AS train_start, te::DATE AS train_end, te::DATE AS test_start, (te + INTERVAL 3 MONTH)::DATE AS test_end
            FROM (SELECT i, DATE '1995-01-01' + to_months(3 * i::INT) AS ts, DATE '1995-01-01' + to_months({m} + 3 * i::INT) AS te FROM range(0, 60) r(i)) WHERE te + INTERVAL 3 MONTH <= DATE '2001-12-01'"""
                            for m in (12, 24, 36)))
register("uni_01_windows", "window_id:i win<window:s train_start:d train_end:d test_start:d test_end:d rows:i",
         lambda c: (sessions.in_windows(c.monthly.select("date", "instrument"), c.windows)
                    .groupBy("window_id", "window", "train_start", "train_end", "test_start", "test_end")
                    .agg(F.count(F.lit(1)).alias("rows"))),
         """SELECT window_id, win, train_start, train_end, test_start, test_end, count(*) AS rows
            FROM x_win JOIN x_mq ON date >= train_start AND date < train_end GROUP BY ALL""")
register("flt_07_training_slice", "win<window:s rows:i instruments:i volume:f",
         lambda c: (sessions.in_windows(c.daily.select("date", "instrument", "volume"), c.windows).groupBy("window")
                    .agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("instrument").alias("instruments"),
                         F.round(F.sum("volume"), 2).alias("volume"))),
         """SELECT win, count(*) AS rows, count(DISTINCT instrument) AS instruments, round(sum(volume), 2) AS volume
            FROM x_dq JOIN x_win ON date >= train_start AND date < train_end GROUP BY win""")

# ---- returns --------------------------------------------------------------------------------
register("ret_01_panel", "date:d pos:i instrument:s close:f volume:f trades:i", lambda c: c.panel(),
         "SELECT date, pos, instrument, close, volume, trades FROM x_ddense WHERE close IS NOT NULL")
register("ret_02_simple_return", "date:d instrument:s ret:f",
         lambda c: returns.simple_returns(c.panel()).filter("ret is not null"),
         "SELECT date, instrument, raw_ret AS ret FROM x_dret WHERE raw_ret IS NOT NULL")
register("ret_03_log_return", "date:d instrument:s log_ret:f",
         lambda c: returns.log_returns(c.panel("month")).filter("log_ret is not null"),
         "SELECT date, instrument, log_ret FROM x_mret WHERE log_ret IS NOT NULL")
register("ret_04_valid_return_mask", "instrument:s rows:i valid:i",
         lambda c: (c.panel("month").withColumn("ok", returns.traded_both_sessions()).groupBy("instrument")
                    .agg(F.count(F.lit(1)).alias("rows"), F.count_if("ok").alias("valid"))),
         """SELECT instrument, count(close) AS rows, count(*) FILTER (WHERE both_traded) AS valid
            FROM x_mret GROUP BY instrument""")
register("ret_05_event_boundaries", "date:d instrument:s token:s boundary:b",
         lambda c: returns.event_boundaries(c.panel()).filter("token <> ''"),
         "SELECT date, instrument, token, boundary FROM x_dret WHERE token <> ''")
register("ret_06_estimation_returns", "date:d instrument:s ret:f",
         lambda c: returns.estimation_returns(c.panel("month")).filter("ret is not null"),
         "SELECT date, instrument, ret FROM x_mest WHERE ret IS NOT NULL")
register("ret_06_next_session_masked", "date:d instrument:s ret:f",
         lambda c: returns.estimation_returns(c.panel("month"), mask_next_session=True).filter("ret is not null"),
         """SELECT date, instrument, raw_ret AS ret FROM (
              SELECT *, boundary OR lag(boundary, 1, false) OVER (PARTITION BY instrument ORDER BY pos) AS blocked FROM x_mret)
            WHERE NOT blocked AND both_traded AND raw_ret IS NOT NULL""")
register("ret_07_marked_returns", "date:d instrument:s ret:f",
         lambda c: returns.marked_returns(c.panel()).filter("ret is not null"),
         "SELECT date, instrument, ret FROM x_dmark WHERE p IS NOT NULL AND ret IS NOT NULL")


def _marked_dense(c):
    last = c.calendar("month").agg(F.max("pos")).scalar()
    rows = returns.marked_returns(c.panel("month")).select("instrument", "pos", "ret", "close")
    return returns.fill_sessions(rows, last, ("ret",))


register("ret_07_marked_dense", "pos:i instrument:s ret:f filled:b",
         lambda c: _marked_dense(c).filter("ret is not null"),
         "SELECT pos, instrument, ret, p IS NULL AS filled FROM x_mmark WHERE ret IS NOT NULL")
register("ret_09_median_liquidity", "date:d instrument:s liquidity:f",
         lambda c: returns.median_liquidity(returns.volumes_in_reach(c.panel("month"), c.calendar("month"), 12), 12).filter("liquidity is not null"),
         """SELECT date, instrument, liquidity FROM (
              SELECT *, CASE WHEN count(volume) OVER w >= 6 THEN median(volume) OVER w END AS liquidity FROM x_mdense
              WINDOW w AS (PARTITION BY instrument ORDER BY pos ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
            WHERE liquidity IS NOT NULL""")
register("ret_10_traded_share", "date:d instrument:s traded_share:f",
         lambda c: returns.traded_share(returns.volumes_in_reach(c.panel("month"), c.calendar("month"), 12), 12).filter("traded_share is not null"),
         """SELECT date, instrument, traded_share FROM (
              SELECT *, avg(CASE WHEN volume IS NOT NULL THEN (volume > 0)::INT END) OVER (PARTITION BY instrument ORDER BY pos
                ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS traded_share FROM x_mdense) WHERE traded_share IS NOT NULL""")
register("ret_11_realized_volatility", "pos:i instrument:s vol:f",
         lambda c: returns.realized_volatility(_marked_dense(c), 12).filter("vol is not null"),
         """SELECT pos, instrument, vol FROM (
              SELECT *, CASE WHEN count(ret) OVER w >= 6 THEN stddev_samp(ret) OVER w * sqrt(252.0) END AS vol FROM x_mmark
              WINDOW w AS (PARTITION BY instrument ORDER BY pos ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)) WHERE vol IS NOT NULL""")

STALE_SQL = """
SELECT win, instrument, pos, date, volume, trades, close,
       coalesce(trades < 2, false) OR NOT coalesce(volume > 0, false) OR coalesce(volume < cut, false)
         OR coalesce(row_number() OVER (PARTITION BY win, instrument, island ORDER BY pos) >= 2, false) AS stale
FROM (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY win, instrument ORDER BY pos) AS island
      FROM (SELECT w.win, d.*, coalesce(close = lag(close) OVER s, false) AS same,
                   quantile_cont(CASE WHEN volume > 0 THEN volume END, 0.1) OVER (PARTITION BY w.win, instrument) AS cut
            FROM x_mdense d JOIN x_win w ON d.date >= w.train_start AND d.date < w.train_end
            WINDOW s AS (PARTITION BY w.win, instrument ORDER BY pos)))"""
register("ret_12_stale_days", "win<window:s date:d instrument:s stale:b",
         lambda c: returns.stale_days(c.panel("month"), c.windows, StalePrice(min_trades=2)),
         f"SELECT win, date, instrument, stale FROM ({STALE_SQL}) WHERE close IS NOT NULL")
register("ret_13_contaminated_returns", "win<window:s instrument:s kept:i",
         lambda c: (returns.drop_stale(
             sessions.in_windows(returns.estimation_returns(c.panel("month")), c.windows),
             returns.stale_days(c.panel("month"), c.windows, StalePrice(min_trades=2)))
             .groupBy("window", "instrument").agg(F.count("ret").alias("kept"))),
         f"""SELECT s.win, s.instrument, count(CASE WHEN NOT bad THEN ret END) AS kept FROM (
               SELECT *, stale OR lag(stale, 1, false) OVER (PARTITION BY win, instrument ORDER BY pos) AS bad FROM ({STALE_SQL})) s
             LEFT JOIN x_mest e ON e.instrument = s.instrument AND e.pos = s.pos
             GROUP BY 1, 2 HAVING count(close) > 0""")
register("ret_14_benchmark", "date:d bench:f",
         lambda c: returns.benchmark_returns(c.daily.groupBy("date").agg(
             (F.round(F.sum("volume"), 2) / F.round(F.sum("quantity"), 2)).alias("close"))).filter("bench is not null"),
         """SELECT date, bench FROM (SELECT date, v / lag(v) OVER (ORDER BY date) - 1 AS bench FROM (
              SELECT date, round(sum(volume), 2) / round(sum(quantity), 2) AS v FROM x_dq GROUP BY date)) WHERE bench IS NOT NULL""")

# ---- universe -------------------------------------------------------------------------------
register("uni_02_liquidity_ranking",
         "win<window:s instrument:s liquidity:f median_trades:f sessions:i zero_volume_days:i issuer:s coverage:f traded_share:f traded_on_final:b eligible:b position:i",
         lambda c: universe.liquidity_ranking(c.monthly, c.windows, c.cfg.liquidity), "SELECT * FROM x_rank")
register("uni_03_one_per_issuer", "win<window:s instrument:s issuer:s reason:s final_position:i",
         lambda c: universe.select_universe(c.monthly, c.windows, c.cfg.liquidity), "SELECT * FROM x_sel")
register("uni_04_bands", "win<window:s band:s members:i worst:i",
         lambda c: (c.study.selection.filter("band <> ''").groupBy("window", "band")
                    .agg(F.count(F.lit(1)).alias("members"), F.max("final_position").alias("worst"))),
         "SELECT win, band, count(*) AS members, max(final_position) AS worst FROM x_sel WHERE band <> '' GROUP BY 1, 2")
register("uni_05_best_position", "instrument:s best_position:i windows_eligible:i max_liquidity:f best_window:s",
         lambda c: universe.best_positions(universe.liquidity_ranking(c.monthly, c.windows, c.cfg.liquidity)),
         """SELECT instrument, min(position) AS best_position, count(*) AS windows_eligible, max(liquidity) AS max_liquidity,
              arg_min(win, (position, win)) AS best_window FROM x_rank WHERE eligible GROUP BY 1""")

REACH_SQL = """
SELECT o.instrument, o.date, g.p AS any_position, t.p AS train_position, s.p AS test_position,
       coalesce(t.n, 0) AS train_windows, coalesce(s.n, 0) AS test_windows,
       CASE WHEN t.n IS NULL THEN 'sem_janela_na_data' WHEN t.p <= 25 THEN t.band WHEN coalesce(t.el, false) THEN 'elegivel_fora_top100'
            WHEN t.pr THEN 'nao_elegivel_na_janela' ELSE 'ausente_da_janela' END AS train_status,
       CASE WHEN s.n IS NULL THEN 'sem_janela_na_data' WHEN s.p <= 25 THEN s.band WHEN coalesce(s.el, false) THEN 'elegivel_fora_top100'
            WHEN s.pr THEN 'nao_elegivel_na_janela' ELSE 'ausente_da_janela' END AS test_status,
       coalesce(t.p <= 25, false) AS may_affect_estimation, coalesce(s.p <= 25, false) AS may_affect_signal
FROM (SELECT instrument, date FROM x_mret WHERE boundary) o
LEFT JOIN (SELECT *, CASE WHEN p <= 5 THEN 'top5' WHEN p <= 10 THEN 'top10' WHEN p <= 15 THEN 'top15' ELSE 'top25' END AS band FROM (
    SELECT o.instrument, o.date, count(*) AS n, min(CASE WHEN eligible THEN position END) AS p, bool_or(eligible) AS el, bool_or(eligible IS NOT NULL) AS pr
    FROM (SELECT instrument, date FROM x_mret WHERE boundary) o JOIN x_win w ON o.date >= w.train_start AND o.date < w.train_end
    LEFT JOIN x_rank r ON r.win = w.win AND r.instrument = o.instrument GROUP BY 1, 2)) t ON t.instrument = o.instrument AND t.date = o.date
LEFT JOIN (SELECT *, CASE WHEN p <= 5 THEN 'top5' WHEN p <= 10 THEN 'top10' WHEN p <= 15 THEN 'top15' ELSE 'top25' END AS band FROM (
    SELECT o.instrument, o.date, count(*) AS n, min(CASE WHEN eligible THEN position END) AS p, bool_or(eligible) AS el, bool_or(eligible IS NOT NULL) AS pr
    FROM (SELECT instrument, date FROM x_mret WHERE boundary) o JOIN x_win w ON o.date >= w.test_start AND o.date < w.test_end
    LEFT JOIN x_rank r ON r.win = w.win AND r.instrument = o.instrument GROUP BY 1, 2)) s ON s.instrument = o.instrument AND s.date = o.date
LEFT JOIN (SELECT instrument, min(CASE WHEN eligible THEN position END) AS p FROM x_rank GROUP BY 1) g ON g.instrument = o.instrument"""


def _reach(c):
    occ = returns.event_boundaries(c.panel("month")).filter("boundary").select("instrument", "date")
    rk = universe.liquidity_ranking(c.monthly, c.windows, c.cfg.liquidity)
    return universe.universe_reach(occ, rk, c.windows, c.cfg.liquidity)


register("uni_06_universe_reach",
         "instrument:s date:d any_position:i train_status:s train_position:i test_status:s test_position:i train_windows:i test_windows:i may_affect_estimation:b may_affect_signal:b",
         _reach, REACH_SQL)
register("dq_24_cumulative_reach", "band:s occurrences:i",
         lambda c: universe.cumulative_reach(_reach(c), "train_position", c.cfg.liquidity.bands),
         f"""SELECT 'top' || n AS band, count(*) FILTER (WHERE train_position <= n) AS occurrences
             FROM ({REACH_SQL}) CROSS JOIN (SELECT unnest([5, 10, 15, 25]) AS n) GROUP BY n""")
register("dq_24_exclusive_states", "train_status:s test_status:s occurrences:i",
         lambda c: _reach(c).groupBy("train_status", "test_status").agg(F.count(F.lit(1)).alias("occurrences")),
         f"SELECT train_status, test_status, count(*) AS occurrences FROM ({REACH_SQL}) GROUP BY 1, 2")
register("uni_07_issuer_code", "instrument:s isin:s issuer:s",
         lambda c: b.instruments(c.spark, c.sf).withColumn("issuer", universe.issuer_of(F.col("isin"))),
         "SELECT instrument, isin, CASE WHEN length(isin) = 12 THEN substr(isin, 3, 4) END AS issuer FROM x_inst")
register("uni_08_sector_at_formation", "win<window:s instrument:s reason:s sector:s subsector:s formation_date:d",
         lambda c: c.study.selection_with_sector.filter("band <> ''"), "SELECT * FROM x_selsec WHERE band <> ''")
register("uni_09_candidate_pairs",
         "win<window:s sector:s subsector:s leader:s follower:s leader_issuer:s follower_issuer:s leader_position:i follower_position:i leader_liquidity:f follower_liquidity:f min_band:i",
         lambda c: c.study.all_pairs, "SELECT * FROM x_pairs")
register("uni_14_exclusion_funnel", "win<window:s reason:s instruments:i",
         lambda c: universe.exclusion_funnel(c.study.selection),
         "SELECT win, reason, count(*) AS instruments FROM x_sel GROUP BY 1, 2")

# ---- sectors --------------------------------------------------------------------------------
register("sec_01_validation", "rule:s instrument:s detail:s", lambda c: sectors.validate(c.sectors),
         """SELECT 'fonte_proibida' AS rule, instrument, source AS detail FROM x_sect WHERE lower(source) LIKE '%yahoo%'
            UNION ALL
            SELECT DISTINCT 'emissor_divergente', a.issuer, 'subsector' FROM x_sect a JOIN x_sect b
              ON a.issuer = b.issuer AND a.subsector <> b.subsector AND greatest(a.lo, b.lo) <= least(a.hi, b.hi)
            WHERE a.review_status = 'confirmado' AND b.review_status = 'confirmado'""")
register("sec_02_sector_in_force", "date:d instrument:s sector:s subsector:s",
         lambda c: sectors.sector_in_force(c.monthly.select("date", "instrument"), c.sectors),
         """SELECT q.date, q.instrument, t.sector, t.subsector FROM x_mq q LEFT JOIN x_sect t
              ON t.instrument = q.instrument AND t.review_status = 'confirmado' AND q.date BETWEEN t.lo AND t.hi""")
register("sec_03_operable", "date:d instrument:s",
         lambda c: sectors.operable_instruments(c.sectors, c.calendar("month").select("date")),
         """SELECT DISTINCT c.date, t.instrument FROM x_mcal c JOIN x_sect t
              ON t.review_status = 'confirmado' AND c.date BETWEEN t.lo AND t.hi""")
register("sec_04_coverage_gaps", "instrument:s start:d end:d status:s",
         lambda c: sectors.coverage_gaps(
             c.sectors.withColumn("valid_to", F.when(F.col("valid_to") == "", "1999-06-30").otherwise(F.col("valid_to")))
             .filter("confidence <> 'baixa' or review_status = 'pendente'"),
             sessions.listing_span(c.daily).select("instrument", F.date_sub("first_date", 90).alias("start"),
                                                   F.col("last_date").alias("end"))),
         """WITH need AS (SELECT instrument, (min(date) - 90)::DATE AS s, max(date) AS e FROM x_dq GROUP BY 1),
                 tab AS (SELECT instrument, review_status, lo, CASE WHEN valid_to = '' THEN DATE '1999-06-30' ELSE hi END AS hi FROM x_sect
                         WHERE confidence <> 'baixa' OR review_status = 'pendente'),
                 days AS (SELECT instrument, s, e, unnest(generate_series(s::TIMESTAMP, e::TIMESTAMP, INTERVAL 1 DAY))::DATE AS d FROM need
                          WHERE instrument IN (SELECT instrument FROM tab WHERE review_status = 'confirmado')),
                 holes AS (SELECT *, d - (row_number() OVER (PARTITION BY instrument ORDER BY d))::INT AS grp FROM days
                           WHERE NOT EXISTS (SELECT 1 FROM tab WHERE tab.instrument = days.instrument AND review_status = 'confirmado' AND d BETWEEN lo AND hi))
            SELECT instrument, s AS start, e AS "end", CASE WHEN instrument IN (SELECT instrument FROM tab) THEN 'sem_confirmacao' ELSE 'sem_linha' END AS status
            FROM need WHERE instrument NOT IN (SELECT instrument FROM tab WHERE review_status = 'confirmado')
            UNION ALL SELECT instrument, min(d), max(d), 'lacuna_temporal' FROM holes GROUP BY instrument, grp""")
