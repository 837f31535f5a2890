"""Building blocks for positions, costs and inference."""

from leadwake.oracle.ctes import define

define("x_vol", """
SELECT pos, instrument, CASE WHEN count(ret) OVER w >= 6 THEN stddev_samp(ret) OVER w * sqrt(252.0) END AS vol FROM x_mmark
WINDOW w AS (PARTITION BY instrument ORDER BY pos ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""")
define("x_sig", """
SELECT h.*, m AS mode, v.vol, CASE WHEN ret IS NULL THEN 'sem_retorno_sinal' WHEN v.vol IS NULL OR v.vol <= 0 THEN 'sem_vol' ELSE 'ok' END AS status
FROM (SELECT s.rule, s.win, s.leader, s.follower, e.date, e.pos, e.ret, sign(e.ret) AS direction
      FROM x_chosen s JOIN x_win w ON w.win = s.win JOIN x_mest e ON e.instrument = s.leader AND e.date >= w.test_start AND e.date < w.test_end
      JOIN x_mq q ON q.instrument = e.instrument AND q.date = e.date) h
CROSS JOIN (SELECT unnest(['long_short', 'long_only']) AS m)
LEFT JOIN x_vol v ON v.instrument = h.follower AND v.pos = h.pos
WHERE (ret IS NULL OR ret <> 0) AND (ret IS NULL OR m <> 'long_only' OR direction > 0)""")
define("x_coh", """
SELECT rule, mode, win, pos, follower AS instrument,
       sign(raw) * least(coalesce(abs(raw) / nullif(sum(abs(raw)) OVER (PARTITION BY rule, mode, win, pos), 0), 0), 0.1) AS weight
FROM (SELECT rule, mode, win, pos, follower, sum(direction / vol) AS raw FROM x_sig WHERE status = 'ok' GROUP BY ALL)""")
define("x_pos", """
SELECT rule, mode, c.pos + 1 + s AS pos, cal.date, instrument, sum(weight / 3) AS weight
FROM x_coh c CROSS JOIN (SELECT unnest([0, 1, 2]) AS s) JOIN x_mcal cal ON cal.pos = c.pos + 1 + s GROUP BY ALL""")
define("x_bookday", """
SELECT k.rule, k.mode, c.pos, c.date FROM (SELECT DISTINCT rule, mode FROM x_pos) k CROSS JOIN x_mcal c""")
define("x_densepos", """
SELECT d.rule, d.mode, d.pos, d.date, i.instrument, coalesce(p.weight, 0) AS weight,
       lag(coalesce(p.weight, 0), 1, 0) OVER (PARTITION BY d.rule, d.mode, i.instrument ORDER BY d.pos) AS held, m.ret
FROM x_bookday d CROSS JOIN (SELECT DISTINCT instrument FROM x_pos) i
LEFT JOIN x_pos p ON p.rule = d.rule AND p.mode = d.mode AND p.pos = d.pos AND p.instrument = i.instrument
LEFT JOIN x_mmark m ON m.pos = d.pos AND m.instrument = i.instrument""")
define("x_book", """
SELECT *, turnover * 13.25 / 1e4 AS turnover_cost, short_exposure * 0.05 / 252 AS borrow_cost,
       gross_pnl - turnover * 13.25 / 1e4 - short_exposure * 0.05 / 252 AS net_pnl
FROM (SELECT rule, mode, pos, date, sum(held * coalesce(ret, 0)) AS gross_pnl,
             sum(greatest(held, 0) * coalesce(ret, 0)) AS long_leg, sum(least(held, 0) * coalesce(ret, 0)) AS short_leg,
             count(*) FILTER (WHERE held <> 0 AND ret IS NULL) AS missing_returns, sum(abs(weight - held)) AS turnover,
             sum(abs(weight)) AS gross_exposure, sum(weight) AS net_exposure, sum(abs(least(weight, 0))) AS short_exposure
      FROM x_densepos GROUP BY ALL)""")
define("x_bench", """
SELECT date, v / lag(v) OVER (ORDER BY date) - 1 AS bench FROM (
  SELECT date, round(sum(volume), 2) / round(sum(quantity), 2) AS v FROM x_mq GROUP BY date)""")
define("x_ord", """
SELECT a.win, a.sector, a.subsector, a.instrument AS leader, b.instrument AS follower
FROM x_selsec a JOIN x_selsec b ON a.win = b.win AND a.sector = b.sector AND a.subsector = b.subsector AND a.instrument <> b.instrument AND a.issuer <> b.issuer
WHERE a.reason = '' AND b.reason = '' AND a.final_position <= 25 AND b.final_position <= 25""")
