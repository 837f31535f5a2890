"""Named building blocks of the reference SQL.

Written against dense calendar x instrument grids and plain window functions, on purpose a
different formulation from the Spark side, so agreement means something.
"""

from __future__ import annotations

import re

CTES: dict[str, str] = {}


def define(name: str, body: str) -> None:
    CTES[name] = body.strip()


def resolve(sql: str) -> str:
    """Prefix ``sql`` with every block it needs, in dependency order."""
    order: list[str] = []

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"\b[a-z][a-z0-9_]*\b", text)):
            if word in CTES and word not in order:
                visit(CTES[word])
                if word not in order:
                    order.append(word)

    visit(sql)
    if not order:
        return sql
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED (\n{CTES[n]}\n)" for n in order) + "\n" + sql


def of_length(names: str, lengths) -> None:
    """Copies of the named blocks, which build on each other, with training windows of other lengths."""
    for m in lengths:
        for name in names.split():
            body = re.sub(rf"\b({'|'.join(names.split())})\b", rf"\1_{m}", CTES[name])
            define(f"{name}_{m}", body.replace("to_months(24 +", f"to_months({m} +"))


ISSUER = """CASE WHEN regexp_full_match(upper(trim(isin)), '[A-Z]{2}[A-Z0-9]{4}[A-Z0-9]{3}[A-Z0-9]{3}')
     THEN substr(upper(trim(isin)), 3, 4) END"""

define("x_inst", """
SELECT s_suppkey AS suppkey, 'S' || lpad(s_suppkey::VARCHAR, 10, '0') AS instrument, n_name AS name,
       'N' || lpad(s_nationkey::VARCHAR, 3, '0') AS issuer_code, s_acctbal AS acctbal,
       CASE WHEN s_acctbal >= 6000 THEN 'ON' WHEN s_acctbal >= 3000 THEN 'PN' WHEN s_acctbal >= 0 THEN 'UNT' ELSE 'BDR' END AS kind,
       CASE WHEN s_acctbal < -900 THEN '' ELSE 'BR' || 'N' || lpad(s_nationkey::VARCHAR, 3, '0') ||
         CASE WHEN s_acctbal >= 3000 THEN 'ACN' WHEN s_acctbal >= 1500 THEN 'CDA' WHEN s_acctbal >= 0 THEN 'UNT' ELSE 'BDR' END || 'OR0' END AS isin,
       CASE WHEN s_acctbal < -500 THEN '020' ELSE '010' END AS market,
       CASE WHEN s_acctbal < -250 THEN '96' ELSE '02' END AS bdi,
       r_name AS sector, CASE WHEN s_nationkey % 2 = 0 THEN 'par' ELSE 'impar' END AS subsector
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")


def _quotes(day: str) -> str:
    return f"""
SELECT d AS date, instrument, name,
       CASE WHEN marker = '' THEN rpad(kind, 8, ' ') || 'NM' ELSE rpad(kind, 4, ' ') || marker || '  NM' END AS spec,
       kind, isin, market, bdi, open, high, low, volume / quantity AS avg, close, trades, quantity, volume
FROM (SELECT *, CASE WHEN tax < 0.065 THEN '' WHEN flag = 'R' THEN 'ED' WHEN flag = 'A' THEN 'EJ' ELSE '' END AS marker
      FROM (SELECT l_suppkey, {day} AS d,
                   arg_min(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_quantity, l_tax, l_returnflag, round(l_extendedprice * 100)::BIGINT)) AS open,
                   arg_max(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_quantity, l_tax, l_returnflag, round(l_extendedprice * 100)::BIGINT)) AS close,
                   arg_max(l_returnflag, (l_orderkey, l_linenumber, l_quantity, l_tax, l_returnflag, round(l_extendedprice * 100)::BIGINT)) AS flag,
                   arg_max(l_tax, (l_orderkey, l_linenumber, l_quantity, l_tax, l_returnflag, round(l_extendedprice * 100)::BIGINT)) AS tax,
                   max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
                   round(sum(l_extendedprice), 2) AS volume, round(sum(l_quantity), 2) AS quantity, count(*) AS trades
            FROM lineitem GROUP BY 1, 2)) b
JOIN x_inst i ON b.l_suppkey = i.suppkey"""


define("x_dq", _quotes("l_shipdate::DATE"))
define("x_mq", _quotes("date_trunc('month', l_shipdate)::DATE"))
define("x_win", """
SELECT i AS window_id, strftime(te, '%Y-%m') AS win, ts::DATE AS train_start, te::DATE AS train_end,
       te::DATE AS test_start, (te + INTERVAL 3 MONTH)::DATE AS test_end
FROM (SELECT i, DATE '1995-01-01' + to_months(3 * i::INT) AS ts, DATE '1995-01-01' + to_months(24 + 3 * i::INT) AS te
      FROM range(0, 60) r(i)) WHERE te + INTERVAL 3 MONTH <= DATE '2001-12-01'""")
for f in "md":
    define(f"x_{f}cal", f"""
SELECT date, n AS instruments, row_number() OVER (ORDER BY date) - 1 AS pos
FROM (SELECT date, count(DISTINCT instrument) AS n FROM x_{f}q GROUP BY date) WHERE n >= 5""")
    define(f"x_{f}dense", f"""
SELECT c.date, c.pos, i.instrument, q.close, q.open, q.volume, q.trades, coalesce(q.spec, '') AS spec,
       CASE WHEN q.close > 0 THEN q.close END AS p,
       CASE WHEN length(q.spec) > 6 AND substr(q.spec, 5, 1) IN ('E', '*') THEN substr(q.spec, 5, 2) ELSE '' END AS token
FROM x_{f}cal c CROSS JOIN (SELECT DISTINCT instrument FROM x_{f}q) i
LEFT JOIN x_{f}q q ON q.date = c.date AND q.instrument = i.instrument""")
    define(f"x_{f}ret", f"""
SELECT *, p / lag(p) OVER w - 1 AS raw_ret, ln(p / lag(p) OVER w) AS log_ret,
       token <> '' AND token <> lag(token, 1, '') OVER w AS boundary,
       coalesce(volume > 0, false) AND coalesce(lag(volume) OVER w > 0, false) AS both_traded
FROM x_{f}dense WINDOW w AS (PARTITION BY instrument ORDER BY pos)""")
    define(f"x_{f}est", f"""
SELECT date, pos, instrument, CASE WHEN NOT boundary AND both_traded THEN raw_ret END AS ret FROM x_{f}ret""")
    define(f"x_{f}mark", f"""
SELECT date, pos, instrument, m / lag(m) OVER (PARTITION BY instrument ORDER BY pos) - 1 AS ret, p
FROM (SELECT *, last_value(p IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY pos) AS m FROM x_{f}dense)""")

define("x_prof", f"""
SELECT win, instrument, median(volume) AS liquidity, median(trades) AS median_trades, count(DISTINCT date) AS sessions,
       count(*) FILTER (WHERE volume <= 0) AS zero_volume_days, arg_min(iss, date) AS issuer,
       arg_min(kind, date) AS kind, arg_min(name, date) AS name,
       max(date) FILTER (WHERE volume > 0) AS last_traded, any_value(ws) AS window_sessions, any_value(fd) AS formation_date
FROM (SELECT q.*, {ISSUER} AS iss, w.win, w.ws, w.fd FROM x_mq q
      JOIN (SELECT win, train_start, train_end, count(DISTINCT date) AS ws, max(date) AS fd
            FROM x_win JOIN x_mq ON date >= train_start AND date < train_end GROUP BY ALL) w
      ON q.date >= w.train_start AND q.date < w.train_end)
GROUP BY win, instrument""")
define("x_rank", """
SELECT *, CASE WHEN eligible THEN sum(eligible::INT) OVER (PARTITION BY win ORDER BY liquidity DESC, instrument) END AS position
FROM (SELECT *, sessions / window_sessions AS coverage, (sessions - zero_volume_days) / window_sessions AS traded_share,
             coalesce(last_traded = formation_date, false) AS traded_on_final,
             sessions / window_sessions >= 0.95 AND (sessions - zero_volume_days) / window_sessions >= 0.95
               AND sessions >= least(20, window_sessions) AS eligible FROM x_prof)""")
define("x_sel", """
SELECT *, CASE WHEN final_position IS NULL THEN '' WHEN final_position <= 5 THEN 'top5' WHEN final_position <= 10 THEN 'top10'
            WHEN final_position <= 15 THEN 'top15' WHEN final_position <= 25 THEN 'top25' ELSE 'elegivel_fora_top100' END AS band
FROM (SELECT *, CASE WHEN reason = '' THEN sum((reason = '')::INT) OVER (PARTITION BY win ORDER BY liquidity DESC, instrument) END AS final_position
      FROM (SELECT *, CASE WHEN NOT eligible THEN 'nao_elegivel' WHEN NOT traded_on_final THEN 'sem_negociacao_no_pregao_de_formacao'
                       WHEN issuer IS NULL THEN 'isin_invalido' WHEN rk > 1 THEN 'classe_menos_liquida_do_emissor' ELSE '' END AS reason
            FROM (SELECT *, row_number() OVER (PARTITION BY win, issuer, eligible AND traded_on_final ORDER BY liquidity DESC, instrument) AS rk FROM x_rank)))""")
define("x_sect", """
SELECT instrument, issuer_code AS issuer, sector, sub AS subsector, '' AS segment,
       CASE WHEN acctbal < -800 THEN 'Yahoo' ELSE 'bolsa' END AS source, '2001-12-01' AS source_date, 'ficha' AS evidence,
       'nao' AS documented_stability, valid_from, valid_to, CASE WHEN acctbal > 0 THEN 'alta' ELSE 'baixa' END AS confidence,
       CASE WHEN acctbal < -600 THEN 'pendente' ELSE 'confirmado' END AS review_status,
       coalesce(try_cast(valid_from AS DATE), DATE '0001-01-01') AS lo, coalesce(try_cast(valid_to AS DATE), DATE '9999-12-31') AS hi
FROM (SELECT *, '1995-01-01' AS valid_from, CASE WHEN acctbal > 8000 THEN '1997-12-31' ELSE '' END AS valid_to, subsector AS sub FROM x_inst
      UNION ALL SELECT *, '1998-01-01', '', 'novo' FROM x_inst WHERE acctbal > 8000)""")
define("x_selsec", """
SELECT s.* EXCLUDE (reason), coalesce(t.sector, '') AS sector, coalesce(t.subsector, '') AS subsector,
       CASE WHEN s.reason = '' AND s.band LIKE 'top%' AND t.sector IS NULL THEN 'sem_classificacao_confirmada_na_formacao' ELSE s.reason END AS reason
FROM x_sel s LEFT JOIN x_sect t ON s.reason = '' AND s.band LIKE 'top%' AND t.instrument = s.instrument
  AND t.review_status = 'confirmado' AND s.formation_date BETWEEN t.lo AND t.hi""")
define("x_pairs", """
SELECT a.win, a.sector, a.subsector, a.instrument AS leader, b.instrument AS follower, a.issuer AS leader_issuer, b.issuer AS follower_issuer,
       a.final_position AS leader_position, b.final_position AS follower_position, a.liquidity AS leader_liquidity, b.liquidity AS follower_liquidity,
       CASE WHEN b.final_position <= 5 THEN 5 WHEN b.final_position <= 10 THEN 10 WHEN b.final_position <= 15 THEN 15 ELSE 25 END AS min_band
FROM x_selsec a JOIN x_selsec b ON a.win = b.win AND a.sector = b.sector AND a.subsector = b.subsector AND a.final_position < b.final_position
WHERE a.reason = '' AND b.reason = '' AND a.final_position <= 25 AND b.final_position <= 25""")
define("x_slice", """
SELECT win, e.instrument, e.date, e.pos, e.ret FROM x_mest e JOIN x_win w ON e.date >= w.train_start AND e.date < w.train_end""")


def normal_p(z: str) -> str:
    """Two-sided normal tail in SQL (same published approximation)."""
    a = f"abs({z})"
    num, den = "3.52624965998911e-02", "8.83883476483184e-02"
    for c in ("0.700383064443688", "6.37396220353165", "33.912866078383", "112.079291497871", "221.213596169931", "220.206867912376"):
        num = f"({num}*{a}+{c})"
    for c in ("1.75566716318264", "16.064177579207", "86.7807322029461", "296.564248779674", "637.333633378831", "793.826512519948", "440.413735824752"):
        den = f"({den}*{a}+{c})"
    frac = f"({a}+0.65)"
    for k in (4, 3, 2, 1):
        frac = f"({a}+{k}.0/{frac})"
    e = f"exp(-{a}*{a}/2)"
    return f"least(1.0, 2*CASE WHEN {a} < 7.07106781186547 THEN {e}*{num}/{den} WHEN {a} <= 37 THEN {e}/{frac}/2.506628274631 ELSE 0.0 END)"


def ols(rows: str, keys: str, lags: int, min_obs: int, order: str = "pos") -> str:
    """Two-pass least squares with Bartlett-weighted errors over (x, y) rows of ``rows``."""
    k = keys
    ks = [c.strip() for c in keys.split(",")]
    on = " AND ".join(f"r.{c} = m.{c}" for c in ks)
    lag_cols = "".join(f", coalesce(lag(e, {i}) OVER w, 0) AS e{i}, coalesce(lag(u, {i}) OVER w, 0) AS u{i}" for i in range(1, lags + 1))
    wt = lambda i: repr(1 - i / (lags + 1))
    s00 = "e*e" + "".join(f" + 2*{wt(i)}*e*e{i}" for i in range(1, lags + 1))
    s01 = "e*u" + "".join(f" + {wt(i)}*(e*u{i} + e{i}*u)" for i in range(1, lags + 1))
    s11 = "u*u" + "".join(f" + 2*{wt(i)}*u*u{i}" for i in range(1, lags + 1))
    return f"""
SELECT {k}, n, first_date, last_date,
       CASE WHEN n >= {min_obs} THEN beta END AS beta, CASE WHEN n >= {min_obs} THEN my - beta*mx END AS alpha,
       CASE WHEN n >= {min_obs} THEN se END AS std_error, CASE WHEN n >= {min_obs} THEN beta/nullif(se,0) END AS t_stat,
       CASE WHEN n >= {min_obs} THEN {normal_p('(beta/nullif(se,0))')} END AS p_value,
       CASE WHEN n >= {min_obs} THEN 1 - sse/nullif(syy,0) END AS r2,
       CASE WHEN n >= {min_obs} THEN (my - beta*mx)/nullif(sqrt(va),0) END AS alpha_t,
       CASE WHEN n >= {min_obs} THEN {normal_p('((my - beta*mx)/nullif(sqrt(va),0))')} END AS alpha_p
FROM (SELECT *, sqrt(s11)/nullif(sxx,0) AS se,
             greatest(s00/(n*n) - 2*mx*s01/nullif(n*sxx,0) + mx*mx*s11/nullif(sxx*sxx,0), 0) AS va
      FROM (SELECT {k}, any_value(n) AS n, min(date) AS first_date, max(date) AS last_date, any_value(beta) AS beta,
                   any_value(mx) AS mx, any_value(my) AS my, any_value(sxx) AS sxx, any_value(syy) AS syy,
                   sum(e*e) AS sse, sum({s00}) AS s00, sum({s01}) AS s01, greatest(sum({s11}), 0) AS s11
            FROM (SELECT *{lag_cols}
                  FROM (SELECT r.*, m.n, m.mx, m.my, m.sxx, m.syy, m.beta,
                               (y - my) - beta*(x - mx) AS e, ((y - my) - beta*(x - mx))*(x - mx) AS u
                        FROM {rows} r JOIN (
                          SELECT {k}, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x)*count(*) AS sxx, var_pop(y)*count(*) AS syy,
                                 covar_pop(y, x)/nullif(var_pop(x), 0) AS beta FROM {rows} GROUP BY {k}) m ON {on})
                  WINDOW w AS (PARTITION BY {k} ORDER BY {order})) GROUP BY {k}))"""


def xy_rows(pairs: str, slices: str, lags: str, inverted: bool = False) -> str:
    xs, ys = ("follower", "leader") if inverted else ("leader", "follower")
    return f"""
SELECT p.win, p.leader, p.follower, l.lag, y.date, y.pos, x.ret AS x, y.ret AS y
FROM (SELECT DISTINCT win, leader, follower FROM {pairs}) p CROSS JOIN (SELECT unnest([{lags}]) AS lag) l
JOIN {slices} y ON y.win = p.win AND y.instrument = p.{ys} AND y.ret IS NOT NULL
JOIN {slices} x ON x.win = p.win AND x.instrument = p.{xs} AND x.pos = y.pos - l.lag AND x.ret IS NOT NULL"""


define("x_xy", xy_rows("x_pairs", "x_slice", "1"))
define("x_ols", ols("x_xy", "win, leader, follower, lag", 2, 12))


def network(est: str, direction: str = "lider_para_seguidora", lags: str = "1", pairs: str = "x_pairs") -> str:
    return f"""
SELECT p.win, p.sector, p.subsector, p.leader, p.follower, p.min_band, p.leader_position, p.follower_position,
       '{direction}' AS direction, e.beta, e.std_error, e.t_stat, e.p_value, e.alpha, e.r2, coalesce(e.n, 0) AS n, l.lag,
       e.first_date, e.last_date
FROM {pairs} p CROSS JOIN (SELECT unnest([{lags}]) AS lag) l
LEFT JOIN {est} e ON e.win = p.win AND e.leader = p.leader AND e.follower = p.follower AND e.lag = l.lag"""


define("x_net", network("x_ols"))


def bh(src: str, part: str, q: float) -> str:
    return f"""
SELECT * EXCLUDE (m, rk, cut), coalesce(rk <= cut, false) AS approved FROM (
  SELECT *, max(CASE WHEN p_value <= rk*{q}/m THEN rk END) OVER (PARTITION BY {part}) AS cut,
         CASE WHEN p_value IS NOT NULL THEN least(1.0, min(p_value*m/rk) OVER (PARTITION BY {part} ORDER BY rk NULLS LAST
              ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END AS p_adjusted
  FROM (SELECT *, count(p_value) OVER (PARTITION BY {part}) AS m,
               CASE WHEN p_value IS NOT NULL THEN row_number() OVER (PARTITION BY {part} ORDER BY p_value NULLS LAST, leader, follower) END AS rk
        FROM {src}))"""


define("x_ctl", bh("x_net", "win", 0.35))
define("x_tranked", """
SELECT *, row_number() OVER (PARTITION BY win ORDER BY t_stat DESC NULLS LAST, leader, follower) AS tr FROM x_ctl WHERE beta > 0""")
define("x_chosen", """
SELECT *, 'fdr' AS rule FROM x_tranked WHERE approved UNION ALL SELECT *, 'top_k' AS rule FROM x_tranked WHERE tr <= 8""")
