"""Networks of many training lengths from one pass over the pairs' rows.

For a pair, ordinary least squares and its autocorrelation-robust errors are functions of the sums of v v' and v v(k back)'
with v = (1, x, y, x^2, x y): residuals and scores are linear in v.  These sums are taken once per month.  Those of any
window from month to month are a difference of running sums, whatever its length and however many windows overlap:

    rows before the end, by the day of y,  less  rows whose x, or whose row k back, lies before the start.

A row counts in a window only with its x inside, and a product k back only with both rows inside, as the month borders require.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from leadwake.functions.scalars import normal_two_sided
from leadwake.operators.checks import require

_PAIR = ["leader", "follower"]
_V = 5
_CELLS = [(i, j) for i in range(_V) for j in range(_V)]


def lagged_rows(returns: DataFrame, pairs: DataFrame, lag: int) -> DataFrame:
    """(x = leader ``lag`` sessions before, y = follower) of every pair once, over the whole period."""
    r = returns.filter("ret is not null")
    y = r.select(F.col("instrument").alias("follower"), "date", "pos", F.col("ret").alias("y"))
    x = r.select(F.col("instrument").alias("leader"), F.col("date").alias("x_date"), (F.col("pos") + lag).alias("pos"), F.col("ret").alias("x"))
    return pairs.select(*_PAIR).distinct().join(y, "follower").join(x, ["leader", "pos"])


def monthly_sums(rows: DataFrame, max_lag: int) -> DataFrame:
    """leader, follower, month, side, k, c0..c24: sums of v v(k back)' by month; side 1 by the day of y, side -1 by the day of
    the x that must lie inside a window.  Partial sums merge, and a pair has at most one row per month, side and k."""
    seq = W.partitionBy(*_PAIR).orderBy("pos")
    lagged = rows.withColumns({f"{c}{k}": F.lag(c, k).over(seq) for k in range(1, max_lag + 1) for c in ("x", "y", "x_date")})
    parts = []
    for k in range(max_lag + 1):
        back = {c: F.col(f"{c}{k}" if k else c) for c in ("x", "y", "x_date")}
        for side, day in ((1, F.col("date")), (-1, back["x_date"])):
            parts.append(F.struct(F.lit(side).alias("side"), F.lit(k).alias("k"), F.trunc(day, "month").alias("month"), back["x"].alias("bx"), back["y"].alias("by")))
    spread = lagged.select(*_PAIR, "x", "y", F.explode(F.array(*parts)).alias("p")).select(*_PAIR, "x", "y", "p.*").filter("bx is not null")

    def v(x: Column, y: Column) -> list[Column]:
        return [F.lit(1.0), x, y, x * x, x * y]

    now, back = v(F.col("x"), F.col("y")), v(F.col("bx"), F.col("by"))
    return spread.groupBy(*_PAIR, "month", "side", "k").agg(*[F.sum(now[i] * back[j]).alias(f"c{n}") for n, (i, j) in enumerate(_CELLS)])


def window_sums(months: DataFrame, wanted: DataFrame, max_lag: int) -> DataFrame:
    """Per wanted (window, leader, follower; train_start, train_end on firsts of a month): s{k}_{cell} of its training rows.

    Borders are put among the months of their pair, and one running sum serves all of them.
    """
    wanted = require(wanted, (F.dayofmonth("train_start") != 1) | (F.dayofmonth("train_end") != 1), F.concat(F.lit("window does not begin and end with a month: "), "window"))
    cells = [f"c{n}" for n in range(len(_CELLS))]
    border = F.explode(F.array(*[F.struct(F.lit(side).alias("side"), F.lit(k).alias("k"), F.col(day).alias("month"))
                                 for k in range(max_lag + 1) for side, day in ((1, "train_end"), (-1, "train_start"))]))
    borders = wanted.select("window", *_PAIR, border.alias("b")).select("window", *_PAIR, "b.*", F.lit(0).alias("kind"), *[F.lit(0.0).alias(c) for c in cells])
    events = months.withColumns({"kind": F.lit(1), "window": F.lit(None).cast("string")}).unionByName(borders)
    before = W.partitionBy(*_PAIR, "side", "k").orderBy("month", "kind").rowsBetween(W.unboundedPreceding, 0)
    running = events.select("window", *_PAIR, "side", "k", "kind", *[F.sum(c).over(before).alias(c) for c in cells]).filter("kind = 0")
    return running.groupBy("window", *_PAIR).agg(*[
        F.sum(F.when(F.col("k") == k, F.col("side") * F.col(c))).alias(f"s{k}_{c}") for k in range(max_lag + 1) for c in cells])


def estimates(sums: DataFrame, max_lag: int, min_obs: int) -> DataFrame:
    """window, leader, follower, n, beta, alpha, r2, std_error, t_stat, p_value, alpha_t from the window sums."""
    def s(k: int, i: int, j: int) -> Column:
        return F.col(f"s{k}_c{i * _V + j}")

    n = s(0, 0, 0)
    base = sums.withColumns({"n": F.round(n).cast("long"), "mx": F.try_divide(s(0, 0, 1), n), "my": F.try_divide(s(0, 0, 2), n)})
    mx, my = F.col("mx"), F.col("my")
    base = base.withColumns({"sxx": s(0, 1, 1) - n * mx * mx, "sxy": s(0, 1, 2) - n * mx * my, "syy": s(0, 2, 2) - n * my * my})
    base = base.withColumn("beta", F.try_divide("sxy", "sxx")).withColumn("alpha", my - F.col("beta") * mx)
    a, b = F.col("alpha"), F.col("beta")
    residual: Sequence = (-a, -b, F.lit(1.0), None, None)
    score: Sequence = (mx * a, mx * b - a, -mx, -b, F.lit(1.0))

    def form(k: int, left: Sequence, right: Sequence) -> Column:
        return sum((left[i] * right[j] * s(k, i, j) for i, j in _CELLS if left[i] is not None and right[j] is not None), F.lit(0.0))

    w = [1.0 - k / (max_lag + 1.0) for k in range(max_lag + 1)]
    back = range(1, max_lag + 1)
    base = base.withColumns({
        "s11": form(0, score, score) + sum((2 * w[k] * form(k, score, score) for k in back), F.lit(0.0)),
        "s00": form(0, residual, residual) + sum((2 * w[k] * form(k, residual, residual) for k in back), F.lit(0.0)),
        "s01": form(0, residual, score) + sum((w[k] * (form(k, residual, score) + form(k, score, residual)) for k in back), F.lit(0.0))})
    sxx, m = F.col("sxx"), F.col("n")
    var_b = F.try_divide(F.col("s11"), sxx * sxx)
    var_a = F.col("s00") / (m * m) - 2 * mx * F.try_divide(F.col("s01"), m * sxx) + mx * mx * var_b
    est = base.withColumns({"std_error": F.when(var_b >= 0, F.sqrt(var_b)), "alpha_se": F.when(var_a >= 0, F.sqrt(var_a)),
                            "r2": F.try_divide(b * F.col("sxy"), "syy")})
    est = est.withColumns({"t_stat": F.try_divide("beta", "std_error"), "alpha_t": F.try_divide("alpha", "alpha_se")}).withColumn("p_value", normal_two_sided(F.col("t_stat")))
    return est.select("window", *_PAIR, "n", *[F.when(m >= min_obs, F.col(c)).alias(c) for c in ("beta", "alpha", "r2", "std_error", "t_stat", "p_value", "alpha_t")])


def network_of_lengths(returns: DataFrame, pairs: DataFrame, windows: DataFrame, lag: int, max_lag: int, min_obs: int) -> DataFrame:
    """The lagged regression of every (window, leader, follower) of ``pairs``; windows may be of any length and overlap.

    A pair without rows in a window has n = 0.
    """
    rows = lagged_rows(returns, pairs, lag)
    wanted = pairs.select("window", *_PAIR).distinct().join(windows.select("window", "train_start", "train_end"), "window")
    est = estimates(window_sums(monthly_sums(rows, max_lag), wanted, max_lag), max_lag, min_obs)
    return pairs.join(est, ["window", *_PAIR], "left").withColumn("n", F.coalesce("n", F.lit(0)))
