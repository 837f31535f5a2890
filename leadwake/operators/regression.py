"""Lagged least squares with autocorrelation-robust errors, for all pairs of all windows at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from leadwake.config import LeadLag
from leadwake.functions.scalars import normal_two_sided, student_two_sided
from leadwake.operators.sessions import in_windows

FORWARD, INVERTED = "lider_para_seguidora", "invertida"
NETWORK_COLUMNS = ("window", "sector", "subsector", "leader", "follower", "min_band", "leader_position",
                   "follower_position", "direction", "beta", "std_error", "t_stat", "p_value", "alpha",
                   "r2", "n", "lag", "first_date", "last_date")


def member_returns(returns: DataFrame, pairs: DataFrame, windows: DataFrame) -> DataFrame:
    """Training-slice returns of the instruments named by the pairs, one row per window.

    The join key is the instrument; the pair table is bounded by the bands, so it is the small
    side, and only its instruments survive before rows are repeated per window.
    """
    named = (pairs.select("window", F.col("leader").alias("instrument"))
             .unionByName(pairs.select("window", F.col("follower").alias("instrument"))).distinct())
    bounded = named.join(windows.select("window", "train_start", "train_end"), "window")
    return (returns.filter(F.col("ret").isNotNull()).select("instrument", "date", "pos", "ret")
            .join(bounded, "instrument")
            .filter((F.col("date") >= F.col("train_start")) & (F.col("date") < F.col("train_end")))
            .select("window", "instrument", "date", "pos", "ret"))


def paired_rows(sliced: DataFrame, pairs: DataFrame, lags: Sequence[int], inverted: bool = False) -> DataFrame:
    """(x = leader at t-lag, y = follower at t) for every pair, both inside the window slice.

    The lag is position arithmetic inside the slice, so the first ``lag`` sessions of a window
    have no lagged value and a gap stays a gap.
    """
    xs, ys = ("follower", "leader") if inverted else ("leader", "follower")
    keyed = pairs.select("window", "leader", "follower").distinct()
    y = sliced.select("window", F.col("instrument").alias(ys), "date", F.col("pos").alias("pos"), F.col("ret").alias("y"))
    x = sliced.select("window", F.col("instrument").alias(xs), F.col("pos").alias("x_pos"), F.col("ret").alias("x"))
    lag_col = F.explode(F.array(*[F.lit(int(k)) for k in lags]))
    rows = keyed.join(y, ["window", ys]).withColumn("lag", lag_col).withColumn("x_pos", F.col("pos") - F.col("lag"))
    return rows.join(x, ["window", xs, "x_pos"]).drop("x_pos")


def least_squares(rows: DataFrame, keys: Sequence[str], covariance: str = "HAC", max_lag: int = 5,
                  order: str = "pos", min_obs: int = 1) -> DataFrame:
    """alpha, beta, robust errors, r2, n per group of (x, y) rows.

    HAC uses Bartlett weights 1-l/(L+1) over the *valid rows in order*, with no small-sample
    factor; HC3 scales residuals by leverage; "nonrobust" is the classical error.  One shuffle
    on the keys serves the moments (window aggregates), the lagged scores and the final sums.
    """
    by = W.partitionBy(*keys)
    seq = by.orderBy(order)
    base = rows.withColumns({"__n": F.count(F.lit(1)).over(by), "__mx": F.avg("x").over(by), "__my": F.avg("y").over(by)})
    cen = base.withColumns({"__xc": F.col("x") - F.col("__mx"), "__yc": F.col("y") - F.col("__my")})
    mom = cen.withColumns({"__sxx": F.sum(F.col("__xc") * F.col("__xc")).over(by),
                           "__sxy": F.sum(F.col("__xc") * F.col("__yc")).over(by),
                           "__syy": F.sum(F.col("__yc") * F.col("__yc")).over(by)})
    beta = F.try_divide("__sxy", "__sxx")
    res = mom.withColumn("__beta", beta).withColumn("__e", F.col("__yc") - F.col("__beta") * F.col("__xc"))
    sc = res.withColumn("__u", F.col("__e") * F.col("__xc"))
    e, u = F.col("__e"), F.col("__u")
    if covariance == "HAC":
        lagged = {}
        for k in range(1, max_lag + 1):
            lagged[f"__e{k}"] = F.lag("__e", k).over(seq)
            lagged[f"__u{k}"] = F.lag("__u", k).over(seq)
        sc = sc.withColumns(lagged) if lagged else sc
        s00, s01, s11 = e * e, e * u, u * u
        for k in range(1, max_lag + 1):
            w = 1.0 - k / (max_lag + 1.0)
            ek, uk = F.coalesce(f"__e{k}", F.lit(0.0)), F.coalesce(f"__u{k}", F.lit(0.0))
            s00 = s00 + 2 * w * e * ek
            s01 = s01 + w * (e * uk + ek * u)
            s11 = s11 + 2 * w * u * uk
    elif covariance == "HC3":
        h = 1 / F.col("__n") + F.try_divide(F.col("__xc") * F.col("__xc"), F.col("__sxx"))
        scale = F.try_divide(F.lit(1.0), (1 - h) * (1 - h))
        s00, s01, s11 = e * e * scale, e * u * scale, u * u * scale
    elif covariance == "nonrobust":
        s00 = s01 = s11 = e * e
    else:
        raise ValueError(f"unknown covariance {covariance!r}")
    agg = sc.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.first("__mx").alias("mx"), F.first("__my").alias("my"), F.first("__sxx").alias("sxx"),
        F.first("__syy").alias("syy"), F.first("__beta").alias("beta"), F.sum(e * e).alias("sse"),
        F.sum(s00).alias("s00"), F.sum(s01).alias("s01"), F.sum(s11).alias("s11"))
    n, mx, sxx = F.col("n"), F.col("mx"), F.col("sxx")
    if covariance == "nonrobust":
        s2 = F.try_divide(F.col("sse"), n - 2)
        var_b = F.try_divide(s2, sxx)
        var_a = s2 * (1 / n + F.try_divide(mx * mx, sxx))
    else:
        var_b = F.try_divide(F.col("s11"), sxx * sxx)
        var_a = (F.col("s00") / (n * n) - 2 * mx * F.try_divide(F.col("s01"), n * sxx)
                 + mx * mx * F.try_divide(F.col("s11"), sxx * sxx))
    est = agg.withColumns({
        "alpha": F.col("my") - F.col("beta") * mx,
        "std_error": F.when(var_b >= 0, F.sqrt(var_b)), "alpha_se": F.when(var_a >= 0, F.sqrt(var_a)),
        "r2": 1 - F.try_divide(F.col("sse"), F.col("syy"))})
    est = est.withColumns({"t_stat": F.try_divide("beta", "std_error"), "alpha_t": F.try_divide("alpha", "alpha_se")})
    tail = (lambda c: student_two_sided(F.col(c), F.col("n") - 2)) if covariance == "nonrobust" else (lambda c: normal_two_sided(F.col(c)))
    est = est.withColumns({"p_value": tail("t_stat"), "alpha_p": tail("alpha_t")})
    enough = n >= min_obs
    stats = ("alpha", "beta", "std_error", "t_stat", "p_value", "alpha_se", "alpha_t", "alpha_p", "r2")
    return est.select(*keys, "n", "first_date", "last_date", *[F.when(enough, F.col(c)).alias(c) for c in stats])


def mean_hac(rows: DataFrame, keys: Sequence[str], value: str, max_lag: int, order: str = "pos",
             min_obs: int = 30) -> DataFrame:
    """Newey-West t of a mean per group."""
    by = W.partitionBy(*keys)
    seq = by.orderBy(order)
    dev = rows.filter(F.col(value).isNotNull()).withColumn("__e", F.col(value) - F.avg(value).over(by))
    e = F.col("__e")
    s = e * e
    for k in range(1, max_lag + 1):
        s = s + 2 * (1.0 - k / (max_lag + 1.0)) * e * F.coalesce(F.lag("__e", k).over(seq), F.lit(0.0))
    out = (dev.withColumn("__s", s).groupBy(*keys)
           .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.sum("__s").alias("s00")))
    se = F.when(F.col("s00") > 0, F.sqrt("s00") / F.col("n"))
    t = F.try_divide(F.col("mean"), se)
    ok = F.col("n") >= min_obs
    return out.select(*keys, "n", F.when(ok, F.col("mean")).alias("mean"), F.when(ok, t).alias("t"),
                      F.when(ok, normal_two_sided(t)).alias("p"))


def estimate_network(returns: DataFrame, pairs: DataFrame, windows: DataFrame, cfg: LeadLag | None = None,
                     lags: Sequence[int] | None = None, inverted: bool = False) -> DataFrame:
    """One row per pair (and lag): the estimate and its context; pairs without rows get n = 0."""
    cfg = cfg or LeadLag()
    lags = (cfg.lag,) if lags is None else tuple(lags)
    return network_from_slices(member_returns(returns, pairs, windows), pairs, cfg, lags, inverted)


def network_from_slices(sliced: DataFrame, pairs: DataFrame, cfg: LeadLag, lags: Sequence[int],
                        inverted: bool = False) -> DataFrame:
    keys = ["window", "leader", "follower", "lag"]
    est = least_squares(paired_rows(sliced, pairs, lags, inverted), keys, cfg.covariance, cfg.hac_lags,
                        min_obs=cfg.min_observations)
    context = pairs.withColumn("lag", F.explode(F.array(*[F.lit(int(k)) for k in lags])))
    return (context.join(est, keys, "left")
            .withColumns({"n": F.coalesce("n", F.lit(0)),
                          "direction": F.lit(INVERTED if inverted else FORWARD)})
            .select(*NETWORK_COLUMNS))


def batch_betas(sliced: DataFrame, pairs: DataFrame, lag: int, min_obs: int) -> DataFrame:
    """Beta and classical t from moments; one hash aggregate, no residual pass."""
    rows = paired_rows(sliced, pairs, [lag])
    m = rows.groupBy("window", "leader", "follower").agg(
        F.count(F.lit(1)).alias("n"), F.covar_pop("x", "y").alias("cxy"),
        F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"))
    n = F.col("n")
    beta = F.try_divide("cxy", "vx")
    resid = n * (F.col("vy") - beta * F.col("cxy")) / F.when(n > 2, n - 2).otherwise(1)
    se = F.sqrt(F.greatest(F.try_divide(resid, n * F.col("vx")), F.lit(0.0)))
    ok = n >= min_obs
    got = m.select("window", "leader", "follower", "n", F.when(ok, beta).alias("beta"),
                   F.when(ok, F.try_divide(beta, se)).alias("t_stat"))
    return (pairs.select("window", "leader", "follower").join(got, ["window", "leader", "follower"], "left")
            .withColumn("n", F.coalesce("n", F.lit(0))))


def always_traded(panel: DataFrame, calendar: DataFrame, windows: DataFrame) -> DataFrame:
    """(window, instrument) with volume on every session of the training window."""
    need = in_windows(calendar.select("date"), windows).groupBy("window").agg(F.count(F.lit(1)).alias("need"))
    have = (in_windows(panel.filter(F.col("volume") > 0), windows).groupBy("window", "instrument")
            .agg(F.count_distinct("date").alias("have")))
    return have.join(need, "window").filter(F.col("have") == F.col("need")).select("window", "instrument")


def pairs_always_traded(pairs: DataFrame, always: DataFrame) -> DataFrame:
    lead = always.select("window", F.col("instrument").alias("leader"))
    foll = always.select("window", F.col("instrument").alias("follower"))
    return pairs.join(lead, ["window", "leader"], "left_semi").join(foll, ["window", "follower"], "left_semi")
