"""Point-in-time liquidity universe per walk-forward window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leadwake.config import Liquidity
from leadwake.functions.scalars import band_of, issuer_of
from leadwake.operators.ranking import running_counts
from leadwake.operators.sessions import in_windows
from leadwake.session import materialize

NOT_ELIGIBLE = "nao_elegivel"
NOT_TRADED_AT_FORMATION = "sem_negociacao_no_pregao_de_formacao"
BAD_ISIN = "isin_invalido"
LESS_LIQUID_CLASS = "classe_menos_liquida_do_emissor"
NO_SECTOR = "sem_classificacao_confirmada_na_formacao"

# Exclusive states of an (instrument, date) against the universes.
NO_WINDOW = "sem_janela_na_data"
ABSENT = "ausente_da_janela"
NOT_ELIGIBLE_IN_WINDOW = "nao_elegivel_na_janela"
ELIGIBLE_OUTSIDE = "elegivel_fora_top100"


def _median(values: Column) -> Column:
    """Exact median of an array; nulls don't count."""
    v = F.sort_array(F.array_compact(values))
    n = F.size(v)
    return F.when(n > 0, F.get(v, F.floor((n - 1) / 2).cast("int")) * 0.5 + F.get(v, F.floor(n / 2).cast("int")) * 0.5)


def liquidity_profile(quotes: DataFrame, windows: DataFrame, cfg: Liquidity) -> DataFrame:
    """Per (window, instrument): liquidity, sessions, coverage, eligibility.

    Reads only rows of ``[train_start, train_end)``.  Quotes are unique per (date, instrument), which the value audit
    enforces, so sessions are plain counts.  Windows overlap, so a quote counts in many of them; quotes are dealt out once, by
    instrument, as one array a calendar long at most, and every window takes its slice.  No row per quote and window exists.
    The session count and final session of a window come from the distinct dates.
    """
    dates = in_windows(quotes.select("date").distinct(), windows, "train")
    span = dates.groupBy("window").agg(F.count(F.lit(1)).alias("window_sessions"),
                                       F.max("date").alias("formation_date"))
    spans = windows.select("window", "train_start", "train_end").join(span, "window")  # a row per window
    day = F.struct("date", "volume", "trades", issuer_of(F.col("isin")).alias("issuer"), "kind", "name")
    lives = (quotes.select("instrument", day.alias("day")).repartition("instrument")
             .groupBy("instrument").agg(F.array_sort(F.collect_list("day")).alias("days")))
    inside = F.filter("days", lambda d: (d["date"] >= F.col("train_start")) & (d["date"] < F.col("train_end")))
    rows = lives.crossJoin(F.broadcast(spans)).withColumn("days", inside).filter(F.size("days") > 0)
    volume = F.transform("days", lambda d: d["volume"])
    mean = F.aggregate(F.array_compact(volume), F.lit(0.0), lambda acc, v: acc + v) / F.nullif(F.size(F.array_compact(volume)), F.lit(0))
    first = F.get("days", F.lit(0))
    traded = F.exists("days", lambda d: (d["volume"] > 0) & (d["date"] == F.col("formation_date")))
    per = rows.select(
        "window", "instrument", (_median(volume) if cfg.statistic == "median" else mean).alias("liquidity"),
        _median(F.transform("days", lambda d: d["trades"])).alias("median_trades"),
        F.size("days").cast("long").alias("sessions"),
        F.size(F.filter("days", lambda d: d["volume"] <= 0)).cast("long").alias("zero_volume_days"),
        first["issuer"].alias("issuer"), first["kind"].alias("kind"), first["name"].alias("name"),
        "window_sessions", "formation_date", F.coalesce(traded, F.lit(False)).alias("traded_on_final"))
    cov = F.col("sessions") / F.col("window_sessions")
    share = (F.col("sessions") - F.col("zero_volume_days")) / F.col("window_sessions")
    return per.withColumns({
        "coverage": cov, "traded_share": share,
        "eligible": (cov >= cfg.min_coverage) & (share >= cfg.min_traded_share)
                    & (F.col("sessions") >= F.least(F.lit(cfg.min_sessions), F.col("window_sessions")))})


def _order():
    return F.col("liquidity").desc(), F.col("instrument").asc()


def liquidity_ranking(quotes: DataFrame, windows: DataFrame, cfg: Liquidity) -> DataFrame:
    """Liquidity profile plus the position counted among eligible instruments only."""
    return running_counts(liquidity_profile(quotes, windows, cfg), ["window"], _order(),
                          {"position": F.col("eligible")})


def select_universe(quotes: DataFrame, windows: DataFrame, cfg: Liquidity) -> DataFrame:
    """Ranking, one class per issuer, exclusion reasons, final position and band.

    The profile is stored, because winners and ranking both read it.  The winner per (window, issuer) is a min aggregate, so an issuer with very many classes is
    combined map-side instead of being sorted in one task.
    """
    prof = materialize(liquidity_profile(quotes, windows, cfg))
    alive = F.col("eligible") & F.col("traded_on_final")
    base = (F.when(~F.col("eligible"), NOT_ELIGIBLE)
            .when(~F.col("traded_on_final"), NOT_TRADED_AT_FORMATION))
    if cfg.one_per_issuer:
        best = (prof.filter(alive & F.col("issuer").isNotNull())
                .groupBy("window", "issuer")
                .agg(F.min_by("instrument", F.struct((-F.col("liquidity")).alias("l"), "instrument")).alias("winner")))
        prof = prof.join(best, ["window", "issuer"], "left")
        reason = (base.when(F.col("issuer").isNull(), BAD_ISIN)
                  .when(F.col("instrument") != F.col("winner"), LESS_LIQUID_CLASS).otherwise(""))
    else:
        prof = prof.withColumn("winner", F.lit(None).cast("string"))
        reason = base.otherwise("")
    ranked = running_counts(prof.withColumn("reason", reason).drop("winner"), ["window"], _order(),
                            {"position": F.col("eligible"), "final_position": F.col("reason") == ""})
    return ranked.withColumn("band", F.when(
        F.col("final_position").isNotNull(), band_of(F.col("final_position"), cfg.bands)).otherwise(""))


def best_positions(ranking: DataFrame) -> DataFrame:
    """Best position over all windows, and the (first) window that reached it."""
    e = ranking.filter("eligible")
    return e.groupBy("instrument").agg(
        F.min("position").alias("best_position"), F.count(F.lit(1)).alias("windows_eligible"),
        F.max("liquidity").alias("max_liquidity"),
        F.min_by("window", F.struct("position", "window")).alias("best_window"))


def exclusion_funnel(selection: DataFrame) -> DataFrame:
    return selection.groupBy("window", "reason").agg(F.count(F.lit(1)).alias("instruments"))


def universe_reach(occurrences: DataFrame, ranking: DataFrame, windows: DataFrame, cfg: Liquidity) -> DataFrame:
    """Where (instrument, date) occurrences fall against the point-in-time universes.

    Three readings: windows whose training holds the date, whose test holds it, and any window.
    """
    top = max(cfg.bands)
    rk = ranking.select("window", "instrument", "eligible", "position")

    def reading(prefix: str, part: str) -> DataFrame:
        hits = in_windows(occurrences.select("instrument", "date").distinct(), windows, part)
        joined = hits.join(rk, ["window", "instrument"], "left")
        return joined.groupBy("instrument", "date").agg(
            F.count(F.lit(1)).alias(f"{prefix}_windows"),
            F.min(F.when(F.col("eligible"), F.col("position"))).alias(f"{prefix}_position"),
            F.coalesce(F.bool_or("eligible"), F.lit(False)).alias(f"{prefix}_elig"),
            F.bool_or(F.col("eligible").isNotNull()).alias(f"{prefix}_present"))

    anywhere = rk.groupBy("instrument").agg(
        F.min(F.when(F.col("eligible"), F.col("position"))).alias("any_position"),
        F.bool_or("eligible").alias("any_elig"), F.lit(True).alias("any_present"))

    def status(prefix: str, has_window) -> F.Column:
        p = F.col(f"{prefix}_position")
        return (F.when(~has_window, NO_WINDOW)
                .when(p <= top, band_of(p, cfg.bands))
                .when(F.coalesce(F.col(f"{prefix}_elig"), F.lit(False)), ELIGIBLE_OUTSIDE)
                .when(F.coalesce(F.col(f"{prefix}_present"), F.lit(False)), NOT_ELIGIBLE_IN_WINDOW)
                .otherwise(ABSENT))

    out = (occurrences.join(reading("train", "train"), ["instrument", "date"], "left")
           .join(reading("test", "test"), ["instrument", "date"], "left")
           .join(anywhere, "instrument", "left"))
    n_train = F.coalesce(F.col("train_windows"), F.lit(0))
    n_test = F.coalesce(F.col("test_windows"), F.lit(0))
    return out.select(
        *occurrences.columns, F.col("any_position"), status("any", F.lit(True)).alias("any_status"),
        status("train", n_train > 0).alias("train_status"), F.col("train_position"),
        status("test", n_test > 0).alias("test_status"), F.col("test_position"),
        n_train.alias("train_windows"), n_test.alias("test_windows"),
        F.coalesce(F.col("train_position") <= top, F.lit(False)).alias("may_affect_estimation"),
        F.coalesce(F.col("test_position") <= top, F.lit(False)).alias("may_affect_signal"))


def cumulative_reach(reach: DataFrame, position: str, bands: tuple[int, ...]) -> DataFrame:
    """How many occurrences reach each band, cumulatively."""
    agg = reach.agg(*[F.count_if(F.col(position) <= b).alias(f"top{b}") for b in sorted(bands)])
    return agg.unpivot([], [f"top{b}" for b in sorted(bands)], "band", "occurrences")
