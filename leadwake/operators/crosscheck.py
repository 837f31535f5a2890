"""Comparisons of the exchange record with an external price source."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from leadwake.operators.ranking import running_counts
from leadwake.operators.returns import event_boundaries, previous, simple_returns, traded_both_sessions
from leadwake.session import materialize

# Fixed values of the calibrated comparison.
MAX_MEDIAN_ERROR, MAX_P95_ERROR, MIN_CORRELATION, STEP_DISPERSION = 1e-05, 0.02, 0.95, 0.05
# The search for near copies: values of a block's matrix (20 MB), series of a block, and rows of the products taken at once.  A
# series is sent once per block, so blocks are as large as these allow; with few series they are this many, for parallel work.
VALUES_PER_BLOCK, SERIES_PER_BLOCK, PRODUCT_ROWS, BLOCKS = 2_560_000, 16_384, 256, 24
# Evidence cut-offs and round split factors.
MIN_BOUNDARIES, MATERIAL_ERROR, MIXED_SHARE = 30, 0.0010, 0.10
SPLIT_FACTORS = (2, 3, 4, 5, 6, 8, 10, 15, 20, 25, 50, 100)


def align_reference(series: DataFrame, calendar: DataFrame) -> DataFrame:
    """External series on session dates; the last loaded row of a duplicated date wins."""
    w = W.partitionBy("instrument", "date").orderBy(F.col("load_order").desc())
    one = series.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r", "load_order")
    return one.join(calendar.select("date", "pos"), "date")


def validation_metrics(quotes: DataFrame, reference: DataFrame, candidates: DataFrame, edge: int = 3,
                       min_rows: int = 30) -> DataFrame:
    """Old code's record against the series delivered under the new code, per candidate.

    ``reference``: instrument, date, price, dividend, split.  Returns are taken over the joined
    rows.  Events, untraded days (and the row after each) and both ends are left out.
    """
    key = ["old", "new"]
    seq = W.partitionBy(*key).orderBy("date")
    back = W.partitionBy(*key).orderBy(F.col("date").desc())
    j = (candidates.select(*key).join(quotes.select(F.col("instrument").alias("old"), "date", "close", "volume", "trades"), "old")
         .join(reference.select(F.col("instrument").alias("new"), "date", "price", "dividend", "split"), ["new", "date"])
         .filter("price is not null and close is not null"))
    event = (F.coalesce("dividend", F.lit(0.0)) != 0) | (F.coalesce("split", F.lit(0.0)) != 0)
    idle = (F.coalesce("volume", F.lit(0.0)) <= 0) | (F.coalesce("trades", F.lit(0)) <= 0)
    rows = j.withColumns({
        "ratio": F.col("price") / F.col("close"), "r_ref": F.col("price") / F.lag("price").over(seq) - 1,
        "r_rec": F.col("close") / F.lag("close").over(seq) - 1, "ev": event, "idle": idle,
        "front": F.row_number().over(seq), "rear": F.row_number().over(back)})
    rows = rows.withColumn("skip", F.col("ev") | F.lag("ev", 1, False).over(seq) | F.col("idle") | F.lag("idle", 1, False).over(seq)
                           | (F.col("front") <= edge) | (F.col("rear") <= edge))
    ok = ~F.col("skip") & F.col("r_ref").isNotNull() & F.col("r_rec").isNotNull()
    d = F.when(ok, F.abs(F.col("r_ref") - F.col("r_rec")))
    m = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("overlap"), F.count_if("skip").alias("skipped"), F.median("ratio").alias("med"),
        F.stddev_samp("ratio").alias("sd"), F.count(d).alias("used"),
        F.corr(F.when(ok, F.col("r_ref")), F.when(ok, F.col("r_rec"))).alias("c"),
        F.median(d).alias("e50"), F.percentile(d, F.lit(0.95)).alias("e95"))
    m = candidates.select(*key).join(m, key, "left").withColumn("overlap", F.coalesce("overlap", F.lit(0)))
    big, full = F.col("overlap") >= min_rows, (F.col("overlap") >= min_rows) & (F.col("used") >= min_rows)
    return m.select(*key, "overlap", F.when(big, F.col("skipped")).otherwise(0).alias("skipped"),
                    F.when(big, F.col("med")).alias("ratio_median"), F.when(big, F.try_divide("sd", "med")).alias("ratio_dispersion"),
                    F.when(full, F.col("c")).alias("correlation"), F.when(full, F.col("e50")).alias("error_median"),
                    F.when(full, F.col("e95")).alias("error_p95"),
                    F.when(full, "calculado").otherwise("inconclusivo_pouca_amostra").alias("state"))


def classify_validation(metrics: DataFrame) -> DataFrame:
    """Category and readable reasons; returns decide, a price step is only context."""
    e, p95, c, disp = F.col("error_median"), F.col("error_p95"), F.col("correlation"), F.col("ratio_dispersion")
    reasons = F.concat_ws("; ", F.array_compact(F.array(
        F.when(e > MAX_MEDIAN_ERROR, F.lit("erro mediano acima do limite")),
        F.when(p95 > MAX_P95_ERROR, F.lit("p95 do erro acima do limite")),
        F.when(c < MIN_CORRELATION, F.lit("correlacao abaixo do limite")))))
    out = metrics.withColumn("__fail", reasons)
    missing = (F.col("state") != "calculado") | e.isNull() | c.isNull()
    category = (F.when(missing, "inconclusivo").when(F.col("__fail") != "", "retornos_divergentes")
                .when(disp > STEP_DISPERSION, "retornos_consistentes_com_quebra_escala")
                .otherwise("retornos_consistentes_sem_quebra_escala"))
    reason = (F.when((F.col("state") != "calculado") & (F.col("overlap") == 0), "serie nao cobre o periodo do codigo antigo")
              .when(F.col("state") != "calculado", F.concat(F.lit("apenas "), F.col("overlap").cast("string"), F.lit(" datas sobrepostas")))
              .when(missing, "metricas de retorno indisponiveis").otherwise(F.col("__fail")))
    return out.withColumns({"category": category, "reason": reason}).drop("__fail")


def source_coverage(quotes: DataFrame, reference: DataFrame, states: DataFrame, complete: float = 0.98) -> DataFrame:
    """Traded and priced session counts per instrument, and the coverage situation.

    ``states``: instrument, failed, blocked, terminal (null when none).  Coverage is the
    intersection over traded sessions, never a ratio of totals.
    """
    t = quotes.select("instrument", "date", (F.col("volume") > 0).alias("traded"))
    p = reference.select("instrument", "date", F.col("price").isNotNull().alias("priced"))
    both = t.join(p, ["instrument", "date"], "full").fillna(False, ["traded", "priced"])
    d = both.groupBy("instrument").agg(
        F.count_if("traded").alias("traded"), F.count_if("priced").alias("priced"),
        F.count_if(F.col("traded") & F.col("priced")).alias("both"),
        F.count_if(F.col("traded") & ~F.col("priced")).alias("traded_only"),
        F.count_if(~F.col("traded") & F.col("priced")).alias("priced_only"))
    d = d.withColumns({"coverage": F.try_divide("both", "traded"), "idle_priced_share": F.try_divide("priced_only", "priced")})
    d = d.join(states, "instrument", "left")
    no = F.lit(False)
    situation = (F.when(F.coalesce("failed", no), "erro_temporario").when(F.coalesce("blocked", no), "continuidade_bloqueada")
                 .when(F.col("terminal").isNotNull(), "historico_sob_codigo_posterior")
                 .when(F.col("coverage").isNull() | (F.col("coverage") <= 0), "ausente")
                 .when(F.col("coverage") >= complete, "cobertura_completa").otherwise("cobertura_parcial"))
    return (d.withColumn("situation", situation).drop("failed", "blocked")
            .withColumn("risk", F.when(F.col("situation").isin("ausente", "erro_temporario"), "alto")
                        .when(F.col("situation") == "cobertura_parcial", "medio").otherwise("baixo")))


def coverage_by_band(selection: DataFrame, windows: DataFrame, panels: dict[str, DataFrame], bands) -> DataFrame:
    """Share of the top-N names of a window with at least one usable return in its test period."""
    names = (selection.filter(F.col("final_position") <= max(bands)).select("window", "instrument", "final_position")
             .withColumn("band", F.explode(F.array(*[F.lit(b) for b in bands]))).filter(F.col("final_position") <= F.col("band"))
             .join(windows.select("window", "test_start", "test_end"), "window"))
    out = None
    for source, ret in panels.items():
        r = ret.filter("ret is not null").select("instrument", "date")
        hit = (names.join(r, "instrument").filter((F.col("date") >= F.col("test_start")) & (F.col("date") < F.col("test_end")))
               .select("window", "band", "instrument").distinct().withColumn("hit", F.lit(1)))
        part = (names.join(hit, ["window", "band", "instrument"], "left").groupBy("window", "band")
                .agg(F.count(F.lit(1)).alias("names"), F.count("hit").alias("covered"))
                .withColumns({"source": F.lit(source), "share": F.col("covered") / F.col("names")}))
        out = part if out is None else out.unionByName(part)
    return out


def return_fingerprints(returns: DataFrame, digits: int = 8) -> DataFrame:
    """Hash of an instrument's observed returns, in date order."""
    scale = 10.0 ** digits
    row = F.struct("date", F.concat_ws(":", F.date_format("date", "yyyyMMdd"),
                                       F.floor(F.col("ret") * scale + 0.5).cast("string")).alias("v"))
    return (returns.filter("ret is not null").groupBy("instrument")
            .agg(F.array_sort(F.collect_list(row)).alias("rows"), F.count(F.lit(1)).alias("observations"))
            .select("instrument", "observations",
                    F.sha2(F.array_join(F.transform("rows", lambda r: r["v"]), "|"), 256).alias("fingerprint")))


def identical_series(fingerprints: DataFrame) -> DataFrame:
    """Instruments sharing a fingerprint, each named with the group's first instrument.

    One row per surplus copy against the smallest name, so a group of any size stays linear.
    """
    g = fingerprints.groupBy("fingerprint").agg(F.min("instrument").alias("instrument_a"), F.count(F.lit(1)).alias("copies"))
    return (fingerprints.join(g.filter("copies > 1"), "fingerprint").filter(F.col("instrument") != F.col("instrument_a"))
            .select("instrument_a", F.col("instrument").alias("instrument_b"), "fingerprint", "observations", "copies"))


def extreme_returns(panel: DataFrame, returns: DataFrame, changes: DataFrame | None = None, limit: float = 0.5,
                    near_days: int = 10, tolerance: float = 0.02) -> DataFrame:
    """|r| above the limit with the context to judge it and a probable cause by strength of hint.

    ``changes``: instrument, change_date of known code changes.
    """
    ctx = event_boundaries(panel).withColumns({
        "price_before": previous("close"), "token_before": F.coalesce(previous("token"), F.lit(""))})
    ext = returns.filter(F.abs("ret") > limit).select("instrument", "date", "ret")
    x = ext.join(ctx.select("instrument", "date", "close", "volume", "trades", "spec", "token", "token_before", "price_before"),
                 ["instrument", "date"])
    if changes is not None:
        near = (x.select("instrument", "date").join(changes, "instrument")
                .groupBy("instrument", "date").agg(F.min(F.abs(F.date_diff("date", "change_date"))).alias("days_to_change")))
        x = x.join(near, ["instrument", "date"], "left")
    else:
        x = x.withColumn("days_to_change", F.lit(None).cast("int"))
    ratio = F.when(F.col("price_before") > 0, F.col("close") / F.col("price_before"))
    factor = F.lit(None).cast("string")
    for f in reversed(SPLIT_FACTORS):
        factor = (F.when(F.abs(F.col("ratio") / f - 1) <= tolerance, f"1:{f}")
                  .when(F.abs(F.col("ratio") * f - 1) <= tolerance, f"{f}:1").otherwise(factor))
    x = x.withColumn("ratio", ratio).withColumn("round_factor", F.coalesce(factor, F.lit("")))
    cause = (F.when(F.col("days_to_change") <= near_days, "proximo_de_mudanca_de_ticker")
             .when((F.col("token") != "") | (F.col("token_before") != ""), "evento_marcado_na_vizinhanca")
             .when(F.col("round_factor") != "", "possivel_grupamento_nao_marcado")
             .when(F.col("price_before") < 1.0, "preco_baixo_efeito_de_tick")
             .when(F.col("trades") <= 10, "papel_iliquido").otherwise("sem_causa_identificada"))
    return x.withColumn("cause", cause)


def boundary_errors(panel: DataFrame, reference_returns: DataFrame) -> DataFrame:
    """Marked sessions with a candidate return: token, boundary or kept, and the reference error."""
    m = event_boundaries(panel)
    r = simple_returns(m).withColumn("candidate", F.col("ret").isNotNull())
    both = r.withColumn("candidate", F.col("candidate") & traded_both_sessions())
    ref = reference_returns.select("instrument", "date", F.col("ret").alias("ref"))
    return (both.filter("candidate").join(ref, ["instrument", "date"], "left")
            .withColumn("error", F.abs(F.col("ret") - F.col("ref"))))


def _evidence(n: Column, med: Column, share: Column, minimum: Column | int) -> Column:
    return (F.when(F.coalesce(n, F.lit(0)) == 0, "sem_referencia_externa").when(n < minimum, "amostra_insuficiente")
            .when(med > MATERIAL_ERROR, "sustentado_pela_referencia").when(share >= MIXED_SHARE, "evidencia_mista")
            .otherwise("nao_sustentado_pela_referencia"))


def boundary_evidence(errors: DataFrame, minimum: int = MIN_BOUNDARIES) -> DataFrame:
    """Per token: removed boundaries and kept marked days, total and common support, error profile."""
    marked = errors.filter("token <> ''")
    aggs = [F.count(F.lit(1)).alias("marked_days")]
    for name, cond in (("boundary", F.col("boundary")), ("kept", ~F.col("boundary"))):
        err = F.when(cond, F.col("error"))
        aggs += [F.count_if(cond).alias(f"{name}_total"), F.count(err).alias(f"{name}_common"),
                 F.median(err).alias(f"{name}_median"), F.percentile(err, F.lit(0.90)).alias(f"{name}_p90"),
                 F.percentile(err, F.lit(0.95)).alias(f"{name}_p95"), F.percentile(err, F.lit(0.99)).alias(f"{name}_p99"),
                 F.max(err).alias(f"{name}_max"), F.avg((err > 0.0001).cast("int")).alias(f"{name}_over_1bp"),
                 F.avg((err > 0.0010).cast("int")).alias(f"{name}_over_10bp"), F.avg((err > 0.0050).cast("int")).alias(f"{name}_over_50bp")]
    t = marked.groupBy("token").agg(*aggs)
    return t.withColumns({
        "boundary_coverage": F.try_divide("boundary_common", "boundary_total"),
        "kept_coverage": F.try_divide("kept_common", "kept_total"),
        "evidence": _evidence(F.col("boundary_common"), F.col("boundary_median"), F.col("boundary_over_10bp"), minimum)})


def reclassify_evidence(table: DataFrame, minimums=(10, 30, 50)) -> DataFrame:
    """The same table under other minimum samples, long form."""
    t = table.withColumn("minimum", F.explode(F.array(*[F.lit(m) for m in minimums])))
    return t.withColumn("evidence", _evidence(F.col("boundary_common"), F.col("boundary_median"),
                                              F.col("boundary_over_10bp"), F.col("minimum")))


def mask_audit(errors: DataFrame) -> DataFrame:
    """Removal counts over three denominators, per instrument and in total (grouping sets)."""
    e = errors.withColumns({"removed": F.col("boundary"), "marked": F.col("token") != "", "common": F.col("error").isNotNull()})
    g = e.groupingSets([[F.col("instrument")], []], F.col("instrument")).agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if("marked").alias("marked"), F.count_if("removed").alias("removed"),
        F.count_if(F.col("removed") & F.col("common")).alias("removed_common"), F.count_if("common").alias("common"))
    return g.withColumns({"instrument": F.coalesce("instrument", F.lit("TOTAL")),
                          "share_candidates": F.try_divide("removed", "candidates"), "share_marked": F.try_divide("removed", "marked"),
                          "share_common": F.try_divide("removed_common", "common")})


def block_size(series: int, length: int) -> int:
    """Series of a block; ``length`` is that of the calendar."""
    return max(PRODUCT_ROWS, min(SERIES_PER_BLOCK, VALUES_PER_BLOCK // length, -(-series // BLOCKS)))


def near_duplicates(returns: DataFrame, min_correlation: float = 0.999, min_overlap: int = 60, block: int | None = None) -> DataFrame:
    """Pairs of series whose returns are almost perfectly correlated over the days that both have.

    ``returns``: instrument, pos, ret; unique per (instrument, pos).  Every series with ``min_overlap`` observations takes part.
    A correlation over the common days is no distance, so with missing days no grid or pivot can rule a pair out; instead the
    six sums behind all correlations of two blocks of series are six matrix products in one task, and only the pairs found
    leave it.  Blocks follow the first day of the series, and two blocks meet only where their lives share ``min_overlap``
    days.  A task holds two blocks, ``2 * block`` rows of the calendar's length, whatever the number of series; unless given, ``block``
    follows the calendar's length and the number of series.  Products are taken by ``PRODUCT_ROWS`` rows of either block at a time.
    """
    seen = F.col("ret").isNotNull() & ~F.isnan("ret")
    lives = (returns.filter(seen).groupBy("instrument")
             .agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count(F.lit(1)).alias("days")).filter(F.col("days") >= min_overlap))
    if block is None:
        n, length = lives.agg(F.count(F.lit(1)), F.coalesce(F.max("last") - F.min("first") + 1, F.lit(1))).first()
        block = block_size(n, length)
    lives = materialize(running_counts(lives.withColumn("all", F.lit(0)), ["all"], [F.col("first"), F.col("instrument")], {"rank": F.lit(True)})
                        .select("instrument", "first", "last", F.floor((F.col("rank") - 1) / block).cast("int").alias("block")))
    spans = lives.groupBy("block").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    # One row per pair of blocks, the square of series / block; the same rows say which blocks a series is sent to.
    top = spans.agg(F.max("block")).scalar()
    ahead = spans.select(F.col("block").alias("left"), F.col("last").alias("until"), F.explode(F.sequence("block", top)).alias("block")).join(spans, "block")
    meets = materialize(ahead.filter(F.least("until", "last") - F.col("first") + 1 >= min_overlap).select("left", F.col("block").alias("right")))
    sent = (meets.select("left", "right", F.explode(F.array_distinct(F.array("left", "right"))).alias("block")))
    day = F.struct("pos", "ret")
    series = (returns.filter(seen).join(lives.select("instrument", "block"), "instrument").groupBy("block", "instrument")
              .agg(F.array_sort(F.collect_list(day)).alias("days"))
              .select("block", "instrument", F.transform("days", lambda d: d["pos"].cast("long")).alias("pos"), F.transform("days", lambda d: d["ret"]).alias("ret")))

    def candidates(x, y, mx, my):
        n = mx @ my.T
        sx, sy = x @ my.T, mx @ y.T
        with np.errstate(divide="ignore", invalid="ignore"):
            vx, vy = (x * x) @ my.T - sx * sx / n, mx @ (y * y).T - sy * sy / n
            c = (x @ y.T - sx * sy / n) / np.sqrt(vx * vy)
            return zip(*np.nonzero((n >= min_overlap) & (c >= min_correlation - 1e-6)))

    def exact(names, values, p, q):
        both = ~np.isnan(values[p]) & ~np.isnan(values[q])
        u, v = values[p][both] - values[p][both].mean(), values[q][both] - values[q][both].mean()
        c = float(u @ v / np.sqrt((u @ u) * (v @ v))) if u.any() and v.any() else float("nan")
        return [(*sorted((names[p], names[q])), int(both.sum()), c)] if c >= min_correlation else []

    def found(rows):
        left, right = int(rows["left"].iloc[0]), int(rows["right"].iloc[0])
        rows = rows.sort_values("instrument", kind="stable")
        low = min(int(p[0]) for p in rows["pos"])
        values = np.full((len(rows), max(int(p[-1]) for p in rows["pos"]) - low + 1), np.nan)
        for k, (pos, ret) in enumerate(zip(rows["pos"], rows["ret"])):
            values[k, np.asarray(pos) - low] = np.asarray(ret, float)
        values -= np.nanmean(values, axis=1, keepdims=True)  # no correlation changes, sums of squares keep their digits
        names, blocks = rows["instrument"].to_numpy(), rows["block"].to_numpy()
        i, j = np.flatnonzero(blocks == left), np.flatnonzero(blocks == right)
        mask = (~np.isnan(values)).astype(float)
        flat = np.where(mask > 0, values, 0.0)
        out = []
        for a in range(0, len(i), PRODUCT_ROWS):
            for b in range(0, len(j), PRODUCT_ROWS):
                u, v = i[a:a + PRODUCT_ROWS], j[b:b + PRODUCT_ROWS]
                if left == right and u[0] > v[-1]:
                    continue
                for p, q in candidates(flat[u], flat[v], mask[u], mask[v]):
                    if left != right or u[p] < v[q]:
                        out += exact(names, values, u[p], v[q])
        return pd.DataFrame(out, columns=["instrument_a", "instrument_b", "overlap", "correlation"])

    return sent.join(series, "block").groupBy("left", "right").applyInPandas(found, "instrument_a string, instrument_b string, overlap long, correlation double")


def validate_with_terminal(quotes: DataFrame, reference: DataFrame, candidates: DataFrame, terminals: DataFrame) -> DataFrame:
    """First attempt against the new code; inconclusive candidates retry against the chain's last code."""
    first = validation_metrics(quotes, reference, candidates)
    retry = (first.filter("state <> 'calculado'").select("old", F.col("new").alias("asked"))
             .join(terminals.select(F.col("instrument").alias("old"), F.col("terminal").alias("new")).filter("terminal is not null"), "old"))
    second = (validation_metrics(quotes, reference, retry.select("old", "new")).filter("state = 'calculado'")
              .withColumnRenamed("new", "terminal").join(retry.select("old", "asked"), "old").withColumnRenamed("asked", "new"))
    keep = first.join(second.select("old", "new"), ["old", "new"], "left_anti").withColumn("terminal", F.lit(None).cast("string"))
    return keep.unionByName(second.select(*keep.columns))
