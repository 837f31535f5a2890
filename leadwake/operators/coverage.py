"""Diagnosis of missing external series, liquidity deciles, filing coverage, curation queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from leadwake.operators.ranking import running_counts


def missing_series(quotes: DataFrame, states: DataFrame, changed: DataFrame, best: DataFrame, bands: tuple[int, ...],
                   active_days: int = 30, recent_months: int = 12) -> DataFrame:
    """Why a series is missing, how much it matters, and the recovery route.

    ``states``: instrument, state in {serie_vazia, sucesso, bloqueado}.  ``changed``: instruments in any change candidate.
    """
    prof = quotes.groupBy("instrument").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count_distinct("date").alias("sessions"),
        F.median("volume").alias("median_volume"), F.median("trades").alias("median_trades"), F.substring(F.min_by("isin", "date"), 3, 4).alias("issuer"))
    last = quotes.agg(F.max("date")).scalar()
    known = changed.select("instrument").distinct().withColumn("in_detector", F.lit(True))
    # Sibling classes with a series: only whether one exists and the smallest name are needed.
    sib = (prof.select("instrument", "issuer").join(states.filter(F.col("state").isin("sucesso", "bloqueado")), "instrument")
           .groupBy("issuer").agg(F.min("instrument").alias("sibling"), F.count(F.lit(1)).alias("siblings")))
    m = (prof.join(states.filter("state = 'serie_vazia'").select("instrument"), "instrument", "left_semi")
         .join(known, "instrument", "left").join(sib, "issuer", "left").join(best.select("instrument", "best_position"), "instrument", "left"))
    active = F.col("last_date") >= F.date_sub(last, active_days)
    recent = F.col("first_date") >= F.add_months(last, -recent_months)
    cause = (F.when(active & recent, "instrumento_recente_sem_serie_ainda").when(active, "ativo_no_fim_sem_serie")
             .when(F.col("in_detector"), "encerrado_com_sucessor_no_detector").when(F.col("siblings") > 0, "encerrado_com_outra_classe_do_emissor")
             .otherwise("encerrado_sem_sucessor_no_universo"))
    band = F.lit("fora_das_faixas")
    for b in sorted(bands, reverse=True):
        band = F.when(F.col("best_position") <= b, f"top{b}").otherwise(band)
    out = m.withColumns({"cause": cause, "band": F.when(F.col("best_position").isNull(), "nunca_elegivel").otherwise(band)})
    route = (F.when(F.col("band").isin("nunca_elegivel", "fora_das_faixas"), "nao_material")
             .when(F.col("cause") == "encerrado_com_sucessor_no_detector", "revisao_documental_mudanca_ticker")
             .when(F.col("cause") == "encerrado_com_outra_classe_do_emissor", "conversao_classe_documentada").otherwise("preco_bruto_cotahist"))
    return out.withColumn("route", route).withColumn("in_detector", F.coalesce("in_detector", F.lit(False)))


def cause_by_band(missing: DataFrame) -> DataFrame:
    return missing.groupBy("cause", "band").agg(F.count(F.lit(1)).alias("instruments"))


def coverage_by_decile(coverage: DataFrame, liquidity: DataFrame, tiles: int = 10) -> DataFrame:
    """Coverage per liquidity decile; ranks are unique, edges interpolate like quantile cuts.

    The rank is a distributed running count, so no task sees all instruments.
    """
    j = coverage.join(liquidity, "instrument").withColumn("all", F.lit(1))
    r = running_counts(j, ["all"], [F.col("median_volume").asc(), F.col("instrument").asc()], {"rank": F.lit(True)})
    n = r.agg(F.count(F.lit(1))).scalar()
    # Cut edges are 1 + k(n-1)/tiles with right-closed bins.
    tile = F.greatest(F.ceil((F.col("rank") - 1) * tiles / F.greatest(n - 1, F.lit(1))), F.lit(1))
    return (r.withColumn("decile", tile).groupBy("decile")
            .agg(F.count(F.lit(1)).alias("instruments"), F.avg("coverage").alias("mean_coverage"), F.median("coverage").alias("median_coverage")))


def filing_summary(filings: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Per delivery year: filings, relevant facts, and reference years outside the horizon (kept)."""
    ref = F.substring("Data_Referencia", 1, 4).cast("int")
    return filings.groupBy(F.substring("Data_Entrega", 1, 4).alias("year")).agg(
        F.count(F.lit(1)).alias("filings"), F.count_if(F.col("Categoria") == "Fato Relevante").alias("facts"),
        F.count_if(~ref.between(first_year, last_year)).alias("outside_horizon"))


def leader_coverage(filings: DataFrame) -> DataFrame:
    return filings.groupBy("issuer").agg(F.count(F.lit(1)).alias("filings"), F.min("delivered").alias("first"), F.max("delivered").alias("last"))


def curation_queue(best: DataFrame, quotes: DataFrame, sector_table: DataFrame, top: int, active_days: int = 30) -> DataFrame:
    """Instruments that reached a band: route by last trade, tickers per issuer, split issuers, sector status."""
    last = quotes.agg(F.max("date")).scalar()
    prof = quotes.groupBy("instrument").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.substring(F.min_by("isin", "date"), 3, 4).alias("issuer"))
    q = best.filter(F.col("best_position") <= top).select("instrument", "best_position").join(prof, "instrument")
    q = q.withColumn("route", F.when(F.col("last_date") >= F.date_sub(last, active_days), "listagem_atual").otherwise("arquivo_historico"))
    per = q.groupBy("issuer").agg(F.count(F.lit(1)).alias("instruments"), F.count_distinct("route").alias("routes"))
    st = sector_table.groupBy("instrument").agg(F.bool_or(F.col("review_status") == "confirmado").alias("confirmed"))
    return (q.join(per, "issuer", "left").join(st, "instrument", "left")
            .withColumns({"split_issuer": F.coalesce(F.col("routes") > 1, F.lit(False)), "confirmed": F.coalesce("confirmed", F.lit(False))}))


def expectations(actual: DataFrame, expected: dict[str, float], tolerance: float = 1e-9) -> DataFrame:
    """Frozen results: (name, expected, value, passed) for a one-row table of named numbers."""
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(float(v)).alias("expected"), F.col(k).cast("double").alias("value"))
                               for k, v in expected.items()]))
    return actual.select(rows.alias("r")).select("r.*").withColumn("passed", F.abs(F.col("expected") - F.col("value")) <= tolerance)
