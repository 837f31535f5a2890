"""Filings to signals: ids, original presentations, sessions, windows, leaders, leader-day signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from leadwake.operators.checks import require
from leadwake.operators.sessions import next_session

# The filing header in its published order, and the categories used.
FILING_COLUMNS = ("CNPJ_Companhia", "Nome_Companhia", "Codigo_CVM", "Data_Referencia", "Categoria", "Tipo", "Especie",
                  "Assunto", "Data_Entrega", "Tipo_Apresentacao", "Protocolo_Entrega", "Versao", "Link_Download")
RELEVANT_FACT = "Fato Relevante"
ORIGINAL = "AP - Apresentação"
OUTSIDE_TESTS, NOT_LEADER = "fora_das_janelas_de_teste", "emissor_nao_e_lider_top20_na_janela"
# Accepted spellings of a classification.
CLASS_VALUES = {"+1": 1, "1": 1, "positiva": 1, "positivo": 1, "positive": 1, "-1": -1, "negativa": -1, "negativo": -1,
                "negative": -1, "0": 0, "neutra": 0, "neutro": 0, "neutral": 0}


def with_document_id(filings: DataFrame, out: str = "document_id") -> DataFrame:
    """sha256 of the compact JSON array of the 13 raw fields; every version gets its own id."""
    raw = F.array(*[F.coalesce(F.col(c), F.lit("")) for c in FILING_COLUMNS])
    return filings.withColumn(out, F.sha2(F.to_json(raw), 256))


def filing_violations(filings: DataFrame) -> DataFrame:
    """Dates that are not real ISO dates, one row per column with the count."""
    def bad(c):
        return ~F.coalesce(F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False)) | F.try_to_date(c).isNull()
    delivered = F.try_to_date("Data_Entrega")
    late = bad("Data_Entrega") | F.coalesce((delivered < "1677-09-22") | (delivered > "2262-04-11"), F.lit(False))
    agg = filings.agg(F.count(F.lit(1)).alias("rows"), F.count_if(bad("Data_Referencia")).alias("r"), F.count_if(late).alias("e"))
    both = F.explode(F.array(F.struct(F.lit("Data_Referencia").alias("column"), F.col("r").alias("violations")),
                             F.struct(F.lit("Data_Entrega").alias("column"), F.col("e").alias("violations"))))
    return agg.withColumn("p", both).select("p.column", "rows", "p.violations")


def relevant_facts(filings: DataFrame) -> DataFrame:
    return filings.filter(F.col("Categoria") == RELEVANT_FACT)


def original_presentations(filings: DataFrame) -> DataFrame:
    version = F.trim(F.coalesce("Versao", F.lit("")))
    return filings.filter((F.col("Tipo_Apresentacao") == ORIGINAL) & version.isin("", "1"))


def join_leaders(filings: DataFrame, leaders: DataFrame) -> DataFrame:
    """Filings of reference issuers: codes without leading zeros, tax id must agree, delivery inside validity."""
    code = lambda c: F.regexp_replace(F.trim(c), "^0+", "")
    ld = leaders.select("issuer", code("codigo_cvm").alias("code"), F.col("cnpj").alias("leader_cnpj"), "valid_from", "valid_to")
    j = filings.withColumn("code", code("Codigo_CVM")).join(ld, "code")
    clash = F.regexp_replace("CNPJ_Companhia", r"\D", "") != F.regexp_replace("leader_cnpj", r"\D", "")
    day = F.to_date("Data_Entrega")
    return (require(j, clash, F.concat(F.lit("tax id differs for code "), "code"))
            .filter((day >= F.coalesce("valid_from", F.lit("0001-01-01").cast("date"))) & (day <= F.coalesce("valid_to", F.lit("9999-12-31").cast("date"))))
            .drop("code", "leader_cnpj", "valid_from", "valid_to"))


def map_sessions(events: DataFrame, calendar: DataFrame, on: str = "delivered") -> tuple[DataFrame, DataFrame]:
    return next_session(events, calendar, on)


def assign_test_windows(events: DataFrame, windows: DataFrame, on: str = "session") -> tuple[DataFrame, DataFrame]:
    """Test window holding the session; windows are months, matched by month plus residual range."""
    months = windows.select("window", "test_start", "test_end", F.explode(F.sequence(
        F.trunc("test_start", "month"), F.trunc(F.date_sub("test_end", 1), "month"), F.expr("interval 1 month"))).alias("__month"))
    j = (events.withColumn("__m", F.trunc(on, "month")).join(
        months, (F.col("__m") == F.col("__month")) & (F.col(on) >= F.col("test_start")) & (F.col(on) < F.col("test_end")), "left")
        .drop("__m", "__month", "test_start", "test_end"))
    missing = j.filter("window is null").drop("window").withColumn("reason", F.lit(OUTSIDE_TESTS))
    return j.filter("window is not null"), missing


def leader_events(events: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events whose issuer leads in the same window, without fan-out; two leaders of an issuer raise."""
    lead = (pairs.select("window", F.col("leader_issuer").alias("issuer"), "leader").distinct()
            .groupBy("window", "issuer").agg(F.count(F.lit(1)).alias("n"), F.min("leader").alias("leader")))
    one = require(lead, F.col("n") > 1, F.concat(F.lit("issuer with two leaders: "), "window", F.lit("/"), "issuer")).drop("n")
    j = events.join(one, ["window", "issuer"], "left")
    return j.filter("leader is not null"), j.filter("leader is null").drop("leader").withColumn("reason", F.lit(NOT_LEADER))


def universe_instrument(events: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Point-in-time instrument by (window, issuer); the rest is returned apart."""
    m = members.select("window", "issuer", "instrument")
    j = events.join(m, ["window", "issuer"], "left")
    return j.filter("instrument is not null"), j.filter("instrument is null").drop("instrument")


def corpus_funnel(filings: DataFrame, calendar: DataFrame, windows: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Selected leader events, and counts per stage and exclusion reason."""
    facts = relevant_facts(filings)
    first = original_presentations(facts)
    seen, late = map_sessions(first, calendar)
    placed, outside = assign_test_windows(seen, windows)
    kept, others = leader_events(placed, pairs)
    stages = [("metadados", filings), ("fatos_relevantes", facts), ("apresentacoes_originais", first), ("com_sessao", seen),
              ("nas_janelas", placed), ("de_lideres", kept)]
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit("etapa").alias("kind"), F.lit(s).alias("name"), "n") for s, df in stages]
    counts += [df.groupBy(F.col("reason").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("motivo").alias("kind"), "name", "n")
               for df in (late, outside, others)]
    return kept, reduce(DataFrame.unionByName, counts)


def class_value(label):
    """Label to -1/0/1; accents and case do not matter; anything else raises."""
    clean = F.translate(F.lower(F.trim(label)), "áàâãéêíóôõúç", "aaaaeeiooouc")
    lookup = F.create_map(*[F.lit(x) for kv in CLASS_VALUES.items() for x in kv])
    return F.coalesce(F.try_element_at(lookup, clean), F.raise_error(F.concat(F.lit("invalid classification: "), F.coalesce(label, F.lit("null")))).cast("int"))


def leader_day_signals(events: DataFrame, label: str = "classification", day: str = "session") -> DataFrame:
    """One signal per (window, leader, day): concordant labels act, conflict or only neutral abstains.

    Counts aggregate map-side, so any number of copies of one filing day costs one row per task.
    """
    v = class_value(F.col(label))
    g = events.withColumn("__v", v).groupBy("window", "leader", day).agg(
        F.min("issuer").alias("issuer"), F.count_distinct("issuer").alias("__i"), F.count(F.lit(1)).alias("documents"),
        F.count_if(F.col("__v") == 1).alias("positives"), F.count_if(F.col("__v") == -1).alias("negatives"), F.count_if(F.col("__v") == 0).alias("neutrals"))
    p, n = F.col("positives") > 0, F.col("negatives") > 0
    return require(g, F.col("__i") != 1, F.concat(F.lit("issuer must be unique per leader-day: "), F.col("leader").cast("string"))).withColumns({
        "signal": F.when(p & n, 0).when(p, 1).when(n, -1).otherwise(0),
        "abstain": (p & n) | (~p & ~n),
        "reason": F.when(p & n, "conflito_positivo_negativo").when(p, "positivas_concordantes").when(n, "negativas_concordantes")
        .otherwise("somente_neutras")}).drop("__i")


def signals_from_labels(labelled: DataFrame) -> DataFrame:
    """Valid labels only; a document that is not about the company counts as neutral."""
    ok = labelled.filter(F.col("status") == "ok").withColumn(
        "classification", F.when(F.col("specific"), F.col("direction")).otherwise("neutra"))
    return leader_day_signals(ok)


def network_signals(pairs: DataFrame, returns: DataFrame, windows: DataFrame, calendar: DataFrame) -> DataFrame:
    """Daily rule without documents: non-zero leader return, executed next session inside the test."""
    nxt = calendar.select((F.col("pos") - 1).alias("pos"), F.col("date").alias("session"))
    lead = pairs.select("window", "leader").distinct().join(windows.select("window", "test_start", "test_end"), "window")
    r = returns.filter("ret is not null and ret <> 0").select(F.col("instrument").alias("leader"), "date", "pos", "ret")
    return (lead.join(r, "leader").filter((F.col("date") >= F.col("test_start")) & (F.col("date") < F.col("test_end")))
            .join(nxt, "pos").filter(F.col("session") < F.col("test_end"))
            .select("window", F.col("date").alias("delivered"), "session", "leader", F.signum("ret").cast("int").alias("direction")))


def self_pairs(signals: DataFrame) -> DataFrame:
    return signals.select("window", "leader").distinct().withColumn("follower", F.col("leader"))


def signal_violations(signals: DataFrame) -> DataFrame:
    """Contract of backtest signals: unique leader-day, one window per session, delivery before session."""
    from leadwake.operators.checks import check, duplicates
    per_session = signals.groupBy("session").agg(F.count_distinct("window").alias("n"))
    parts = [duplicates(signals, "lider_dia_duplicado", ["window", "session", "leader"]),
             check(per_session, "sessao_em_duas_janelas", F.col("n") > 1),
             check(signals, "direcao_invalida", ~F.coalesce(F.col("direction").isin(-1, 1), F.lit(False)))]
    if "delivered" in signals.columns:
        parts.append(check(signals, "entrega_nao_anterior", F.col("delivered") >= F.col("session")))
    return reduce(DataFrame.unionByName, parts)
