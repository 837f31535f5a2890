"""Deterministic projections of the given tables onto the domain tables.

Quotes come from ``lineitem`` (one instrument per supplier), sectors from nation and region,
filings from ``documents``, labels from ``labels``.  Lines are dealt by supplier and date, so a
supplier holding a third of all lines is spread over its dates, and is one row per date afterwards.
"""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from leadwake.config import (DEFAULTS, Discovery, LeadLag, Liquidity, Metrics, Period, Settings, StalePrice,
                             Strategy)
from leadwake.operators import sessions

# The study period and the thresholds that fit monthly bars of the given tables.
STUDY = Period(start=date(1995, 1, 1), end=date(2001, 12, 1))
MONTHLY = replace(
    DEFAULTS,
    period=STUDY,
    liquidity=Liquidity(top_n=25, bands=(5, 10, 15, 25), min_coverage=0.95,
                        min_traded_share=0.95, min_sessions=20),
    lead_lag=LeadLag(min_observations=12, hac_lags=2),
    stale=StalePrice(min_trades=2),
    discovery=Discovery(q=0.35, top_k=8),
    strategy=Strategy(volatility_window=12),
    metrics=Metrics(bootstrap_block=5),
)
MIN_INSTRUMENTS = 5


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def instrument_id(key: Column) -> Column:
    return F.concat(F.lit("S"), F.lpad(key.cast("string"), 10, "0"))


def instruments(spark: SparkSession, sf: str, facts: DataFrame | None = None) -> DataFrame:
    """Reference data per instrument; one row per supplier, or per row of ``facts``, which has a ``suppkey``.

    Facts meet the narrow supplier table first: Spark knows its size and sends it to them as long as it is small.  The size of
    a join it takes for the product of both sides, and would deal out the facts a second time.
    """
    s = table(spark, sf, "supplier")
    more = []
    if facts is not None:
        more = [c for c in facts.columns if c != "suppkey"]
        s = facts.join(s.select("s_suppkey", "s_nationkey", "s_acctbal"), F.col("suppkey") == F.col("s_suppkey")).drop("suppkey")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf, "region")
    bal = F.col("s_acctbal")
    issuer = F.concat(F.lit("N"), F.lpad(F.col("s_nationkey").cast("string"), 3, "0"))
    kind = F.when(bal >= 6000, "ON").when(bal >= 3000, "PN").when(bal >= 0, "UNT").otherwise("BDR")
    isin_type = F.when(bal >= 3000, "ACN").when(bal >= 1500, "CDA").when(bal >= 0, "UNT").otherwise("BDR")
    return (s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
            .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("s_suppkey").alias("suppkey"),
                    instrument_id(F.col("s_suppkey")).alias("instrument"),
                    F.col("n_name").alias("name"),
                    issuer.alias("issuer_code"),
                    kind.alias("kind"),
                    F.when(bal < -900, F.lit("")).otherwise(
                        F.concat(F.lit("BR"), issuer, isin_type, F.lit("OR0"))).alias("isin"),
                    F.when(bal < -500, "020").otherwise("010").alias("market"),
                    F.when(bal < -250, "96").otherwise("02").alias("bdi"),
                    F.col("r_name").alias("sector"),
                    F.when(F.col("s_nationkey") % 2 == 0, "par").otherwise("impar").alias("subsector"),
                    bal.alias("acctbal"), *more))


def _bars(spark: SparkSession, sf: str, day: Column) -> DataFrame:
    """Bars per supplier and date; sums of cents are rounded back to cents."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    # The whole order of lines in one number: order, line, quantity, tax, flag and price in cents.  A struct would force a
    # sort before every partial aggregate; a number stays in the hash aggregate's row buffer.
    rank = F.expr("""cast((l_orderkey * 8 + l_linenumber) * 4096 + cast(l_quantity AS bigint) * 64 + cast(round(l_tax * 100) AS bigint) * 4
        + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS decimal(20, 0)) * 1000000000000BD + cast(round(l_extendedprice * 100) AS decimal(12, 0))""")
    # The last line's marker as a small number: one value to carry through the exchange instead of tax and flag.
    code = F.when(F.col("l_tax") < 0.065, 0).when(F.ascii("l_returnflag") == 82, 1).when(F.ascii("l_returnflag") == 65, 2).otherwise(0)
    # Hardly two lines share supplier and date, so a map-side combine would hold, and spill, nearly every line as a row three
    # times as wide.  The lines themselves are dealt out, narrow; a large supplier is dealt by its dates.
    lines = (table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("suppkey"), day.alias("date"), "l_orderkey", "l_linenumber", "l_quantity",
                                                 "l_extendedprice", "l_tax", "l_returnflag")
             .repartition("suppkey", "date"))
    bars = (lines.withColumns({"price": price, "rank": rank, "code": code})
            .groupBy("suppkey", "date")
            .agg(F.min_by("price", "rank").alias("open"), F.max_by("price", "rank").alias("close"),
                 F.max_by("code", "rank").alias("code"),
                 F.max("price").alias("high"), F.min("price").alias("low"),
                 F.round(F.sum("l_extendedprice"), 2).alias("volume"),
                 F.round(F.sum("l_quantity"), 2).alias("quantity"), F.count(F.lit(1)).alias("trades")))
    marker = F.when(F.col("code") == 1, "ED").when(F.col("code") == 2, "EJ").otherwise("")
    return bars.withColumns({"avg": F.col("volume") / F.col("quantity"), "marker": marker}).drop("code")


def quotes(spark: SparkSession, sf: str, freq: str = "day") -> DataFrame:
    """Quote records keyed by (date, instrument); ``freq`` is ``day`` or ``month``."""
    ship = F.to_date("l_shipdate")
    day = ship if freq == "day" else F.trunc(ship, "month")
    spec = (F.when(F.col("marker") == "", F.concat(F.rpad("kind", 8, " "), F.lit("NM")))
            .otherwise(F.concat(F.rpad("kind", 4, " "), F.col("marker"), F.lit("  NM"))))
    return (instruments(spark, sf, _bars(spark, sf, day))
            .select("date", "instrument", "name", spec.alias("spec"), "kind", "isin", "market", "bdi",
                    "open", "high", "low", "avg", "close", "trades", "quantity", "volume"))


def windows(spark: SparkSession, cfg: Settings = MONTHLY) -> DataFrame:
    return sessions.walk_forward_windows(spark, cfg.period.start, cfg.period.end, cfg.walk_forward)


def sector_table(spark: SparkSession, sf: str) -> DataFrame:
    """Dated sector rows, 13 text columns; rich suppliers change subsector once."""
    i = instruments(spark, sf)
    moved = F.col("acctbal") > 8000
    periods = F.when(moved, F.array(
        F.struct(F.lit("1995-01-01").alias("valid_from"), F.lit("1997-12-31").alias("valid_to"),
                 F.col("subsector").alias("sub")),
        F.struct(F.lit("1998-01-01").alias("valid_from"), F.lit("").alias("valid_to"),
                 F.lit("novo").alias("sub")))).otherwise(F.array(
        F.struct(F.lit("1995-01-01").alias("valid_from"), F.lit("").alias("valid_to"),
                 F.col("subsector").alias("sub"))))
    return (i.withColumn("p", F.explode(periods))
            .select("instrument", F.col("issuer_code").alias("issuer"), "sector",
                    F.col("p.sub").alias("subsector"), F.lit("").alias("segment"),
                    F.when(F.col("acctbal") < -800, "Yahoo").otherwise("bolsa").alias("source"),
                    F.lit("2001-12-01").alias("source_date"), F.lit("ficha").alias("evidence"),
                    F.lit("nao").alias("documented_stability"),
                    F.col("p.valid_from").alias("valid_from"), F.col("p.valid_to").alias("valid_to"),
                    F.when(F.col("acctbal") > 0, "alta").otherwise("baixa").alias("confidence"),
                    F.when(F.col("acctbal") < -600, "pendente").otherwise("confirmado").alias("review_status")))


def study(spark: SparkSession, sf: str, cfg: Settings = MONTHLY, bars: DataFrame | None = None):
    from leadwake.plans.walk_forward import Study
    return Study(quotes(spark, sf, "month") if bars is None else bars, sector_table(spark, sf), cfg, MIN_INSTRUMENTS, windows(spark, cfg), bars is not None)


def reference_prices(spark: SparkSession, sf: str, freq: str = "day") -> DataFrame:
    """A second price source: the average price of the lines already invoiced."""
    ship = F.to_date("l_shipdate")
    day = ship if freq == "day" else F.trunc(ship, "month")
    return (table(spark, sf, "lineitem").filter("l_linestatus = 'F'")
            .groupBy(F.col("l_suppkey").alias("suppkey"), day.alias("date"))
            .agg((F.round(F.sum("l_extendedprice"), 2) / F.round(F.sum("l_quantity"), 2)).alias("price"),
                 F.max("l_tax").alias("t"))
            .select(instrument_id(F.col("suppkey")).alias("instrument"), "date", "price",
                    F.lit(0.0).alias("dividend"), F.when(F.col("t") >= 0.08, 2.0).otherwise(0.0).alias("split")))


def coded_quotes(spark: SparkSession, sf: str) -> DataFrame:
    """Quotes under codes that change every year: one code per customer and order year."""
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    day = F.to_date("o_orderdate")
    bars = (o.groupBy("o_custkey", day.alias("date"))
            .agg(F.max(F.struct("o_orderkey", "o_totalprice")).alias("last"), F.round(F.sum("o_totalprice"), 2).alias("volume"),
                 F.count(F.lit(1)).alias("trades")))
    return (bars.join(c, F.col("o_custkey") == F.col("c_custkey"))
            .select("date", F.concat(F.lit("C"), F.lpad(F.col("o_custkey").cast("string"), 8, "0"), F.lit("Y"),
                                     F.year("date").cast("string")).alias("instrument"),
                    F.col("c_name").alias("name"), F.col("c_mktsegment").alias("kind"),
                    F.col("last.o_totalprice").alias("close"), "volume", "trades"))


def filings(spark: SparkSession, sf: str) -> DataFrame:
    """One filing per document: 13 text fields, issuer, delivery date, whole text."""
    i = F.col("doc_id")
    delivered = F.date_add(F.lit("1996-12-20").cast("date"), (i * 37 % 1830).cast("int"))
    return table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("N"), F.lpad((i % 25).cast("string"), 3, "0")).alias("issuer"), delivered.alias("delivered"), "text",
        F.lpad((i % 25).cast("string"), 14, "0").alias("CNPJ_Companhia"), F.concat(F.lit("EMPRESA "), (i % 25).cast("string")).alias("Nome_Companhia"),
        F.lpad((i % 25).cast("string"), 6, "0").alias("Codigo_CVM"), delivered.cast("string").alias("Data_Referencia"),
        F.when(F.col("lang") == "de", "Comunicado ao Mercado").otherwise("Fato Relevante").alias("Categoria"), F.lit("").alias("Tipo"),
        F.lit("").alias("Especie"), F.col("source").alias("Assunto"), delivered.cast("string").alias("Data_Entrega"),
        F.when(F.col("source") == "src3", "RE - Reapresentação").otherwise("AP - Apresentação").alias("Tipo_Apresentacao"),
        i.cast("string").alias("Protocolo_Entrega"), F.when(F.col("n_chars") > 9000, "2").when(F.col("n_chars") > 3000, "1").otherwise("").alias("Versao"),
        F.concat(F.lit("https://exemplo/"), i.cast("string")).alias("Link_Download"))


def label_direction() -> Column:
    """Direction of a document's label; none without a quality."""
    return (F.when(F.col("quality").isNull(), None).when(F.col("quality") != 1, "neutra").when(F.col("toxic") == 1, "negativa")
            .when(F.col("n_chars") % 4 == 0, "neutra").when(F.col("n_chars") % 4 == 1, "negativa").otherwise("positiva"))


def document_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Classification rows: quality says company-specific, toxic says negative."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    return (d.join(table(spark, sf, "labels"), "doc_id", "left")
            .select("doc_id", F.when(F.col("quality").isNull(), "erro").otherwise("ok").alias("status"),
                    (F.col("quality") == 1).alias("specific"), label_direction().alias("direction")))


RATERS = ("r1", "r2", "r3", "r4", "r5")


def votes(spark: SparkSession, sf: str) -> DataFrame:
    """Five raters: each copies the label, a hashed fifth of the answers moves to another class."""
    from leadwake.functions.scalars import hash_int
    from leadwake.operators.agreement import JOINT_CLASSES, joint_class
    ok = document_labels(spark, sf).filter("status = 'ok'").select("doc_id", joint_class(F.col("specific"), F.col("direction")).alias("base"))
    v = ok.withColumn("rater", F.explode(F.array(*[F.lit(r) for r in RATERS])))
    draw = hash_int(F.lit(20), "voto", F.col("rater"), F.col("doc_id"))
    other = F.element_at(F.array(*[F.lit(c) for c in JOINT_CLASSES]), (draw + 1).cast("int"))
    return v.select("doc_id", "rater", F.when(draw < 4, other).otherwise(F.col("base")).alias("class"))


def rater(spark: SparkSession, sf: str, name: str) -> DataFrame:
    v = votes(spark, sf).filter(F.col("rater") == name)
    return v.select("doc_id", (F.col("class") != "nao_especifico").alias("specific"),
                    F.when(F.col("class") == "nao_especifico", "neutra").otherwise(F.regexp_replace("class", "^especifico_", "")).alias("direction"))
