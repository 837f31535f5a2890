"""Dated sector table: validity joins, validation, gaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

SECTOR_COLUMNS = ("instrument", "issuer", "sector", "subsector", "segment", "source", "source_date",
                  "evidence", "documented_stability", "valid_from", "valid_to", "confidence", "review_status")
# Fixed vocabularies.
REVIEW_STATUSES = ("confirmado", "pendente", "evidencia_insuficiente")
CONFIDENCES = ("alta", "media", "baixa", "")
STABILITIES = ("sim", "nao", "")
FORBIDDEN_SOURCES = ("yahoo", "yfinance", "yf")

_OPEN_START, _OPEN_END = "0001-01-01", "9999-12-31"


def interval_start() -> Column:
    return F.coalesce(F.try_to_date("valid_from"), F.lit(_OPEN_START).cast("date"))


def interval_end() -> Column:
    return F.coalesce(F.try_to_date("valid_to"), F.lit(_OPEN_END).cast("date"))


def confirmed(table: DataFrame) -> DataFrame:
    return (table.filter(F.col("review_status") == "confirmado")
            .withColumns({"lo": interval_start(), "hi": interval_end()}))


def sector_in_force(keys: DataFrame, table: DataFrame, on: str = "date") -> DataFrame:
    """Left join of (instrument, date) rows to the confirmed row valid on that date."""
    c = confirmed(table).select("instrument", "sector", "subsector", "segment", "lo", "hi")
    k = keys.alias("k")
    return (k.join(c.alias("c"), (F.col("k.instrument") == F.col("c.instrument"))
                   & (F.col(f"k.{on}") >= F.col("c.lo")) & (F.col(f"k.{on}") <= F.col("c.hi")), "left")
            .select("k.*", "c.sector", "c.subsector", "c.segment"))


def operable_instruments(table: DataFrame, dates: DataFrame) -> DataFrame:
    """Instruments with a confirmed sector on each date of ``dates`` (a short list of dates).

    Matched per month so the join has an equality key.
    """
    lo_m, hi_m = F.trunc("lo", "month"), F.trunc("hi", "month")
    first = dates.agg(F.trunc(F.min("date"), "month")).scalar()
    last = dates.agg(F.trunc(F.max("date"), "month")).scalar()
    rows = (confirmed(table).withColumns({"m0": F.greatest(lo_m, first), "m1": F.least(hi_m, last)})
            .filter(F.col("m0") <= F.col("m1"))
            .withColumn("month", F.explode(F.sequence("m0", "m1", F.expr("interval 1 month")))))
    d = dates.select("date", F.trunc("date", "month").alias("month"))
    return (rows.join(d, "month").filter((F.col("date") >= F.col("lo")) & (F.col("date") <= F.col("hi")))
            .select("date", "instrument").distinct())


def validate(table: DataFrame) -> DataFrame:
    """All violations at once as (rule, instrument, detail); empty means approved."""
    t = table.withColumns({"lo": interval_start(), "hi": interval_end()})
    conf = t.filter(F.col("review_status") == "confirmado")
    blank = lambda c: F.trim(F.col(c)) == ""

    def rows(df: DataFrame, rule: str, detail: Column) -> DataFrame:
        return df.select(F.lit(rule).alias("rule"), F.col("instrument"), detail.alias("detail"))

    parts = [rows(t.filter(F.lower("source").rlike("|".join(FORBIDDEN_SOURCES))), "fonte_proibida", F.col("source"))]
    for col, allowed in (("review_status", REVIEW_STATUSES), ("confidence", CONFIDENCES),
                         ("documented_stability", STABILITIES)):
        parts.append(rows(t.filter(~F.col(col).isin(*allowed)), f"{col}_invalido", F.col(col)))
    for col in ("sector", "subsector", "source", "source_date", "evidence", "issuer", "instrument"):
        parts.append(rows(conf.filter(blank(col)), f"confirmado_sem_{col}", F.lit(col)))
    parts.append(rows(conf.filter(blank("valid_from") & (F.col("documented_stability") != "sim")),
                      "sem_inicio", F.lit("valid_from")))
    for col in ("source_date", "valid_from", "valid_to"):
        parts.append(rows(t.filter(~blank(col) & F.try_to_date(col).isNull()), f"{col}_ilegivel", F.col(col)))
    seq = W.partitionBy("instrument").orderBy("lo", "hi")
    parts.append(rows(t.withColumn("prev_hi", F.lag("hi").over(seq)).filter(F.col("lo") <= F.col("prev_hi"))
                      .select("instrument").distinct(), "validades_sobrepostas", F.lit("")))
    parts.append(rows(conf.filter(~blank("issuer") & ~F.col("issuer").rlike("^[A-Z0-9]{4}$")),
                      "emissor_malformado", F.col("issuer")))
    inverted = F.try_to_date("valid_from") > F.try_to_date("valid_to")
    parts.append(rows(t.filter(F.coalesce(inverted, F.lit(False))), "validade_invertida", F.lit("")))
    return reduce(DataFrame.unionByName, parts + [issuer_divergence(conf)])


def issuer_divergence(conf: DataFrame) -> DataFrame:
    """Issuers whose rows are valid at the same time with different sector, subsector or segment.

    Instead of comparing all row pairs of an issuer, the rows are reduced to their distinct
    classifications per issuer and start/end event.  A sweep over the events counts how many
    different classifications are open, which stays linear for an issuer with very many rows.
    """
    out = None
    for field, filled in (("sector", False), ("subsector", False), ("segment", True)):
        base = conf.filter(F.trim("issuer") != "")
        if filled:
            base = base.filter(F.trim(field) != "")
        # Merge each value's own intervals first: only the earliest start and latest end of a
        # connected run matter, so equal (value, lo, hi) rows collapse map-side.
        runs = base.groupBy("issuer", F.col(field).alias("value"), "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
        starts = runs.groupBy("issuer", "value", F.col("lo").alias("at")).agg(F.sum("n").alias("delta"))
        ends = (runs.groupBy("issuer", "value", F.col("hi").alias("at")).agg((-F.sum("n")).alias("delta")))
        ev = (starts.withColumn("side", F.lit(0)).unionByName(ends.withColumn("side", F.lit(1))))
        per_value = W.partitionBy("issuer", "value").orderBy("at", "side")
        open_v = ev.withColumn("open", F.sum("delta").over(per_value))
        edges = (open_v.withColumn("was", F.coalesce(F.lag("open").over(per_value), F.lit(0)))
                 .withColumn("step", (F.col("open") > 0).cast("int") - (F.col("was") > 0).cast("int"))
                 .groupBy("issuer", "at", "side").agg(F.sum("step").alias("step")))
        live = edges.withColumn("values_open", F.sum("step").over(
            W.partitionBy("issuer").orderBy("at", "side")))
        bad = (live.filter(F.col("values_open") > 1).select("issuer").distinct()
               .select(F.lit("emissor_divergente").alias("rule"), F.col("issuer").alias("instrument"),
                       F.lit(field).alias("detail")))
        out = bad if out is None else out.unionByName(bad)
    return out


def coverage_gaps(table: DataFrame, needs: DataFrame) -> DataFrame:
    """Uncovered intervals per needed (instrument, start, end).

    Interval subtraction: rows sorted by start, the cursor is the day after the furthest end so
    far, and whatever lies between the cursor and the next start is a gap.
    """
    known = table.groupBy("instrument").agg(F.max((F.col("review_status") == "confirmado")).alias("has_confirmed"))
    n = needs.join(known, "instrument", "left")
    whole = (n.filter(~F.coalesce("has_confirmed", F.lit(False)))
             .select("instrument", "start", "end",
                     F.when(F.col("has_confirmed").isNull(), "sem_linha").otherwise("sem_confirmacao").alias("status")))
    c = confirmed(table).select("instrument", "lo", "hi")
    rows = (n.filter("has_confirmed").select("instrument", "start", "end").join(c, "instrument")
            .filter(F.col("hi") >= F.col("start")))
    seq = W.partitionBy("instrument", "start", "end").orderBy("lo", "hi")
    reach = F.max("hi").over(seq.rowsBetween(W.unboundedPreceding, -1))
    after = F.date_add(F.least(reach, F.lit("9999-12-30").cast("date")), 1)
    swept = rows.withColumn("cursor", F.when(reach.isNull(), F.col("start")).otherwise(F.greatest("start", after)))
    inner = (swept.filter((F.col("cursor") <= F.col("end")) & (F.col("lo") > F.col("cursor")))
             .select("instrument", F.col("cursor").alias("start"),
                     F.least(F.date_sub("lo", 1), F.col("end")).alias("end")))
    reached = rows.groupBy("instrument", "start", "end").agg(F.max("hi").alias("top"))
    # No covering row at all keeps the full need; otherwise the tail after the furthest end.
    tail = (n.filter("has_confirmed").select("instrument", "start", "end")
            .join(reached, ["instrument", "start", "end"], "left")
            .withColumn("cursor", F.when(F.col("top").isNull(), F.col("start")).otherwise(
                F.greatest(F.col("start"), F.date_add(F.least("top", F.lit("9999-12-30").cast("date")), 1))))
            .filter(F.col("cursor") <= F.col("end"))
            .select("instrument", F.col("cursor").alias("start"), "end"))
    gaps = inner.unionByName(tail).withColumn("status", F.lit("lacuna_temporal"))
    return whole.unionByName(gaps)
