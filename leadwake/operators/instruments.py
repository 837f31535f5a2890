"""Instrument classification and value checks on quote records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leadwake.functions.scalars import event_token, instrument_kind

# Accepted and excluded instrument types, and the ISIN types they pair with.
ACCEPTED_KINDS = ("ON", "PN", "PNA", "PNB", "PNC", "PND", "PNE", "PNF", "UNT")
EXCLUDED_KINDS = ("DRN", "DR1", "DR2", "DR3", "DRE", "CI", "IBO", "SML")
EQUITY_ISIN = ("ACN", "CDA", "UNT")
NON_EQUITY_ISIN = ("BDR", "CTF", "IND")


def with_derived(quotes: DataFrame) -> DataFrame:
    """Derived columns, recomputed on every read and never stored."""
    return quotes.withColumns({"kind": instrument_kind(F.coalesce("spec", F.lit(""))),
                               "isin_type": F.substring("isin", 7, 3),
                               "event": event_token(F.coalesce("spec", F.lit("")))})


def candidates(quotes: DataFrame, markets=("010",), bdi=("02",)) -> DataFrame:
    return quotes.filter(F.col("market").isin(*markets) & F.col("bdi").isin(*bdi))


def unclassified(quotes: DataFrame, markets=("010",), bdi=("02",)) -> DataFrame:
    """Types in neither list whose ISIN does not already exclude them; must be empty to go on."""
    known = F.col("kind").isin(*ACCEPTED_KINDS, *EXCLUDED_KINDS)
    return (candidates(quotes, markets, bdi).filter(~F.col("isin_type").isin(*NON_EQUITY_ISIN) & ~known)
            .groupBy("kind").agg(F.count_distinct("instrument").alias("instruments"), F.median("trades").alias("median_trades")))


def cash_equities(quotes: DataFrame, markets=("010",), bdi=("02",)) -> DataFrame:
    """Cash-market equities where specification and ISIN agree; an unknown type raises."""
    c = candidates(quotes, markets, bdi)
    out_by_isin = F.col("isin_type").isin(*NON_EQUITY_ISIN)
    unknown = ~out_by_isin & ~F.col("kind").isin(*ACCEPTED_KINDS, *EXCLUDED_KINDS)
    keep = F.when(unknown, F.raise_error(F.concat(F.lit("unclassified instrument type: "), "kind"))).otherwise(
        F.col("kind").isin(*ACCEPTED_KINDS) & F.col("isin_type").isin(*EQUITY_ISIN))
    return c.filter(keep.cast("boolean"))


def kind_isin_conflicts(quotes: DataFrame) -> DataFrame:
    return quotes.filter(F.col("kind").isin(*ACCEPTED_KINDS) != F.col("isin_type").isin(*EQUITY_ISIN))


def value_audit(quotes: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """One row of coherence counts; ``layout_errors`` must be zero."""
    q = quotes.withColumns({"pool": F.col("market").isin("010") & F.col("bdi").isin("02") & F.col("kind").isin(*ACCEPTED_KINDS)})
    priced = F.col("close") > 0
    bad_order = priced & ((F.col("low") > F.col("high")) | (F.col("close") < F.col("low")) | (F.col("close") > F.col("high"))
                          | (F.col("avg") < F.col("low")) | (F.col("avg") > F.col("high")))
    base = F.col("quantity") * F.col("avg")
    err = F.when((F.col("quantity") > 0) & (F.col("avg") > 0) & (F.col("volume") > 0), F.abs((F.col("volume") - base) / base))
    liquid = F.when((F.col("trades") >= 100) & (F.col("avg") >= 1.0), err)
    main = q.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if((F.col("volume") < 0) | (F.col("trades") < 0) | (F.col("quantity") < 0)).alias("negatives"),
        F.count_if(F.col("close") <= 0).alias("non_positive_price"), F.count_if(bad_order).alias("incoherent_prices"),
        F.median(err).alias("error_median"), F.count(liquid).alias("liquid_rows"), F.median(liquid).alias("liquid_error_median"),
        F.percentile(liquid, F.lit(0.99)).alias("liquid_error_p99"),
        F.avg((liquid > tolerance).cast("int")).alias("liquid_share_over"),
        F.min(F.when(priced, F.col("close"))).alias("price_min"), F.max(F.when(priced, F.col("close"))).alias("price_max"),
        F.min(F.when(priced & F.col("pool"), F.col("close"))).alias("pool_price_min"),
        F.max(F.when(priced & F.col("pool"), F.col("close"))).alias("pool_price_max"))
    dup = (q.groupBy("date", "instrument").agg(F.count(F.lit(1)).alias("n"), F.count_if("pool").alias("p"))
           .agg(F.sum(F.col("n") - 1).alias("duplicates"), F.sum(F.greatest(F.col("p") - 1, F.lit(0))).alias("pool_duplicates")))
    both = main.withColumn("k", F.lit(1)).join(dup.withColumn("k", F.lit(1)), "k").drop("k")
    return both.withColumn("layout_errors", F.col("negatives") + F.col("pool_duplicates")
                           + F.coalesce((F.col("liquid_error_median") > tolerance).cast("int"), F.lit(0)))


def category_inventory(quotes: DataFrame) -> DataFrame:
    """Rows, instruments and four examples per market, lot code and type, in one pass.

    Distinct instruments are reduced per (field, value, instrument) first, so a category holding
    most rows is combined map-side; the examples are a bounded minimum, not a collected set.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("bdi", "market", "kind")]))
    per = (quotes.withColumn("p", pairs).groupBy(F.col("p.field").alias("field"), F.col("p.value").alias("value"), "instrument")
           .agg(F.count(F.lit(1)).alias("n")))
    totals = per.groupBy("field", "value").agg(F.sum("n").alias("records"), F.count(F.lit(1)).alias("instruments"))
    # Four smallest names per category: keep each partition's own four before the final pick.
    salted = per.withColumn("salt", F.pmod(F.xxhash64("instrument"), F.lit(64)))
    from pyspark.sql import Window as W
    first = (salted.withColumn("r", F.row_number().over(W.partitionBy("field", "value", "salt").orderBy("instrument")))
             .filter("r <= 4"))
    names = first.groupBy("field", "value").agg(
        F.array_join(F.slice(F.array_sort(F.collect_list("instrument")), 1, 4), ", ").alias("examples"))
    return totals.join(names, ["field", "value"])


def issuer_audit(quotes: DataFrame) -> DataFrame:
    """Instruments with a malformed ISIN, or whose issuer appears under several names."""
    from leadwake.functions.scalars import issuer_of
    prof = quotes.groupBy("instrument").agg(F.min_by("isin", "date").alias("isin"), F.min_by("name", "date").alias("name"))
    prof = prof.withColumn("issuer", issuer_of(F.col("isin")))
    names = (prof.filter("issuer is not null").select("issuer", "name").distinct().groupBy("issuer")
             .agg(F.array_sort(F.collect_set("name")).alias("names")).filter(F.size("names") > 1))
    out = prof.join(names, "issuer", "left")
    return out.withColumn("alert", F.when(F.col("issuer").isNull(), "isin_ausente_ou_invalido")
                          .when(F.col("names").isNotNull(), "nomes_divergentes_no_emissor").otherwise("")).filter("alert <> ''") \
        .withColumn("issuer_names", F.coalesce(F.array_join("names", " | "), F.lit("")))
