"""False-discovery control inside a window and the frozen pair selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from leadwake.config import Discovery


def benjamini_hochberg(df: DataFrame, partition: Sequence[str], p: str, q: float,
                       ties: Sequence[str] = ()) -> DataFrame:
    """Step-up adjusted p and approval inside each partition; null p is not a hypothesis.

    A partition is one window's pair list, which the bands bound.
    """
    by = W.partitionBy(*partition)
    seq = by.orderBy(F.col(p).asc_nulls_last(), *[F.col(t) for t in ties])
    upward = by.orderBy(F.col("__rank").asc_nulls_last()).rowsBetween(0, W.unboundedFollowing)
    ranked = df.withColumns({"__m": F.count(p).over(by),
                             "__rank": F.when(F.col(p).isNotNull(), F.row_number().over(seq))})
    passing = F.when(F.col(p) <= F.col("__rank") * F.lit(q) / F.col("__m"), F.col("__rank"))
    out = ranked.withColumns({
        "p_adjusted": F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min(
            F.col(p) * F.col("__m") / F.col("__rank")).over(upward))),
        "__cut": F.max(passing).over(by)})
    return (out.withColumn("approved", F.coalesce(F.col("__rank") <= F.col("__cut"), F.lit(False)))
            .drop("__m", "__rank", "__cut"))


def control_discoveries(network: DataFrame, cfg: Discovery | None = None,
                        extra: Sequence[str] = ()) -> DataFrame:
    """Per-window (and per extra key) control; isolation between windows is by construction."""
    cfg = cfg or Discovery()
    return benjamini_hochberg(network, ["window", *extra], "p_value", cfg.q, ("leader", "follower"))


def by_band(network: DataFrame, bands: Sequence[int]) -> DataFrame:
    """Repeat each pair for every cumulative band that contains it."""
    return (network.withColumn("band", F.explode(F.array(*[F.lit(int(b)) for b in bands])))
            .filter(F.col("min_band") <= F.col("band")))


def discovery_summary(controlled: DataFrame, cfg: Discovery | None = None, extra: Sequence[str] = ()) -> DataFrame:
    cfg = cfg or Discovery()
    return controlled.groupBy("window", *extra).agg(
        F.count("p_value").alias("hypotheses"), F.count_if(F.col("p_value").isNull()).alias("not_estimated"),
        F.count_if(F.col("p_value") <= cfg.q).alias("uncorrected"),
        F.count_if("approved").alias("approved"),
        F.count_if(F.col("approved") & (F.col("beta") > 0)).alias("approved_positive"))


def select_pairs(controlled: DataFrame, rules: Sequence[str] | None = None,
                 cfg: Discovery | None = None) -> DataFrame:
    """Frozen pairs per rule, told apart by the ``rule`` column; negative beta never trades.

    ``fdr`` keeps approved pairs; ``top_k`` the k largest training t of the window.
    """
    cfg = cfg or Discovery()
    rules = tuple(rules or cfg.rules)
    unknown = set(rules) - {"fdr", "top_k"}
    if unknown:
        raise ValueError(f"unknown rule {sorted(unknown)}")
    seq = W.partitionBy("window").orderBy(F.col("t_stat").desc_nulls_last(), "leader", "follower")
    hits = {"fdr": F.col("approved"), "top_k": F.col("__r") <= cfg.top_k}
    return (controlled.filter(F.col("beta") > 0).withColumn("__r", F.row_number().over(seq))
            .withColumn("rule", F.explode(F.array_compact(F.array(*[F.when(hits[r], F.lit(r)) for r in rules]))))
            .drop("__r"))
