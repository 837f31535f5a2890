"""Leader-follower candidates inside (window, sector, subsector)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leadwake.config import Liquidity
from leadwake.functions.scalars import smallest_band
from leadwake.operators.checks import require
from leadwake.operators.sectors import sector_in_force
from leadwake.operators.universe import NO_SECTOR

PAIR_COLUMNS = ("window", "sector", "subsector", "leader", "follower", "leader_issuer", "follower_issuer",
                "leader_position", "follower_position", "leader_liquidity", "follower_liquidity", "min_band")


def with_sector_in_force(selection: DataFrame, sector_table: DataFrame) -> DataFrame:
    """Sector valid on the formation date, looked up only for instruments inside a band."""
    in_band = (F.col("reason") == "") & F.col("band").startswith("top")
    keys = (selection.filter(in_band).select("window", "instrument", "formation_date"))
    found = sector_in_force(keys, sector_table, "formation_date").select(
        "window", "instrument", "sector", "subsector")
    out = selection.join(found, ["window", "instrument"], "left")
    return out.withColumns({
        "reason": F.when(in_band & F.col("sector").isNull(), NO_SECTOR).otherwise(F.col("reason")),
        "sector": F.coalesce("sector", F.lit("")), "subsector": F.coalesce("subsector", F.lit(""))})


def _members(selection: DataFrame, bands: tuple[int, ...]) -> DataFrame:
    """At most max(bands) rows per window: the bound every pair product rests on."""
    return selection.filter((F.col("reason") == "") & (F.col("final_position") <= max(bands)))


def candidate_pairs(selection: DataFrame, bands: tuple[int, ...]) -> DataFrame:
    """Every pair of a group, the more liquid instrument leading.

    A window holds at most max(bands) members, so a group cannot outgrow the band limit.
    """
    m = _members(selection, bands)
    side = lambda p: m.select(
        "window", "sector", "subsector", F.col("instrument").alias(p), F.col("issuer").alias(f"{p}_issuer"),
        F.col("final_position").alias(f"{p}_position"), F.col("liquidity").alias(f"{p}_liquidity"))
    both = side("leader").join(side("follower"), ["window", "sector", "subsector"])
    pairs = both.filter(F.col("leader_position") < F.col("follower_position"))
    # The condition repeats the position test because filters may change places.
    same_issuer = ((F.col("leader_issuer") == F.col("follower_issuer"))
                   & (F.col("leader_position") < F.col("follower_position")))
    return require(pairs, same_issuer, F.concat(F.lit("pair with one issuer on both sides: "), "leader", F.lit(" x "), "follower")).withColumn(
        "min_band", smallest_band(F.col("follower_position"), bands)).select(*PAIR_COLUMNS)


def ordered_pairs(selection: DataFrame, bands: tuple[int, ...]) -> DataFrame:
    """Both directions of every group pair with different issuers (placebo lookups)."""
    m = _members(selection, bands)
    a = m.select("window", "sector", "subsector", F.col("instrument").alias("leader"), F.col("issuer").alias("ia"))
    b = m.select("window", "sector", "subsector", F.col("instrument").alias("follower"), F.col("issuer").alias("ib"))
    return (a.join(b, ["window", "sector", "subsector"])
            .filter((F.col("leader") != F.col("follower")) & (F.col("ia") != F.col("ib")))
            .drop("ia", "ib"))


def pairs_within(pairs: DataFrame, cfg: Liquidity) -> DataFrame:
    return pairs.filter(F.col("min_band") <= cfg.top_n)
