"""Shuffled and randomised networks with deterministic, partition-independent draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from leadwake.functions.scalars import hash_key

GROUP = ("window", "sector", "subsector")


def shuffled_pairs(pairs: DataFrame, replicates: int, seed: int, max_attempts: int = 50) -> DataFrame:
    """Followers permuted inside each (window, sector, subsector), once per replicate.

    A permutation that pairs an instrument or issuer with itself is redrawn, up to
    ``max_attempts``; then the original assignment stays.  A group is held as one array: the
    bands limit it to a few thousand edges whatever the data size.  Later attempts are only
    evaluated while no valid one was found.
    """
    edge = F.struct("leader", "follower", "leader_issuer", "follower_issuer")
    groups = pairs.groupBy(*GROUP).agg(F.array_sort(F.collect_list(edge)).alias("edges"))
    reps = (groups.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
            .repartition("replicate", *GROUP))

    def permuted(attempt: Column) -> Column:
        keyed = F.transform("edges", lambda e: F.struct(
            hash_key(seed, F.col("replicate"), attempt, F.col("window"), e["leader"], e["follower"]).alias("k"),
            e["follower"].alias("follower"), e["follower_issuer"].alias("follower_issuer")))
        return F.zip_with("edges", F.array_sort(keyed), lambda e, s: F.struct(
            e["leader"].alias("leader"), s["follower"].alias("follower"),
            ((e["leader"] != s["follower"]) & (e["leader_issuer"] != s["follower_issuer"])).alias("ok")))

    original = F.transform("edges", lambda e: F.struct(
        e["leader"].alias("leader"), e["follower"].alias("follower"), F.lit(True).alias("ok")))
    first_valid = F.aggregate(
        F.sequence(F.lit(0), F.lit(max_attempts - 1)),
        F.lit(None).cast("array<struct<leader:string,follower:string,ok:boolean>>"),
        lambda found, a: F.coalesce(found, F.get(F.filter(
            F.array(permuted(a)), lambda p: F.forall(p, lambda x: x["ok"])), F.lit(0))))
    chosen = F.when(F.size("edges") < 2, original).otherwise(F.coalesce(first_valid, original))
    return (reps.withColumn("p", F.explode(chosen))
            .select("replicate", *GROUP, F.col("p.leader").alias("leader"), F.col("p.follower").alias("follower")))


def placebo_distribution(shuffled: DataFrame, betas: DataFrame) -> DataFrame:
    """Median and mean beta per (window, replicate).

    ``betas`` holds every ordered pair of the groups, estimated once: a shuffled pair's beta
    depends only on (window, leader, follower), so a replicate is a lookup, not a regression.
    """
    rows = shuffled.join(betas.select("window", "leader", "follower", "beta"), ["window", "leader", "follower"], "left")
    return rows.groupBy("window", "replicate").agg(
        F.median("beta").alias("median_beta"), F.avg("beta").alias("mean_beta"), F.count("beta").alias("estimated"))


def placebo_summary(distribution: DataFrame, real: DataFrame) -> DataFrame:
    """Real median against the replicate medians, per window."""
    r = real.groupBy("window").agg(F.median("beta").alias("real_median"), F.avg("beta").alias("real_mean"),
                                   F.count("beta").alias("real_estimated"))
    d = distribution.join(r.select("window", "real_median"), "window")
    s = d.groupBy("window").agg(
        F.count(F.lit(1)).alias("replicates"), F.median("median_beta").alias("placebo_p50"),
        F.percentile("median_beta", F.lit(0.95)).alias("placebo_p95"),
        F.avg(F.when(F.col("median_beta").isNotNull(), (F.col("median_beta") >= F.col("real_median")).cast("int"))).alias("p_empirical"))
    return r.join(s, "window", "left")


def random_followers(pairs: DataFrame, members: DataFrame, replicates: int, seed: int) -> DataFrame:
    """Per (replicate, window, leader): as many distinct same-sector members as it has followers.

    ``members`` is the band universe of each window.  Too few members is an error.
    """
    need = pairs.groupBy("window", "leader").agg(
        F.count_distinct("follower").alias("need"), F.min("sector").alias("sector"),
        F.count_distinct("sector").alias("sectors"))
    cand = (need.join(members.select("window", "sector", F.col("instrument").alias("follower")), ["window", "sector"])
            .filter(F.col("leader") != F.col("follower")))
    reps = cand.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    w = W.partitionBy("replicate", "window", "leader")
    drawn = reps.withColumns({
        "have": F.count(F.lit(1)).over(w),
        "r": F.row_number().over(w.orderBy(
            hash_key(seed, F.col("replicate"), F.col("window"), F.col("leader"), F.col("follower"))))})
    bad = (F.col("have") < F.col("need")) | (F.col("sectors") > 1)
    checked = F.when(bad, F.raise_error(F.concat(
        F.lit("placebo without enough candidates for "), "window", F.lit("/"), "leader"))).otherwise(F.col("follower"))
    return (drawn.withColumn("follower", checked).filter(F.col("r") <= F.col("need"))
            .select("replicate", "window", "leader", "follower"))


def randomisation_p(replicate_totals: DataFrame, total: str, real_total: Column) -> DataFrame:
    """(extremes + 1) / (replicates + 1)."""
    return replicate_totals.agg(
        F.count(F.lit(1)).alias("replicates"), F.count_if(F.col(total) >= real_total).alias("extremes")).withColumn(
        "p", (F.col("extremes") + 1) / (F.col("replicates") + 1))
