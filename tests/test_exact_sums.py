"""Exact sums: equal to rational arithmetic, the same under any partitioning, zero where parts cancel."""

import math
import random
from fractions import Fraction

from pyspark.sql import Window as W, functions as F

from leadwake.functions.exact import exact_sum


def given(n=4000):
    rng = random.Random(5)
    out = []
    for k in range(n):
        x = rng.choice([1, -1]) * rng.random() * 10.0 ** rng.randint(-25, 15)
        out += [(k % 7, x)] + ([(k % 7, -x)] if rng.random() < .5 else [])
    rng.shuffle(out)
    return out


def test_equal_to_fractions_under_any_partitioning(spark):
    rows = given()
    want = {k: float(sum(Fraction(x) for j, x in rows if j == k)) for k in range(7)}
    df = spark.createDataFrame(rows, "k int, x double")
    seen = []
    for n in (1, 8, 200):
        got = {r.k: r.s for r in df.repartition(n, F.rand(n)).groupBy("k").agg(exact_sum("x").alias("s")).collect()}
        seen.append(got)
        assert all(math.isclose(got[k], want[k], rel_tol=3e-16) for k in want)
    assert seen[0] == seen[1] == seen[2]
    over = df.withColumn("s", exact_sum("x", W.partitionBy("k"))).select("k", "s").distinct().collect()
    assert {r.k: r.s for r in over} == seen[0]


def test_cancelled_null_and_wild(spark):
    rows = [(1, 0.1), (1, 0.2), (1, -0.2), (1, -0.1), (2, None), (3, 1e16), (3, 1.0), (3, -1e16), (4, float("inf")), (4, 1.0), (5, float("nan")), (6, 1e300), (6, 1.0),
            (7, 2.0 ** 61), (7, 2.0 ** -100), (7, -2.0 ** 61), (8, 1 / 3), (8, 1 / 3), (8, 1 / 3), (8, -1.0)]
    got = {r.k: r.s for r in spark.createDataFrame(rows, "k int, x double").groupBy("k").agg(exact_sum("x").alias("s")).collect()}
    assert got[1] == 0.0 and got[2] is None and got[3] == 1.0 and got[4] == float("inf") and math.isnan(got[5]) and got[6] == 1e300 and got[7] == 2.0 ** -100
    assert got[8] == math.fsum([1 / 3, 1 / 3, 1 / 3, -1.0])
    assert spark.createDataFrame([], "x double").agg(exact_sum("x")).first()[0] is None


def test_randomisation_does_not_depend_on_partitions(spark):
    """Planted ties: replicates whose positions are those of the real network, summed in other orders."""
    import __spark_entry__ as entry
    from leadwake.operators import placebo

    rng = random.Random(9)
    real = [rng.uniform(-1, 1) * 10 ** rng.randint(-6, 0) for _ in range(60)]
    rows = []
    for rep in range(60):
        part = list(real) if rep < 25 else [x + 1e-9 * (rep - 42) for x in real]
        rng.shuffle(part)
        rows += [(rep, x) for x in part]
    flows = spark.createDataFrame(rows, "replicate int, net_pnl double")
    total = spark.createDataFrame([(x,) for x in real], "x double").agg(exact_sum("x")).scalar()
    for n in (1, 8, 200):
        totals = flows.repartition(n, F.rand(n)).groupBy("replicate").agg(exact_sum("net_pnl").alias("t"))
        assert placebo.randomisation_p(totals, "t", total).first().extremes == 25 + 18
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        seen = set()
        for n in ("1", "8", "200"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.add(tuple(entry.queries()["est_20_randomisation_p"](spark, "/root/testdata/sf0.001").first()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(seen) == 1
