"""Stored tables: partitioned sinks, pruned loads, contract-checked result tables."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from leadwake.operators.checks import check, duplicates, enforce


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), fmt: str = "parquet") -> None:
    """One table per result; rows of a partition value are spread over tasks, not gathered in one."""
    w = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def write_quotes(quotes: DataFrame, path: str) -> None:
    """Quotes partitioned by year, so that period loads prune folders."""
    write_table(quotes.withColumn("year", F.year("date")), path, ("year",))


def load_quotes(spark: SparkSession, path: str, start: date, end: date | None = None) -> DataFrame:
    """Rows of a period; the year bounds prune partitions, the date bounds reach the scan."""
    q = spark.read.parquet(path).filter((F.col("year") >= start.year) & (F.col("date") >= F.lit(start)))
    if end is not None:
        q = q.filter((F.col("year") <= end.year) & (F.col("date") <= F.lit(end)))
    return q


def store_checked(quotes: DataFrame, path: str, expected_rows: int) -> DataFrame:
    """Store and verify that nothing was lost between the raw count and the table."""
    write_quotes(quotes, path)
    back = quotes.sparkSession.read.parquet(path)
    got = back.count()
    if got != expected_rows:
        raise ValueError(f"stored {got} rows, expected {expected_rows}")
    return back


def universe_contract(selection: DataFrame, names: int, windows: DataFrame) -> DataFrame:
    """Every window: exactly ``names`` positions 1..names, distinct issuers."""
    top = selection.filter((F.col("reason") == "") & (F.col("final_position") <= names))
    g = windows.select("window").join(top.groupBy("window").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("issuer").alias("issuers"), F.count_distinct("final_position").alias("positions"),
        F.min("final_position").alias("lo"), F.max("final_position").alias("hi")), "window", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return reduce(DataFrame.unionByName, [
        check(g, "nomes_por_janela", n("n") != names), check(g, "emissores_distintos", n("issuers") != n("n")),
        check(g, "posicoes_completas", (n("positions") != names) | (n("lo") != 1) | (n("hi") != names))])


def pairs_contract(pairs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [
        check(pairs, "mesmo_emissor", F.col("leader_issuer") == F.col("follower_issuer")),
        check(pairs, "par_proprio", F.col("leader") == F.col("follower")), duplicates(pairs, "aresta_repetida", ["window", "leader", "follower"])])


def network_contract(network: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [check(network, "beta_ausente", F.col("beta").isNull()),
                                          duplicates(network, "beta_repetido", ["window", "leader", "follower"])])


def pairs_with_betas(pairs: DataFrame, network: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(joined, checks): one-to-one join whose key sets must be equal both ways."""
    key = ["window", "leader", "follower"]
    checks = reduce(DataFrame.unionByName, [
        check(pairs.select(*key).join(network, key, "left_anti"), "par_sem_beta", F.lit(True)),
        check(network.select(*key).join(pairs, key, "left_anti"), "beta_sem_par", F.lit(True))])
    return pairs.join(network.select(*key, "beta", "t_stat", "n"), key), checks


def load_checked(spark: SparkSession, path: str, contract) -> DataFrame:
    """Read a stored result table and enforce its contract before handing it on."""
    df = spark.read.parquet(path)
    enforce(contract(df))
    return df
