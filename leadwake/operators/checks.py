"""Contract checks as data: (check, rows, violations).  ``enforce`` raises when asked to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def check(df: DataFrame, name: str, bad: Column, scope: Column | None = None) -> DataFrame:
    inside = F.lit(True) if scope is None else scope
    return df.agg(F.count_if(inside).alias("rows"), F.count_if(inside & bad).alias("violations")).select(
        F.lit(name).alias("check"), "rows", "violations")


def check_many(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Several rules over one table in one pass."""
    agg = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(f"v_{n}") for n, c in rules.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"v_{n}").alias("violations")) for n in rules]))
    return agg.withColumn("__c", pairs).select("__c.check", "rows", "__c.violations")


def duplicates(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Surplus rows per key, summed after a partial aggregate."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("violations")).select(
        F.lit(name).alias("check"), F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("violations", F.lit(0)).alias("violations"))


def require(df: DataFrame, bad: Column, message: Column) -> DataFrame:
    """The same rows; reading them raises where ``bad`` holds.

    The test is a row filter, so it stays in the plan whichever columns are read afterwards.
    """
    return df.filter(F.when(F.coalesce(bad, F.lit(False)), F.raise_error(message).cast("boolean")).otherwise(True))


def enforce(table: DataFrame) -> None:
    """Raise on all violated checks; the table has one row per check."""
    failed = table.filter("violations > 0").collect()
    if failed:
        raise ValueError("; ".join(f"{r['check']}: {r['violations']} of {r['rows']}" for r in failed))


def study_invariants(book: DataFrame, scenarios: DataFrame, controlled: DataFrame, selected: DataFrame,
                     max_observations: int) -> DataFrame:
    """Invariants that any stored run must satisfy."""
    ladder = W.partitionBy("rule", "mode", "pos").orderBy("rate")
    steps = scenarios.withColumn("before", F.lag("net_pnl").over(ladder)).filter(F.col("before").isNotNull())
    per_window = controlled.groupBy("window").agg(F.count("p_value").alias("h"), F.count_if("approved").alias("a"))
    parts = [
        check_many(book, {
            "liquido_nao_supera_bruto": F.col("net_pnl") > F.col("gross_pnl") + 1e-12,
            "exposicao_bruta_ate_1": F.col("gross_exposure") > 1 + 1e-9,
            "giro_nao_negativo": F.col("turnover") < 0}),
        check(book, "long_only_sem_vendida", F.col("short_exposure") > 1e-12, F.col("mode") == "long_only"),
        check(steps, "aluguel_monotono", F.col("net_pnl") > F.col("before") + 1e-12),
        check(selected, "beta_selecionado_positivo", F.col("beta") <= 0),
        check_many(controlled, {
            "lider_mais_liquida": F.col("leader_position") >= F.col("follower_position"),
            "sem_par_proprio": F.col("leader") == F.col("follower"),
            "observacoes_ate_limite": F.col("n") > max_observations}),
        check(per_window, "aprovados_ate_hipoteses", F.col("a") > F.col("h"))]
    return reduce(DataFrame.unionByName, parts)
