"""Filing CSV: semicolons, Windows-1252, every field text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from leadwake.operators.events import FILING_COLUMNS, relevant_facts, with_document_id

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in FILING_COLUMNS])


def read_filings(spark: SparkSession, path: str, encoding: str = "windows-1252") -> DataFrame:
    """The 13 columns in published order; a different header fails; empty cells stay empty text.

    Windows-1252 needs ``spark.sql.legacy.javaCharsets``; ISO-8859-1 differs only in 0x80-0x9F.
    """
    df = (spark.read.schema(SCHEMA).option("sep", ";").option("header", True).option("enforceSchema", False)
          .option("encoding", encoding).csv(path))
    return df.fillna("")


def read_relevant_facts(spark: SparkSession, path: str, encoding: str = "windows-1252") -> DataFrame:
    return with_document_id(relevant_facts(read_filings(spark, path, encoding)))


def reference_leaders(table: DataFrame) -> DataFrame:
    """Confirmed reference issuers with codes stripped of leading zeros."""
    return table.select("issuer", F.regexp_replace(F.trim("codigo_cvm"), "^0+", "").alias("codigo_cvm"), "cnpj",
                        F.try_to_date("valid_from").alias("valid_from"), F.try_to_date("valid_to").alias("valid_to"), "review_status")


def leader_violations(table: DataFrame) -> DataFrame:
    """Empty cells, unconfirmed rows, repeated issuer, code or tax id, inverted validity."""
    from functools import reduce
    from leadwake.operators.checks import check, duplicates
    t = reference_leaders(table)
    empty = F.lit(False)
    for c in ("issuer", "codigo_cvm", "cnpj"):
        empty = empty | (F.coalesce(F.trim(F.col(c)), F.lit("")) == "")
    parts = [check(t, "celula_vazia", empty), check(t, "nao_confirmado", F.col("review_status") != "confirmado"),
             check(t, "validade_invertida", F.coalesce(F.col("valid_from") > F.col("valid_to"), F.lit(False)))]
    parts += [duplicates(t, f"{c}_repetido", [c]) for c in ("issuer", "codigo_cvm", "cnpj")]
    return reduce(DataFrame.unionByName, parts)
