"""One digest for a whole table, whatever its partitioning or row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Hexadecimal digits of a row's hash that name its node, level by level up to the root (fixed values).
LEVELS = (9, 6, 3, 0)


def row_text(*columns: str) -> Column:
    """Values with their lengths, nulls as '-', so that no two different rows have one text."""
    value = lambda c: F.col(c).cast("string")
    return F.concat_ws(";", *[F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.length(value(c)).cast("string"), F.lit(":"), value(c))) for c in columns])


def table_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """rows and digest of the named columns: one row, for an empty table too.

    Rows are ordered by their hashes and equal rows counted.  The borders of the ranges are prefixes of the hash, so no task
    holds more than the rows of one prefix and the 4 096 children of a node; only counts and hashes are exchanged.
    """
    rows = df.select(F.sha2(row_text(*columns), 256).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("rows"))
    level = rows.select("name", "rows", F.lit("").alias("digest"))
    for width in LEVELS:
        child = F.concat_ws(":", "name", F.col("rows").cast("string"), "digest")
        group = level.groupBy(F.substring("name", 1, width).alias("name")) if width else level
        level = group.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.sha2(F.array_join(F.array_sort(F.collect_list(child)), ","), 256).alias("digest"))
    return level.select("rows", "digest")
