"""Running counts inside large groups without gathering a group in one task.

``Window.partitionBy(group).orderBy(...)`` sends a whole group to one task.  With a handful of
walk-forward windows and very many instruments a group is a large share of the table, so the
rows are range-partitioned by (group, order) instead.  Each partition counts locally and adds
the totals of the partitions before it; those totals are one row per (group, partition).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from leadwake.session import materialize

_PART = "__range_part"


def running_counts(df: DataFrame, group: Sequence[str], order: Sequence[Column],
                   flags: Mapping[str, Column]) -> DataFrame:
    """Add, per entry of ``flags``, the 1-based running count of true rows (null where false).

    ``order`` must be total inside a group.  The placed rows are written to the checkpoint
    folder once, so both passes see the same partition borders even after an executor is lost.
    """
    names = list(flags)
    tagged = df.withColumns({f"__f_{n}": F.coalesce(flags[n], F.lit(False)).cast("long") for n in names})
    placed = materialize(
        tagged.repartitionByRange(*[F.col(g) for g in group], *order)
        .withColumn(_PART, F.spark_partition_id()))
    before = W.partitionBy(*group).orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)
    offsets = (placed.groupBy(*group, _PART)
               .agg(*[F.sum(f"__f_{n}").alias(f"__t_{n}") for n in names])
               .select(*group, _PART, *[
                   F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in names]))
    local = W.partitionBy(*group, _PART).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    counted = placed.withColumns({f"__c_{n}": F.sum(f"__f_{n}").over(local) for n in names})
    out = counted.join(offsets, [*group, _PART])
    return (out.withColumns({
        n: F.when(F.col(f"__f_{n}") == 1, F.col(f"__c_{n}") + F.col(f"__o_{n}")) for n in names})
        .drop(_PART, *[f"__{k}_{n}" for k in "fco" for n in names]))
