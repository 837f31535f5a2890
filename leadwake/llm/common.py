"""Helpers shared by the text operators."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from leadwake.session import materialize

#: ASCII white space: blank and the controls from tab to carriage return.
SPACE = "\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
#: Rows per Arrow batch; texts can be long, so a batch holds few of them.
BATCH_ROWS = 512


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` with batches small enough for long texts."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(fn, schema)


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def hash_bucket(column: Column, seed: int, buckets: int) -> Column:
    """A stable bucket of a value; nulls have one as well."""
    return F.pmod(F.xxhash64(F.lit(seed), F.coalesce(column.cast("string"), F.lit("\x00"))), F.lit(buckets))


def uniform(seed: int, *columns: Column) -> Column:
    """A number in (0, 1) fixed by the seed and the values."""
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11)
    return (h.cast("double") + 0.5) / float(1 << 53)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge list: root is the smallest node reachable.

    Alternates the large-star and small-star contractions; each round is two aggregations of the edges and the
    number of rounds grows with the logarithm of the longest path.  Star centres are minima, found by map-side
    combined aggregates, so a hub with very many edges is never gathered.  Every round is written to the shared
    folder.  Only a count and a checksum per round reach the driver.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct()
    pairs = materialize(pairs)
    before = None
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(
            low.select("u", F.col("m").alias("v"))).distinct()
        pairs = materialize(small)
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = pairs.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.union(pairs.select("v", "v")).groupBy("node").agg(F.min("root").alias("root"))
