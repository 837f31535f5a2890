"""Session helpers: checkpoint folder and the builder used by tests and the benchmark."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "leadwake", cores: str | int = "*", partitions: int = 8) -> SparkSession:
    return (SparkSession.builder.master(f"local[{cores}]").appName(app)
            .config("spark.sql.shuffle.partitions", str(partitions))
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
            .config("spark.driver.memory", os.environ.get("LEADWAKE_DRIVER_MEMORY", "12g"))
            .getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    A session whose executors are threads of the driver (``local[...]``) may go without: it gets a temporary one.
    On a cluster a folder of one machine would lose rows, so there the setting is required.
    """
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write a stage table to the shared folder and read it back.

    Lineage is cut, a lost executor loses no work, and the reader knows the table's true size,
    so small stage tables are joined by broadcast and large ones are not.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
