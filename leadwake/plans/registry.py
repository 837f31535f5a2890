"""Query registry: each entry pairs a Spark plan with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from leadwake.operators import returns, sessions
from leadwake.oracle.ctes import resolve
from leadwake.plans import bindings as b
from leadwake.session import materialize, shared_folder


_STUDIES: dict = {}
_TABLES: dict = {}


def _identity(spark: SparkSession, folder: str) -> tuple:
    """Names, lengths and times of what the folder holds, so that changed inputs never meet stored tables."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))


class Context:
    """The domain tables of one folder of test data.

    Bars and calendars are stored once per session and state of the inputs, like the stages of the study: queries then read
    small narrow tables instead of the lines, and Spark knows the calendar's size and sends it to the bars.
    """

    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf = spark, sf.rstrip("/")

    @cached_property
    def key(self) -> tuple:
        return self.spark.sparkContext.applicationId, shared_folder(self.spark), self.sf, _identity(self.spark, self.sf)

    def stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if (self.key, name) not in _TABLES:
            _TABLES[self.key, name] = materialize(build())
        return _TABLES[self.key, name]

    def table(self, name: str) -> DataFrame:
        return b.table(self.spark, self.sf, name)

    cfg = b.MONTHLY

    @property
    def study(self):
        """Stage tables are stored once per session and data folder and then shared by queries."""
        if self.key not in _STUDIES:
            _STUDIES[self.key] = b.study(self.spark, self.sf, b.MONTHLY, self.monthly)
        return _STUDIES[self.key]

    @cached_property
    def windows(self) -> DataFrame:
        return b.windows(self.spark)

    @cached_property
    def daily(self) -> DataFrame:
        return self.stored("daily", lambda: b.quotes(self.spark, self.sf, "day"))

    @cached_property
    def monthly(self) -> DataFrame:
        return self.stored("monthly", lambda: b.quotes(self.spark, self.sf, "month"))

    @cached_property
    def sectors(self) -> DataFrame:
        return b.sector_table(self.spark, self.sf)

    def calendar(self, freq: str = "day") -> DataFrame:
        q = self.daily if freq == "day" else self.monthly
        return self.stored(f"calendar of {freq}", lambda: sessions.session_calendar(q.select("date", "instrument"), b.MIN_INSTRUMENTS))

    def panel(self, freq: str = "day") -> DataFrame:
        q = self.daily if freq == "day" else self.monthly
        return returns.panel(q, self.calendar(freq))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Doubles are compared after rounding.  The rounding point lies off the half, because values such as
# 0.0001325 sit exactly on a half and two engines may differ there in the last bit.
_DATE = "CAST(CAST({c} AS DATE) AS VARCHAR)"
_SPARK = {"s": lambda c: c.cast("string"), "t": lambda c: c, "d": lambda c: c.cast("date").cast("string"), "i": lambda c: c.cast("long"),
          "b": lambda c: c.cast("int"), "f": lambda c: F.floor(c.cast("double") * 1e6 + 0.50031) / 1e6,
          "g": lambda c: F.floor(c.cast("double") * 1e4 + 0.50031) / 1e4,
          "e": lambda c: F.floor(c.cast("double") * 1e9 + 0.50031) / 1e9}
_SQL = {"s": "CAST({c} AS VARCHAR)", "d": _DATE, "t": _DATE, "i": "CAST({c} AS BIGINT)",
        "b": "CAST({c} AS INTEGER)", "f": "floor(CAST({c} AS DOUBLE) * 1e6 + 0.50031) / 1e6",
        "g": "floor(CAST({c} AS DOUBLE) * 1e4 + 0.50031) / 1e4", "e": "floor(CAST({c} AS DOUBLE) * 1e9 + 0.50031) / 1e9"}


def _columns(cols: str):
    for item in cols.split():
        left, kind = item.rsplit(":", 1)
        name, _, source = left.partition("<")
        yield name, source or name, kind


def register(name: str, cols: str, plan: Callable[[Context], DataFrame], sql: str | None) -> None:
    """``cols`` lists ``name:type`` or ``name<spark_column:type``; types are s d i b f g e, and t for dates that the plan gives as text."""
    if name in QUERIES:
        raise ValueError(f"duplicate query {name}")

    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = plan(Context(spark, sf))
        return df.select(*[_SPARK[k](F.col(src)).alias(n) for n, src, k in _columns(cols)])

    QUERIES[name] = run
    if sql is not None:
        picked = ", ".join(_SQL[k].format(c=f'"{n}"') + f' AS "{n}"' for n, _, k in _columns(cols))
        ORACLES[name] = resolve(f"SELECT {picked} FROM ({sql}) t")
