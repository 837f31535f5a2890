"""Session calendar, walk-forward windows, as-of lookups on the calendar."""

from __future__ import annotations

from calendar import monthrange
from datetime import date
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from leadwake.config import WalkForward

WINDOW_SCHEMA = T.StructType([
    T.StructField("window_id", T.IntegerType(), False),
    T.StructField("window", T.StringType(), False),
    T.StructField("train_start", T.DateType(), False),
    T.StructField("train_end", T.DateType(), False),
    T.StructField("test_start", T.DateType(), False),
    T.StructField("test_end", T.DateType(), False),
])


def session_calendar(quotes: DataFrame, min_instruments: int = 20) -> DataFrame:
    """Dates on which enough distinct instruments traded, with their position from 0.

    The final numbering is one task over one row per date.
    """
    days = (quotes.groupBy("date").agg(F.count_distinct("instrument").alias("instruments"))
            .filter(F.col("instruments") >= min_instruments))
    return days.select("date", "instruments",
                       (F.row_number().over(W.orderBy("date")) - 1).alias("pos"))


def listing_span(quotes: DataFrame) -> DataFrame:
    return quotes.groupBy("instrument").agg(F.min("date").alias("first_date"),
                                            F.max("date").alias("last_date"))


def add_months(d: date, months: int) -> date:
    """Calendar-month offset that clips to the last day of the target month."""
    year, month = divmod(d.year * 12 + d.month - 1 + months, 12)
    return date(year, month + 1, min(d.day, monthrange(year, month + 1)[1]))


def walk_forward_windows(spark: SparkSession, start: date, end: date,
                         cfg: WalkForward | None = None, train_months: int | None = None) -> DataFrame:
    """Half-open train and test windows; the train end equals the test start.

    A few dozen rows fixed by the study period, so this is a literal table.  A day that a short month clips stays
    clipped for the later starts.
    """
    cfg = cfg or WalkForward()
    train, step = train_months or cfg.train_months, cfg.test_months
    origin = start.year * 12 + start.month - 1
    offsets = range(0, end.year * 12 + end.month - origin, step)
    months = [((origin + k) // 12, (origin + k) % 12 + 1) for k in offsets]
    days = list(accumulate((monthrange(*m)[1] for m in months), min, initial=start.day))[1:]
    begins = [date(*m, d) for m, d in zip(months, days)]
    ends = [(add_months(b, train), add_months(add_months(b, train), step)) for b in begins]
    rows = [(i, f"{mid:%Y-%m}", b, mid, mid, last) for i, (b, (mid, last)) in enumerate(zip(begins, ends)) if last <= end]
    if not rows:
        return spark.createDataFrame([], WINDOW_SCHEMA)
    values = ", ".join("({}, '{}', date'{}', date'{}', date'{}', date'{}')".format(*r) for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(window_id, window, train_start, train_end, test_start, test_end)")


def windows_of_period(quotes: DataFrame, start: date, end: date | None = None,
                      cfg: WalkForward | None = None, train_months: int | None = None) -> DataFrame:
    """Windows up to ``end``, or up to the last quoted date (one scalar read) when it is open."""
    last = end or quotes.agg(F.max("date")).first()[0]
    return walk_forward_windows(quotes.sparkSession, start, last, cfg, train_months)


def windows_from_labels(pairs: DataFrame, cfg: WalkForward | None = None) -> DataFrame:
    """Rebuild window bounds from ``YYYY-MM`` labels carried by a result table."""
    cfg = cfg or WalkForward()
    start = F.to_date(F.concat("window", F.lit("-01")))
    return (pairs.select("window").distinct()
            .select(F.col("window"),
                    F.add_months(start, -cfg.train_months).alias("train_start"),
                    start.alias("train_end"), start.alias("test_start"),
                    F.add_months(start, cfg.test_months).alias("test_end")))


def in_windows(df: DataFrame, windows: DataFrame, part: str = "train", on: str = "date") -> DataFrame:
    """Rows repeated for every window whose ``part`` interval holds the date.

    Window months are listed and matched by month, so this is an equality join with a residual
    range test instead of a nested loop over windows.
    """
    lo, hi = f"{part}_start", f"{part}_end"
    months = windows.select(
        "*", F.explode(F.sequence(F.trunc(lo, "month"), F.trunc(F.date_sub(hi, 1), "month"),
                                  F.expr("interval 1 month"))).alias("__month"))
    return (df.withColumn("__month", F.trunc(on, "month"))
            .join(months, "__month")
            .filter((F.col(on) >= F.col(lo)) & (F.col(on) < F.col(hi)))
            .drop("__month"))


def session_lookup(calendar: DataFrame) -> DataFrame:
    """One row per civil day up to the last session, with the first session strictly after it.

    Expanding the calendar turns the strict forward as-of search into an equality join.  Days
    before the first session are handled by the caller (they map to that first session).
    """
    prev = F.lag("date").over(W.orderBy("date"))
    spans = calendar.select(F.col("date").alias("next_session"), prev.alias("from_day"))
    return (spans.filter(F.col("from_day").isNotNull())
            .select("next_session",
                    F.explode(F.sequence("from_day", F.date_sub("next_session", 1))).alias("day")))


def next_session(events: DataFrame, calendar: DataFrame, on: str,
                 out: str = "session") -> tuple[DataFrame, DataFrame]:
    """(accepted, diagnostics): the first session strictly after ``on``; none left is a reason."""
    first = calendar.agg(F.min("date")).scalar()
    looked = (events.join(session_lookup(calendar), F.col(on) == F.col("day"), "left")
              .withColumn(out, F.when(F.col(on) < first, first).otherwise(F.col("next_session")))
              .drop("day", "next_session"))
    accepted = looked.filter(F.col(out).isNotNull())
    missing = (looked.filter(F.col(out).isNull())
               .withColumn("reason", F.lit("sem_sessao_posterior_no_calendario")))
    return accepted, missing
