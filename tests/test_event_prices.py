"""Which prices an event study carries."""

from datetime import date
from types import SimpleNamespace

from leadwake.config import Liquidity
from leadwake.plans.event_study import EventStudy


def test_only_members_prices_are_kept(spark):
    days = [date(2020, 1, d) for d in range(1, 4)]
    quotes = spark.createDataFrame([(d, f"T{i}", 1.0 + i, 2.0 + i) for d in days for i in range(20)], "date date, instrument string, open double, close double")
    rows = [("w1", "s", "T1", 1, ""), ("w1", "s", "T2", 2, ""), ("w1", "s", "T3", 3, ""), ("w2", "s", "T4", 1, ""), ("w2", "s", "T5", 2, "sem"), ("w2", "s", "T6", None, "x")]
    study = SimpleNamespace(
        quotes=quotes, calendar=spark.createDataFrame([(d, k) for k, d in enumerate(days)], "date date, pos int"), cfg=SimpleNamespace(liquidity=Liquidity(bands=(1, 2))),
        selection_with_sector=spark.createDataFrame(rows, "window string, sector string, instrument string, final_position int, reason string"))
    got = {tuple(r) for r in EventStudy(study, None, None).prices.collect()}
    assert got == {(f"T{i}", k, 1.0 + i, 2.0 + i) for i in (1, 2, 4) for k in range(3)}
