"""The liquidity profile against plain Python, and how quotes are dealt out for it."""

from datetime import date, timedelta
from statistics import mean, median

import pytest

from leadwake.config import Liquidity
from leadwake.operators import sessions, universe


def _quotes(spark):
    rows = []
    for i in range(5):
        for k in range(0, 1100, 9):
            if (k * (i + 3)) % 7 == i:
                continue
            d = date(2015, 1, 1) + timedelta(days=k)
            volume = None if (k + i) % 11 == 0 else float((k * 31 + i * 17) % 23)
            rows.append((d, f"T{i}", volume, (k * 7 + i) % 13 if k % 5 else None, "BRPETRACNOR9" if k % 3 else None, f"K{k % 4}", f"E{i}"))
    return spark.createDataFrame(rows, "date date, instrument string, volume double, trades long, isin string, kind string, name string"), rows


@pytest.mark.parametrize("statistic", ["median", "mean"])
def test_profile_agrees_with_plain_python(spark, statistic):
    q, rows = _quotes(spark)
    w = sessions.walk_forward_windows(spark, date(2015, 1, 1), date(2017, 12, 1))
    cfg = Liquidity(statistic=statistic)
    got = {(r["window"], r["instrument"]): r for r in universe.liquidity_profile(q, w, cfg).collect()}
    want = 0
    for x in w.collect():
        inside = sorted((r for r in rows if x["train_start"] <= r[0] < x["train_end"]), key=lambda r: r[:2])
        every = {r[0] for r in inside}
        for name in {r[1] for r in inside}:
            mine, g = [r for r in inside if r[1] == name], got[x["window"], name]
            traded = [r[0] for r in mine if r[2] and r[2] > 0]
            want += 1
            assert g["liquidity"] == pytest.approx((median if statistic == "median" else mean)(r[2] for r in mine if r[2] is not None), rel=1e-12)
            assert g["median_trades"] == median(r[3] for r in mine if r[3] is not None)
            assert (g["sessions"], g["window_sessions"], g["zero_volume_days"]) == (len(mine), len(every), sum(r[2] == 0 for r in mine))
            assert (g["issuer"], g["kind"], g["name"]) == ("PETR" if mine[0][4] else None, mine[0][5], mine[0][6])
            assert g["formation_date"] == max(every) and g["traded_on_final"] == (max(traded) == max(every))
    assert len(got) == want > 0


def test_quotes_are_dealt_out_once_not_per_window(spark, capsys):
    q, _ = _quotes(spark)
    universe.liquidity_profile(q, sessions.walk_forward_windows(spark, date(2015, 1, 1), date(2017, 12, 1)), Liquidity()).explain()
    plan = capsys.readouterr().out
    assert plan.count("hashpartitioning(instrument") == 1
    assert "instrument" not in "".join(x for x in plan.splitlines() if "hashpartitioning(window" in x)
