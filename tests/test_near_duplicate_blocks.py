"""Blocks of the search for near copies: how often a series is sent, and results in blocks of several products."""

import numpy as np

from leadwake.operators import crosscheck


def test_a_series_is_sent_no_more_often_when_there_are_more_of_them():
    sends = [-(-n // crosscheck.block_size(n, 84)) for n in (12_000, 120_000, 390_000)]
    assert max(sends) <= crosscheck.BLOCKS
    assert crosscheck.block_size(10**7, 10_000) * 10_000 <= crosscheck.VALUES_PER_BLOCK and crosscheck.block_size(10**7, 84) == crosscheck.SERIES_PER_BLOCK


def test_blocks_of_several_products(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = []
    for k in range(30):
        base = rng.standard_normal(80)
        for name, v in ((f"A{k:02d}", base), (f"B{k:02d}", 2 * base + 0.02 * (k % 5) * rng.standard_normal(80))):
            rows += [(name, p, float(x)) for p, x in enumerate(v) if (p + k) % 17]
    df = spark.createDataFrame(rows, "instrument string, pos int, ret double")
    want = {tuple(r) for r in crosscheck.near_duplicates(df, block=256).select("instrument_a", "instrument_b", "overlap").collect()}
    monkeypatch.setattr(crosscheck, "PRODUCT_ROWS", 7)
    monkeypatch.setattr(crosscheck, "BLOCKS", 3)
    got = {tuple(r) for r in crosscheck.near_duplicates(df).select("instrument_a", "instrument_b", "overlap").collect()}
    assert got == want and 10 < len(want) < 30
