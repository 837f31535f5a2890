"""Known answers, invariants and brute-force comparisons on small fixtures."""

import math
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from leadwake.config import Liquidity, Metrics
from leadwake.functions.scalars import event_token, instrument_kind, issuer_of, normal_two_sided
from leadwake.operators import (agreement, discovery, inference, placebo, positions, ranking, regression, returns, sampling,
                                sectors, sessions, succession, universe)


def days(n, start=date(2020, 1, 1)):
    return [start + timedelta(days=i) for i in range(n)]


def test_hac_golden_case(spark):
    rows = []
    for t in range(40):
        x = .02 * math.sin(1.3 * t) + .01 * math.cos(.7 * t * t)
        rows.append(("a", days(40)[t], t, x, .001 + .5 * x + .01 * math.cos(2.1 * t) + .004 * math.sin(.3 * t)))
    df = spark.createDataFrame(rows, "k string, date date, pos int, x double, y double")
    r = regression.least_squares(df, ["k"], "HAC", 5).first()
    assert r["alpha"] == pytest.approx(0.0011816365, abs=1e-9) and r["beta"] == pytest.approx(0.6043964131, abs=1e-9)
    assert r["std_error"] == pytest.approx(0.0650389663, abs=1e-9) and r["alpha_se"] == pytest.approx(0.0009524518, abs=1e-9)
    assert r["r2"] == pytest.approx(0.5395673, abs=1e-6)
    m = regression.mean_hac(df, ["k"], "y", 5).first()
    assert m["mean"] == pytest.approx(0.0021046137, abs=1e-9) and m["t"] == pytest.approx(1.5168291, abs=1e-6)


def test_normal_tail_matches_erfc(spark):
    zs = [0.0, 0.3, -1.0, 1.96, 3.5, -6.9, 7.2, 12.0, 30.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select("z", normal_two_sided(F.col("z")).alias("p")).collect()
    for r in got:
        assert r["p"] == pytest.approx(math.erfc(abs(r["z"]) / math.sqrt(2)), rel=1e-9)


def test_benjamini_hochberg_published_example(spark):
    p = [0.0001, 0.0004, 0.0019, 0.0095, 0.0201, 0.0278, 0.0298, 0.0344, 0.0459, 0.3240, 0.4262, 0.5719, 0.6528, 0.7590, 1.0]
    df = spark.createDataFrame([("w", f"{i:02d}", v) for i, v in enumerate(p)] + [("w", "nn", None)], "window string, leader string, p_value double")
    out = discovery.benjamini_hochberg(df, ["window"], "p_value", 0.05, ["leader"])
    assert out.filter("approved").count() == 4
    assert out.filter("leader = 'nn' and p_adjusted is null and not approved").count() == 1


def test_running_counts_ignore_partitioning(spark):
    rows = [("g" if i % 3 else "hot", i % 7, f"n{i:04d}", i % 2 == 0) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, v int, n string, f boolean")
    want = {}
    for key in ("g", "hot"):
        k = 0
        for r in sorted([r for r in rows if r[0] == key], key=lambda r: (-r[1], r[2])):
            if r[3]:
                k += 1
                want[r[2]] = k
    for parts in (2, 7):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        got = ranking.running_counts(df.repartition(parts), ["g"], [F.col("v").desc(), F.col("n").asc()], {"pos": F.col("f")})
        assert {r["n"]: r["pos"] for r in got.filter("pos is not null").collect()} == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_gaps_stay_gaps(spark):
    rows = [("A", date(2020, 1, d), p, 10.0, 5, "ON      NM") for d, p in ((1, 10.0), (2, 11.0), (4, 22.0))]
    q = spark.createDataFrame(rows, "instrument string, date date, close double, volume double, trades long, spec string")
    cal = spark.createDataFrame([(date(2020, 1, d), d - 1) for d in range(1, 5)], "date date, pos int")
    p = returns.panel(q, cal)
    assert [r["ret"] for r in returns.simple_returns(p).orderBy("pos").collect()] == [None, pytest.approx(0.1), None]
    assert [r["ret"] for r in returns.marked_returns(p).orderBy("pos").collect()] == [None, pytest.approx(0.1), pytest.approx(1.0)]
    dense = returns.fill_sessions(returns.marked_returns(p).select("instrument", "pos", "ret"), 3, ("ret",)).orderBy("pos").collect()
    assert [r["ret"] for r in dense] == [None, pytest.approx(0.1), 0.0, pytest.approx(1.0)]


def test_tokens(spark):
    df = spark.createDataFrame([("ON      NM", "BRPETRACNOR9"), ("ON  ED  NM", "curto"), ("UNT *C N2", None), ("SML)", " brvaleacnor0 ")], "s string, i string")
    got = df.select(event_token(F.col("s")), instrument_kind(F.col("s")), issuer_of(F.col("i"))).collect()
    assert [tuple(r) for r in got] == [("", "ON", "PETR"), ("ED", "ON", None), ("*C", "UNT", None), ("", "SML", "VALE")]


def _quotes(spark, change_from=None):
    rows = []
    for i in range(6):
        for k, d in enumerate(days(900, date(2015, 1, 1))):
            volume = 1e9 / (i + 1)
            if change_from and d >= change_from:
                volume = 1e9 * (i + 1) ** 3
            rows.append((d, f"T{i:02d}", volume, 1000, 10.0 + (k * (i + 1)) % 7, f"BRT{i:02d}AACNOR"[:12].ljust(12, "0"), "ON", f"EMPRESA {i}"))
    return spark.createDataFrame(rows, "date date, instrument string, volume double, trades long, close double, isin string, kind string, name string")


def test_universe_ignores_the_future(spark):
    w = sessions.walk_forward_windows(spark, date(2015, 1, 1), date(2017, 5, 1))
    cfg = Liquidity(bands=(2, 4), min_sessions=10)
    first = w.filter("window_id = 0")
    end = first.first()["train_end"]
    cols = ["window", "instrument", "liquidity", "final_position", "reason", "band"]
    a = universe.select_universe(_quotes(spark), first, cfg).select(*cols)
    b = universe.select_universe(_quotes(spark, end), first, cfg).select(*cols)
    assert a.count() == 6 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert [r["instrument"] for r in a.orderBy("final_position").collect()] == [f"T{i:02d}" for i in range(6)]


def test_window_generation_clips_days(spark):
    w = sessions.walk_forward_windows(spark, date(2015, 1, 31), date(2017, 8, 1)).orderBy("window_id").collect()
    assert w[0]["train_end"] == date(2017, 1, 31) and w[0]["test_end"] == date(2017, 4, 30) and w[1]["train_start"] == date(2015, 4, 30)


def test_overlapping_cohorts_hold_k_sessions(spark):
    cal = spark.createDataFrame([(d, i) for i, d in enumerate(days(10))], "date date, pos int")
    c = spark.createDataFrame([("fdr", "long_short", "w", 2, "A", 0.09), ("fdr", "long_short", "w", 3, "A", 0.09)],
                              "rule string, mode string, window string, pos int, instrument string, weight double")
    got = {r["pos"]: r["weight"] for r in positions.overlapping_positions(c, cal).collect()}
    assert got == {3: pytest.approx(.03), 4: pytest.approx(.06), 5: pytest.approx(.06), 6: pytest.approx(.03)}


def test_bootstrap_block_must_exceed_holding(spark):
    df = spark.createDataFrame([("a", i, 0.01) for i in range(40)], "k string, pos int, v double")
    with pytest.raises(ValueError):
        inference.block_bootstrap(df, ["k"], "v", 1, Metrics(bootstrap_block=3), holding=3)
    r = inference.block_bootstrap(df, ["k"], "v", 1, Metrics(bootstrap_block=10, bootstrap_replicates=50)).first()
    assert r["ci_low"] == pytest.approx(0.01) and r["ci_high"] == pytest.approx(0.01) and r["replicates"] == 50


def test_shuffle_keeps_groups_and_never_pairs_itself(spark):
    rows = [("w", "s", "u", f"A{i}", f"A{j}", f"E{i}", f"E{j}") for i in range(4) for j in range(i + 1, 4)] + [("w", "s", "alone", "B0", "B1", "F0", "F1")]
    p = spark.createDataFrame(rows, "window string, sector string, subsector string, leader string, follower string, leader_issuer string, follower_issuer string")
    out = placebo.shuffled_pairs(p, 20, 7).collect()
    assert len(out) == 20 * len(rows) and all(r["leader"] != r["follower"] for r in out)
    assert all(r["follower"] == "B1" for r in out if r["leader"] == "B0")
    again = placebo.shuffled_pairs(p.repartition(5), 20, 7).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))


def test_lineages_close_long_chains(spark):
    e = [(f"n{i:03d}", f"n{i+1:03d}") for i in range(30)] + [("z1", "z2")]
    got = {r["node"]: r["label"] for r in succession.lineages(spark.createDataFrame(e, "old string, new string")).collect()}
    assert got["n030"] == "n000" and got["z2"] == "z1" and len(got) == 33


def test_terminal_stops_at_forks(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("x", "z"), ("p", "q"), ("q", "p")], "old string, new string")
    s = spark.createDataFrame([("a",), ("x",), ("p",), ("c",)], "instrument string")
    assert {r["instrument"]: r["terminal"] for r in succession.terminal_of_chain(e, s).collect()} == {"a": "c", "x": None, "p": "q", "c": None}


def test_sector_gaps(spark):
    t = spark.createDataFrame([("A", "confirmado", "2016-01-01", "2016-12-31"), ("A", "confirmado", "2018-01-01", ""), ("B", "pendente", "", "")],
                              "instrument string, review_status string, valid_from string, valid_to string")
    n = spark.createDataFrame([(k, date(2015, 1, 1), date(2019, 1, 1)) for k in "ABC"], "instrument string, start date, end date")
    got = sorted((r["instrument"], str(r["start"]), str(r["end"]), r["status"]) for r in sectors.coverage_gaps(t, n).collect())
    assert got == [("A", "2015-01-01", "2015-12-31", "lacuna_temporal"), ("A", "2017-01-01", "2017-12-31", "lacuna_temporal"),
                   ("B", "2015-01-01", "2019-01-01", "sem_confirmacao"), ("C", "2015-01-01", "2019-01-01", "sem_linha")]


def test_blind_sample_equals_brute_force(spark):
    rows = [(i, f"E{i * 7 % 5 if i % 3 else 0}", 2010 + i * 5 % 4, ("positiva", "negativa", "neutra")[i * 11 % 3], i * 11 % 3 != 2 or i % 2 == 0) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, issuer string, year int, direction string, specific boolean")
    got = {r["doc_id"] for r in sampling.blind_sample(df, 12, 3).collect()}
    full = df.withColumns({"tier": ((F.col("direction") == "neutra") & ~F.col("specific")).cast("int"),
                           "tie": sampling.hash_key(3, "desempate", F.col("doc_id")), "stratum": sampling.hash_key(3, "estrato", F.col("direction"))}).collect()
    assert got == {r.doc_id for r in sampling.choose(full, 12)} and len(got) == 12


def test_hidden_columns():
    assert sampling.hidden("Direção") and sampling.hidden("preco_futuro") and sampling.hidden("ia_x") and not sampling.hidden("texto")


def test_kappa_of_perfect_agreement(spark):
    df = spark.createDataFrame([(1, "nao_especifico", "nao_especifico"), (2, "especifico_neutra", "especifico_neutra")], "doc_id int, class_a string, class_b string")
    assert agreement.cohen_kappa(df).first()["kappa"] == pytest.approx(1.0)
    one = spark.createDataFrame([(1, "nao_especifico", "nao_especifico")], "doc_id int, class_a string, class_b string")
    assert agreement.cohen_kappa(one).first()["kappa"] is None


def test_one_sided_ids_raise_whatever_is_read(spark):
    a = spark.createDataFrame([(1, True, "positiva"), (3, False, "neutra")], "doc_id long, specific boolean, direction string")
    b = spark.createDataFrame([(1, True, "positiva"), (9, False, "neutra")], a.schema)
    from leadwake.operators.agreement import align_raters, cohen_kappa
    with pytest.raises(Exception, match="one rater only"):
        cohen_kappa(align_raters(a, b)).collect()
    with pytest.raises(Exception, match="one rater only"):
        align_raters(a, b).agg(F.count("*")).collect()


def test_two_issuers_on_a_leader_day_raise_whatever_is_read(spark):
    from leadwake.operators.events import leader_day_signals
    rows = [("w", "L", "2020-01-02", "I1", "positiva"), ("w", "L", "2020-01-02", "I2", "positiva")]
    df = spark.createDataFrame(rows, "window string, leader string, session string, issuer string, classification string")
    with pytest.raises(Exception, match="issuer must be unique"):
        leader_day_signals(df).select("leader", "signal").collect()


def test_student_tail_known_values(spark):
    from leadwake.functions.scalars import student_two_sided
    def tail(t, v, steps=200_000):  # the density summed by Simpson's rule from 0 to t
        c = math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(v * math.pi)
        f = lambda x: c * (1 + x * x / v) ** (-(v + 1) / 2)
        h = t / steps
        return 1 - 2 * h / 3 * (f(0) + f(t) + sum((4 if k % 2 else 2) * f(k * h) for k in range(1, steps)))

    rows = [(t, v, tail(t, v)) for t, v in ((0.2304, 10), (2.228138852, 10), (12.7062047, 1), (2.0, 3), (2.009575, 50), (1.0, 2))]
    df = spark.createDataFrame(rows, "t double, df long, p double").withColumn("got", student_two_sided(F.col("t"), F.col("df")))
    assert all(abs(r.got - r.p) < 1e-9 for r in df.collect()) and abs(rows[1][2] - 0.05) < 1e-6


def test_sample_choice_is_the_greedy_one():
    import random
    from types import SimpleNamespace
    from leadwake.operators.sampling import DIRECTIONS, choose, quotas
    rng = random.Random(4)
    rows = [SimpleNamespace(doc_id=i, direction=rng.choice(DIRECTIONS), tier=rng.randint(0, 1), year=rng.randint(2000, 2005),
                            issuer=f"I{rng.randint(0, 12)}", tie=f"{rng.randint(0, 40):03d}", stratum="s") for i in range(200)]
    rows = [SimpleNamespace(**{**vars(r), "stratum": {"positiva": "b", "negativa": "a", "neutra": "c"}[r.direction]}) for r in rows]
    years, issuers, want = set(), set(), []
    for d in ("negativa", "positiva", "neutra"):
        left = [r for r in rows if r.direction == d]
        for _ in range(quotas(31)[d]):
            best = min(left, key=lambda r: (-r.tier, -((r.year not in years) + (r.issuer not in issuers)), r.tie, -r.doc_id))
            left.remove(best)
            want.append(best.doc_id)
            years.add(best.year)
            issuers.add(best.issuer)
    assert [r.doc_id for r in choose(rows, 31)] == want


def test_liquidity_has_every_session_in_reach(spark):
    calendar = spark.createDataFrame([(k, date(2020, 1, 1) + timedelta(k)) for k in range(9)], "pos int, date date")
    panel = spark.createDataFrame([("a", 0, 5.0), ("a", 2, 0.0), ("a", 7, 7.0)], "instrument string, pos int, volume double")
    got = {r.pos: r.traded_share for r in returns.traded_share(returns.volumes_in_reach(panel, calendar, 3), 3).filter("traded_share is not null").collect()}
    assert got == {0: 1.0, 1: 1.0, 2: 0.5, 3: 0.0, 4: 0.0, 7: 1.0, 8: 1.0}


def test_queries_run_the_configured_replicates():
    from leadwake.config import DEFAULTS
    from leadwake.plans.bindings import MONTHLY
    assert MONTHLY.placebo.replicates == DEFAULTS.placebo.replicates == 500
    assert MONTHLY.metrics.bootstrap_replicates == DEFAULTS.metrics.bootstrap_replicates == 10_000


def test_near_duplicates_against_all_pairs(spark):
    """Near copies among all series, with missing days, late starts, constant and short series, in blocks of every size."""
    import numpy as np
    from leadwake.operators import crosscheck

    rng = np.random.default_rng(4)
    rows, series = [], {}
    for k in range(40):
        start = int(rng.integers(0, 150))
        base = rng.standard_normal(200)
        base[:start] = np.nan
        series[f"A{k:02d}"] = base
        copy = base * rng.uniform(.2, 3) + rng.standard_normal(200) * rng.choice([0, .01, .03, .06])
        copy[rng.random(200) < rng.choice([0, .3])] = np.nan
        series[f"B{k:02d}"] = copy
    series["flat"] = np.zeros(200)
    series["mirror"] = -series["A00"]
    for name, v in series.items():
        rows += [(name, int(p), None if np.isnan(x) else float(x)) for p, x in enumerate(v)]
    df = spark.createDataFrame(rows, "instrument string, pos int, ret double")
    want = {}
    names = sorted(series)
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            both = ~np.isnan(series[a]) & ~np.isnan(series[b])
            if both.sum() >= 60 and series[a][both].std() > 0 and series[b][both].std() > 0:
                c = np.corrcoef(series[a][both], series[b][both])[0, 1]
                if c >= .999:
                    want[a, b] = (int(both.sum()), round(c, 9))
    assert 5 < len(want) < 35
    for block in (3, 17, 256):
        got = {(r.instrument_a, r.instrument_b): (r.overlap, round(r.correlation, 9)) for r in crosscheck.near_duplicates(df, block=block).collect()}
        assert got == want
    assert crosscheck.near_duplicates(df.limit(0)).count() == 0


def test_networks_of_lengths_against_direct_regression(spark):
    """Gaps, months without rows, daily rows and several overlapping lengths, against the window-by-window regression."""
    import datetime as dt
    import random
    from pyspark.sql import functions as F
    from leadwake.config import LeadLag, WalkForward
    from leadwake.operators import regression, rolling_network, sessions

    rng = random.Random(8)
    days = [dt.date(2000, 1, 3) + dt.timedelta(days=3 * k) for k in range(480)]
    rows = [(i, d, p, None if rng.random() < .1 else rng.gauss(.001, .02)) for i in ("A", "B", "C") for p, d in enumerate(days)
            if not (i == "C" and d.year == 2001 and d.month in (5, 6, 7)) and rng.random() > .05]
    r = spark.createDataFrame(rows, "instrument string, date date, pos int, ret double")
    windows = None
    for m in (3, 12, 24):
        w = sessions.walk_forward_windows(spark, dt.date(2000, 1, 1), dt.date(2003, 12, 31), WalkForward(m, 3), m).withColumn("window", F.concat(F.lit(f"{m}|"), "window"))
        windows = w if windows is None else windows.unionByName(w)
    pairs = windows.select("window", F.explode(F.expr("array(struct('A' AS leader, 'B' AS follower), struct('B' AS leader, 'C' AS follower), struct('C' AS leader, 'X' AS follower))")).alias("p")).select("window", "p.*")
    full = pairs.withColumns({c: F.lit(None).cast("string") for c in ("sector", "subsector")} | {c: F.lit(1) for c in ("min_band", "leader_position", "follower_position")})
    cfg = LeadLag(lag=2, hac_lags=5, min_observations=20)
    want = {(x.window, x.leader, x.follower): x for x in regression.estimate_network(r, full, windows, cfg).collect()}
    got = {(x.window, x.leader, x.follower): x for x in rolling_network.network_of_lengths(r, pairs, windows, 2, 5, 20).collect()}
    assert set(want) == set(got) and sum(x.beta is not None for x in want.values()) > 30
    for k, x in want.items():
        assert got[k].n == x.n
        for c in ("beta", "alpha", "r2", "std_error", "t_stat", "p_value"):
            assert got[k][c] == pytest.approx(x[c], rel=1e-7, abs=1e-10) if x[c] is not None else got[k][c] is None, (k, c)
    with pytest.raises(Exception, match="begin and end with a month"):
        rolling_network.network_of_lengths(r, pairs, windows.withColumn("train_start", F.date_add("train_start", 1)), 2, 5, 20).collect()
