"""Answers about code changes without a row per candidate, against the candidates themselves."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from leadwake.operators import succession

FIELDS = "instrument string, name string, first_date date, last_date date, first_price double, last_price double, first_volume double, last_volume double"


def codes(seed):
    """Crowded, sparse and copied codes, and codes exactly on the borders of rule B."""
    r, day, rows = random.Random(seed), lambda k: date(2020, 1, 1) + timedelta(days=k), []
    for k in range(120):
        a = r.randint(0, 40)
        rows.append((f"n{k % 50}", day(a), day(a + r.randint(0, 9)), *[r.uniform(90, 120) for _ in range(2)], *[r.uniform(50, 120) for _ in range(2)]))
    for k in range(250):
        a = r.randint(0, 600)
        rows.append((f"s{k % 120}", day(a), day(a + r.randint(0, 30)), *[10 ** r.uniform(1, 4) for _ in range(2)], *[10 ** r.uniform(1, 3) for _ in range(2)]))
    for k in range(12):
        a = 2000 + 200 * (k // 4)
        rows += [("", day(a), day(a), 10.0, 100.0, 1.0, 3.0), ("", day(a + (1, 15, 16, 15)[k % 4]), day(a + 40), (115.0, 85.0, 100.0, 115.1)[k % 4], 1.0, (9.0, 1.0, 3.0, 3.0)[k % 4], 1.0)] * (1 + 2 * (k // 4))
    rows += [("", day(3000), day(3001), 5.0, 0.0, 1.0, 1.0), ("", day(3002), day(3003), 5.0, 5.0, 0.0, float("nan")), ("", day(3003), day(3004), float("nan"), 5.0, 1.0, 1.0)]
    r.shuffle(rows)
    return [(f"C{k:04d}", *row) for k, row in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_answers_equal_those_of_all_candidates(spark, seed):
    ends = spark.createDataFrame(codes(seed), FIELDS).localCheckpoint()
    all_of_them = succession.change_candidates(ends).select("old", "new").localCheckpoint()
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(succession.linked_codes(ends)) == rows(all_of_them.select(F.explode(F.array("old", "new"))).distinct())
    assert rows(succession.change_lineages(ends)) == rows(succession.lineages(all_of_them))
    assert rows(succession.terminal_codes(ends)) == rows(succession.terminal_of_chain(all_of_them, all_of_them.select(F.col("old").alias("instrument"))))


def test_a_crowd_is_one_link_of_cells(spark):
    """2 000 codes before 2 000 others are four million candidates, one pair of cells and one class of equal points."""
    crowd = [(f"C{k:04d}", "", date(2020, 3, 1 + 10 * (k % 2)), date(2020, 3, 1 + 10 * (k % 2)), 100.0, 100.0, 5.0, 5.0) for k in range(4000)]
    ends = spark.createDataFrame(crowd, FIELDS)
    old, new = [succession._with_cell(s) for s in succession._sides(ends)]
    link = succession._sure_links(old, new).collect()
    assert [(r["old_n"], r["new_n"]) for r in link] == [(2000, 2000)]
    assert succession._box_join(succession._classes(old), succession._classes(new)).count() == 1
    assert {r["label"] for r in succession.change_lineages(ends).collect()} == {"C0000"}


def test_rule_b_and_its_review_equal_brute_force(spark):
    rows = codes(3)
    ends = spark.createDataFrame([(*r, 5, 1.0, 2.0) for r in rows], FIELDS + ", records long, first_trades double, last_trades double").localCheckpoint()
    a = {(r["old"], r["new"]) for r in succession.same_name_changes(ends).collect()}
    want = {(o[0], n[0]) for o in rows for n in rows
            if 1 <= (n[2] - o[3]).days <= 15 and min(o[4], o[5], n[4], n[5], o[7], n[6]) > 0 and abs(n[4] / o[5] - 1) <= 0.15 and 1 / 3.0 <= n[6] / o[7] <= 3} - a
    got = [(r["old"], r["new"]) for r in succession.continuous_changes(ends, succession.same_name_changes(ends)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    best = spark.createDataFrame([(r[0], 100 + k % 30, "w", 1) for k, r in enumerate(rows) if k % 3], "instrument string, best_position int, best_window string, windows_eligible int")
    place = {r[0]: 100 + k % 30 for k, r in enumerate(rows) if k % 3}
    calendar = spark.createDataFrame([(date(2020, 1, 1) + timedelta(days=k), k) for k in range(4000)], "date date, pos int")
    review = {(r["old"], r["new"]): (r["criterion"], r["gap_sessions"]) for r in succession.review_table(ends, best, calendar).collect()}
    day = {r[0]: (r[2], r[3]) for r in rows}
    low = {p: min(place.get(p[0], 10**9), place.get(p[1], 10**9)) for p in want | a}
    assert review == {(o, n): ("top100+ponta_curta" if low[o, n] <= 100 else "top120+ponta_curta", (day[n][0] - day[o][1]).days) for o, n in low if low[o, n] <= 120}


def test_upsert_beside_equals_the_join(spark):
    ends = spark.createDataFrame(codes(4), FIELDS).localCheckpoint()
    pairs = succession.continuous_changes(ends, succession.same_name_changes(ends)).localCheckpoint()
    assert pairs.filter(succession.rule_b_hash() != succession.diagnostic_hash(["gap_days", "confidence"])).count() == 0
    rows = pairs.select("old", "new", succession.rule_b_hash().alias("fresh_hash"),
                        F.when(F.col("gap_days") < 10, "antigo").otherwise(succession.rule_b_hash()).alias("stored_hash"),
                        F.when(F.col("gap_days") % 2 == 0, "aprovada").otherwise("").alias("decision"))
    joined = succession.mapping_upsert(rows.withColumnRenamed("fresh_hash", "diagnostic_hash"), rows.withColumnRenamed("stored_hash", "diagnostic_hash"),
                                       ("decision",), {"decision": ""})
    found = succession.upsert_beside(rows, ("decision",), {"decision": ""})
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, joined.collect())) and rows.count()


@pytest.mark.parametrize("name", ["dq_08_continuous_changes", "dq_09_review_table", "lin_02_mapping_upsert"])
def test_no_pair_is_shuffled_or_written_out_as_dates(spark, name):
    """No exchange, sort or date formatting stands above the join of rule B."""
    plan = entry.queries()[name](spark, entry.SMALL)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = {k: len(line) - len(line.lstrip(" :+-")) for k, line in enumerate(plan)}
    join = next(k for k, line in enumerate(plan) if "Join Inner" in line and "abs((" in line)
    above = [plan[k] for k in range(join) if depth[k] < depth[join] and all(depth[j] > depth[k] for j in range(k + 1, join + 1))]
    assert above and not any(w in line for line in above for w in ("Join", "Aggregate", "Window", "Sort", "Repartition", "as date) as string", "cast(date_from_unix", "concat_ws", "sha2"))
