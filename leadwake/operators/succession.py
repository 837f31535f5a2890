"""Code changes: candidates, chains of successors, lineages."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from leadwake.session import materialize


def series_ends(quotes: DataFrame, records: int = 60) -> DataFrame:
    """Per instrument: span, name, first and last price, median volume of its first and last records."""
    up, down = W.partitionBy("instrument").orderBy("date"), W.partitionBy("instrument").orderBy(F.col("date").desc())
    r = quotes.withColumns({"k0": F.row_number().over(up), "k1": F.row_number().over(down)})
    head, tail = F.col("k0") <= records, F.col("k1") <= records
    return r.groupBy("instrument").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.min_by("name", "date").alias("name"),
        F.min_by("close", "date").alias("first_price"), F.max_by("close", "date").alias("last_price"),
        F.median(F.when(head, F.col("volume"))).alias("first_volume"), F.median(F.when(tail, F.col("volume"))).alias("last_volume"),
        F.median(F.when(head, F.col("trades"))).alias("first_trades"), F.median(F.when(tail, F.col("trades"))).alias("last_trades"),
        F.count(F.lit(1)).alias("records"))


def same_name_changes(ends: DataFrame, slack: int = 15) -> DataFrame:
    """Rule A: consecutive codes of one name, no overlap, gap of at most three slacks.

    A name carries a handful of codes; the window is ordered inside a name.
    """
    nxt = W.partitionBy("name").orderBy("first_date", "instrument")
    e = ends.filter("name is not null and name <> ''").withColumns({
        "new": F.lead("instrument").over(nxt), "new_start": F.lead("first_date").over(nxt), "new_price": F.lead("first_price").over(nxt)})
    gap = F.date_diff("new_start", "last_date")
    return (e.filter((F.col("new_start") > F.col("last_date")) & (gap <= slack * 3))
            .select(F.col("instrument").alias("old"), "new", F.col("name").alias("old_name"), F.col("name").alias("new_name"),
                    F.col("last_date").alias("old_end"), "new_start", gap.alias("gap_days"), F.col("last_price").alias("old_price"), "new_price",
                    F.lit("alta").alias("confidence"), F.lit("mesmo nome resumido").alias("method")))


# What decides a link of rule B, on either side.
POINT = ["day", "price", "volume"]


def _cell(value: Column, width: float) -> Column:
    return F.floor(F.log(value) / F.lit(width)).cast("long")


def _sides(ends: DataFrame, *keep: str) -> tuple[DataFrame, DataFrame]:
    """Rule B's points: code, day, price and volume of every end that may have a successor and of every start that may be one."""
    live = ends.filter("last_price > 0 and first_price > 0")
    finite = " and ".join(f"{c} > 0 and {c} < double('infinity')" for c in ("price", "volume"))
    return tuple(live.select(F.col("instrument").alias("code"), F.unix_date(f"{w}_date").alias("day"), F.col(f"{w}_price").alias("price"),
                             F.col(f"{w}_volume").alias("volume"), *keep).filter(finite) for w in ("last", "first"))


def _box_join(old: DataFrame, new: DataFrame, slack: int = 15, max_jump: float = 0.15, volume_factor: float = 3.0,
              spread: str = "old") -> DataFrame:
    """Pairs of rule B, all columns of both sides with the prefixes ``old_`` and ``new_``.

    Rule B is a box of days, prices and volumes.  Cells are as wide as the box in volumes, half as wide in prices and a third in
    days, so the side named by ``spread`` is repeated over the cells that its box meets (two, three and four at most), and an
    equality join finds the rest.  Codes crowd around the turn of the year, and every code is compared with all others of its
    cells, so wider cells would be read from main memory again for each code.  The exact tests follow; the box is a little wider
    than they are.  No pair is shuffled.
    """
    edge = 1e-9
    down, up, factor = (1 - max_jump) * (1 - edge), (1 + max_jump) * (1 + edge), volume_factor * (1 + edge)
    across = (max(1, slack // 3), math.log(up / down) / 2, 2 * math.log(factor))
    if spread == "old":
        day, price, volume = (1, slack), (down, up), (1 / factor, factor)
    else:
        day, price, volume = (-slack, -1), (1 / up, 1 / down), (1 / factor, factor)
    day_cell = lambda shift: F.floor((F.col("day") + shift) / across[0]).cast("long")
    wide = {"__d": F.sequence(day_cell(day[0]), day_cell(day[1])),
            "__p": F.sequence(*[_cell(F.col("price") * k, across[1]) for k in price]), "__v": F.sequence(*[_cell(F.col("volume") * k, across[2]) for k in volume])}
    one = {"__d": day_cell(0), "__p": _cell(F.col("price"), across[1]), "__v": _cell(F.col("volume"), across[2])}

    def placed(side: DataFrame, name: str, *more: Column) -> DataFrame:
        out = side
        for k in one:
            out = out.withColumn(k, F.explode(wide[k]) if name == spread else one[k])
        return out.select(*one, *more, *[F.col(c).alias(f"{name}_{c}") for c in side.columns])

    # The last day of a successor is found once per code, so candidates need no checked difference of days.
    ratio = F.col("new_volume") / F.col("old_volume")
    return (placed(old, "old", (F.col("day") + slack).alias("__until")).join(placed(new, "new"), list(one))
            .filter((F.col("new_day") > F.col("old_day")) & (F.col("new_day") <= F.col("__until")))
            .filter((ratio >= 1 / volume_factor) & (ratio <= volume_factor))
            .filter(F.abs(F.col("new_price") / F.col("old_price") - 1) <= max_jump).drop(*one, "__until"))


def continuous_changes(ends: DataFrame, same_name: DataFrame, slack: int = 15, max_jump: float = 0.15,
                       volume_factor: float = 3.0, keep: tuple[str, ...] = (), either: str | None = None) -> DataFrame:
    """Rule B: another name, starting within ``slack`` days, with continuous price and volume.

    Columns of ``ends`` named in ``keep`` come along for both codes, and rule A's successors with the old code, so no pair is
    shuffled after it was found.  With ``either``, one of them, only pairs with that flag on one side at least are formed.
    """
    known = same_name.groupBy(F.col("old").alias("code")).agg(F.collect_set("new").alias("same"))
    old, new = _sides(ends, "name", *keep)
    old = old.join(known, "code", "left")

    def pairs(o: DataFrame, n: DataFrame, spread: str) -> DataFrame:
        return (_box_join(o, n, slack, max_jump, volume_factor, spread)
                .filter(~F.coalesce(F.array_contains("old_same", F.col("new_code")), F.lit(False))))

    if either is None:
        hit = pairs(old, new, "old")
    else:
        hit = pairs(old.filter(either), new, "old").unionByName(pairs(old.filter(f"not {either}"), new.filter(either), "new"))
    end, start = F.date_from_unix_date("old_day"), F.date_from_unix_date("new_day")
    return hit.select(F.col("old_code").alias("old"), F.col("new_code").alias("new"), "old_name", "new_name", end.alias("old_end"),
                      start.alias("new_start"), F.date_diff(start, end).alias("gap_days"), "old_price", "new_price",
                      F.lit("media").alias("confidence"), F.lit("series adjacentes com preco continuo, nomes diferentes").alias("method"),
                      *[f"{side}_{k}" for side in ("old", "new") for k in keep])


def _with_cell(side: DataFrame, slack: int = 15, max_jump: float = 0.15, volume_factor: float = 3.0) -> DataFrame:
    """Adds the fine cell of a point.  See ``_sure_links``."""
    block, shrink = max(1, (slack + 1) // 3), 0.5 * (1 - 1e-9)
    return side.withColumn("cell", F.struct(F.floor(F.col("day") / block).cast("long").alias("d"), _cell(F.col("price"), math.log(1 + max_jump) * shrink).alias("p"),
                                            _cell(F.col("volume"), math.log(volume_factor) * shrink).alias("v")))


def _sure_links(old: DataFrame, new: DataFrame, slack: int = 15) -> DataFrame:
    """Pairs of fine cells of which every old code links with every new one: old_cell, new_cell, their smallest codes and sizes.

    A cell is a third of the days wide and half of the way up in price and in volume, so the cells one and two blocks of days
    ahead, at most one beside in price and in volume, lie in the box of each of its points.  Their number is bounded by calendar
    and prices, whatever the number of codes.  Pairs in other cells are left to the exact join.
    """
    ahead = (slack + 1) // max(1, (slack + 1) // 3) - 1

    def cells(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy(F.col("cell").alias(f"{name}_cell")).agg(F.min("code").alias(f"{name}_code"), F.count(F.lit(1)).alias(f"{name}_n"))

    o = cells(old, "old")
    for axis, steps in (("d", range(1, ahead + 1)), ("p", (-1, 0, 1)), ("v", (-1, 0, 1))):
        o = o.withColumn(axis, F.explode(F.array(*[F.col(f"old_cell.{axis}") + F.lit(k) for k in steps])))
    return o.withColumn("new_cell", F.struct("d", "p", "v")).drop("d", "p", "v").join(cells(new, "new"), "new_cell")


def _classes(side: DataFrame, *aggregates: Column) -> DataFrame:
    """Codes whose points are equal have the same links; one row stands for them."""
    return side.groupBy(*POINT).agg(*aggregates) if aggregates else side.select(*POINT).distinct()


def _members(side: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """Rows of ``side`` whose class has a link."""
    return side.join(links.select(*[F.col(f"{name}_{c}").alias(c) for c in POINT]).distinct(), POINT, "left_semi")


def linked_codes(ends: DataFrame) -> DataFrame:
    """Codes that are the old or the new one of any candidate, without a row per candidate."""
    ends = materialize(ends)
    old, new = [_with_cell(s) for s in _sides(ends)]
    sure = materialize(_sure_links(old, new))
    found = [same_name_changes(ends).select(F.explode(F.array("old", "new")).alias("code"))]
    for side, name, other in ((old, "old", new), (new, "new", old)):
        settled = sure.select(F.col(f"{name}_cell").alias("cell")).distinct()
        found.append(side.join(settled, "cell", "left_semi").select("code"))
        rest, points = _classes(side.join(settled, "cell", "left_anti")), _classes(other)
        links = _box_join(rest, points) if name == "old" else _box_join(points, rest, spread="new")
        found.append(_members(side, links, name).select("code"))
    return reduce(DataFrame.unionByName, found).distinct().withColumnRenamed("code", "instrument")


def change_lineages(ends: DataFrame) -> DataFrame:
    """``lineages`` of all candidates, without a row per candidate.

    First come edges that need no pair of codes: rule A, sure links between cells, and each code with the smallest of its cell.
    What is still apart is then linked exactly, one row per class of equal points; classes that lie in one component already, and
    the largest component with itself, are not compared.
    """
    ends = materialize(ends)
    old, new = [_with_cell(s) for s in _sides(ends)]
    sure = materialize(_sure_links(old, new))
    edges = [same_name_changes(ends).select("old", "new"), sure.select(F.col("old_code").alias("old"), F.col("new_code").alias("new"))]
    for side, name in ((old, "old"), (new, "new")):
        hubs = sure.select(F.col(f"{name}_cell").alias("cell"), F.col(f"{name}_code").alias("new")).distinct()
        edges.append(side.join(hubs, "cell").select(F.col("code").alias("old"), "new"))
    first = lineages(reduce(DataFrame.unionByName, edges))
    size = first.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    largest = F.coalesce(size.agg(F.max_by("label", F.struct("n", "label"))).scalar(), F.lit(""))
    labels = first.select(F.col("node").alias("code"), "label")
    old, new = [materialize(s.drop("cell").join(labels, "code", "left").withColumn("label", F.coalesce("label", "code"))) for s in (old, new)]
    o, n = [_classes(s, F.min("label").alias("least"), F.max("label").alias("most")).withColumn("main", (F.col("least") == largest) & (F.col("most") == largest))
            for s in (old, new)]
    links = (_box_join(o.filter("not main"), n).unionByName(_box_join(o.filter("main"), n.filter("not main"), spread="new"))
             .filter("least(old_least, new_least) <> greatest(old_most, new_most)"))
    links = materialize(links)
    joined = [links.select(F.col("old_least").alias("old"), F.col("new_least").alias("new"))]
    for side, name in ((old, "old"), (new, "new")):
        linked = links.select(*[F.col(f"{name}_{c}").alias(c) for c in POINT], F.col(f"{name}_least").alias("new")).distinct()
        joined.append(side.join(linked, POINT).select(F.col("label").alias("old"), "new"))
    second = lineages(reduce(DataFrame.unionByName, joined)).select(F.col("node").alias("label"), F.col("label").alias("final"))
    # A code that only the second step links is not in the first; its label there is its own name.
    every = first.unionByName(second.select(F.col("label").alias("node"), "label").join(first.select("node"), "node", "left_anti"))
    return every.join(second, "label", "left").select("node", F.coalesce("final", "label").alias("label"))


def terminal_codes(ends: DataFrame, max_hops: int = 5) -> DataFrame:
    """``terminal_of_chain`` from every code that has a candidate, without a row per candidate.

    A code with more than ``max_hops + 1`` successors is never left.  Sure links alone show that for most codes; the exact join
    is made for the others, by classes of equal points, and only classes with few successors get a row per pair of codes.
    """
    ends = materialize(ends)
    old, new = [_with_cell(s) for s in _sides(ends)]
    few = max_hops + 1
    crowded = _sure_links(old, new).groupBy(F.col("old_cell").alias("cell")).agg(F.sum("new_n").alias("n")).filter(F.col("n") > few).select("cell")
    crowded = materialize(crowded)
    rest = old.join(crowded, "cell", "left_anti")
    links = materialize(_box_join(_classes(rest), _classes(new, F.count(F.lit(1)).alias("n"))))
    per = links.groupBy(*[F.col(f"old_{c}").alias(c) for c in POINT]).agg(F.sum("new_n").alias("n"))
    wide = materialize(old.join(crowded, "cell", "left_semi").select("code").unionByName(
        rest.join(per.filter(F.col("n") > few), POINT, "left_semi").select("code")))
    narrow = links.join(per.filter(F.col("n") <= few).select(*[F.col(c).alias(f"old_{c}") for c in POINT]), [f"old_{c}" for c in POINT], "left_semi")
    # Rule A adds one successor at most; next to many of rule B it changes nothing.
    a = same_name_changes(ends).select("old", "new")
    edges = a.join(wide.select(F.col("code").alias("old")), "old", "left_anti")
    pairs = (narrow.join(old.select(F.col("code").alias("old"), *[F.col(c).alias(f"old_{c}") for c in POINT]), [f"old_{c}" for c in POINT])
             .join(new.select(F.col("code").alias("new"), *[F.col(c).alias(f"new_{c}") for c in POINT]), [f"new_{c}" for c in POINT]))
    edges = materialize(edges.unionByName(pairs.select("old", "new")).distinct())
    return terminal_of_chain(edges, wide.unionByName(edges.select(F.col("old").alias("code"))).withColumnRenamed("code", "instrument"), max_hops)


def change_candidates(ends: DataFrame) -> DataFrame:
    """Both rules over ``series_ends``."""
    a = same_name_changes(ends)
    return a.unionByName(continuous_changes(ends, a))


def review_table(ends: DataFrame, best: DataFrame, calendar: DataFrame, top: int = 100, margin: int = 120, short: int = 400) -> DataFrame:
    """Materially relevant candidates with both ends' context and blank decision columns.

    Context is attached to the codes.  Every criterion asks one side for a position up to the margin or the top, so only pairs
    with such a side are formed, and none is joined again afterwards.
    """
    b = best.select("instrument", "best_position", "best_window", "windows_eligible")
    d = calendar.select("date", "pos")
    e = (ends.join(b, "instrument", "left").withColumn("windows_eligible", F.coalesce("windows_eligible", F.lit(0)))
         .join(d.select(F.col("date").alias("first_date"), F.col("pos").alias("first_pos")), "first_date", "left")
         .join(d.select(F.col("date").alias("last_date"), F.col("pos").alias("last_pos")), "last_date", "left"))
    e = materialize(e.withColumn("relevant", F.coalesce(F.col("best_position") <= max(top, margin), F.lit(False))))
    context = {"sessions": "records", "position": "best_position", "window": "best_window", "windows": "windows_eligible"}
    ends_of = {"old": {**context, "volume": "last_volume", "trades": "last_trades", "pos": "last_pos"},
               "new": {**context, "volume": "first_volume", "trades": "first_trades", "pos": "first_pos"}}
    keep = tuple(sorted({c for side in ends_of.values() for c in side.values()} | {"relevant"}))
    a = same_name_changes(e)
    both = a
    for side in ("old", "new"):
        both = both.join(e.select(F.col("instrument").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in keep]), side)
    c = both.filter("old_relevant or new_relevant").unionByName(continuous_changes(e, a, keep=keep, either="relevant"))
    c = c.select(*a.columns, *[F.col(f"{side}_{source}").alias(f"{side}_{name}") for side, names in ends_of.items() for name, source in names.items()])
    best_of = F.least(F.coalesce("old_position", F.lit(10**9)), F.coalesce("new_position", F.lit(10**9)))
    stub = (((F.col("old_sessions") < short) & (F.col("new_position") <= margin))
            | ((F.col("new_sessions") < short) & (F.col("old_position") <= margin)))
    # One of few constants, chosen by comparisons; no text is put together per pair.
    crit = (F.when(stub, F.when(best_of <= top, f"top{top}+ponta_curta").when(best_of <= margin, f"top{margin}+ponta_curta").otherwise("ponta_curta"))
            .when(best_of <= top, f"top{top}").when(best_of <= margin, f"top{margin}").otherwise(""))
    out = c.withColumn("criterion", crit).filter("criterion <> ''").withColumns({
        "gap_sessions": F.col("new_pos") - F.col("old_pos"), "price_ratio": F.try_divide("new_price", "old_price")})
    blank = {k: F.lit("") for k in ("event_type", "conversion_ratio", "source", "confirmed_on", "reviewer", "decision", "notes")}
    return out.drop("old_pos", "new_pos").withColumns(blank)


def terminal_of_chain(edges: DataFrame, starts: DataFrame, max_hops: int = 5) -> DataFrame:
    """Last code of a chain of unique successors; stops at a fork, an end or a visited code.

    Only codes with at most max_hops+1 successors can ever narrow down to one, so wider forks
    are dropped before their successors are gathered.
    """
    e = edges.select("old", "new").distinct()
    narrow = e.groupBy("old").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= max_hops + 1)
    succ = e.join(narrow, "old", "left_semi").groupBy("old").agg(F.collect_set("new").alias("succ"))
    cur = starts.select(F.col("instrument")).distinct().withColumns({
        "at": F.col("instrument"), "seen": F.array("instrument"), "moving": F.lit(True)})
    for _ in range(max_hops):
        nxt = cur.join(succ, F.col("at") == F.col("old"), "left")
        left = F.array_except(F.coalesce("succ", F.array().cast("array<string>")), "seen")
        step = F.col("moving") & (F.size(left) == 1)
        cur = nxt.select("instrument", F.when(step, F.get(left, F.lit(0))).otherwise(F.col("at")).alias("at"),
                         F.when(step, F.array_union("seen", left)).otherwise(F.col("seen")).alias("seen"), step.alias("moving"))
    return cur.select("instrument", F.when(F.col("at") != F.col("instrument"), F.col("at")).alias("terminal"))


def lineages(edges: DataFrame) -> DataFrame:
    """Connected components labelled by the smallest code.

    Each round takes the least label among neighbours and then jumps to that label's own label,
    so long chains close in a logarithmic number of rounds.  Rounds are stored tables; only the
    count of changed labels returns to the driver.
    """
    e = edges.select(F.col("old").alias("a"), F.col("new").alias("b")).filter("a <> b")
    both = materialize(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    lab = both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node"))
    while True:  # ends, because labels only fall
        near = (both.join(lab.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node"))
                .agg(F.min("label").alias("near")))
        hooked = lab.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = hooked.select(F.col("node").alias("label"), F.col("label").alias("up"))
        step = materialize(hooked.join(jump, "label").select("node", "was", F.least("label", "up").alias("label")))
        changed = step.filter("was <> label").limit(1).count()
        lab = step.select("node", "label")
        if not changed:
            return lab


def mapping_upsert(fresh: DataFrame, stored: DataFrame, manual: tuple[str, ...], seeded: dict[str, str]) -> DataFrame:
    """Refresh diagnostics, keep manual decisions, flag drift.

    ``fresh`` and ``stored``: old, new, diagnostic_hash; ``stored`` also holds the manual columns.
    A stored value that differs from its seeded default wins.  A reviewed row whose diagnostics
    changed needs revalidation; a stored row with a decision but no candidate is kept as orphan.
    """
    f = fresh.select("old", "new", F.col("diagnostic_hash").alias("fresh_hash"))
    s = stored.select("old", "new", F.col("diagnostic_hash").alias("stored_hash"), *manual)
    return upsert_beside(f.join(s, ["old", "new"], "full"), manual, seeded)


def upsert_beside(rows: DataFrame, manual: tuple[str, ...], seeded: dict[str, str]) -> DataFrame:
    """``mapping_upsert`` where candidates and stored rows of one key lie in one row already, so no pair is shuffled.

    ``rows``: old, new, fresh_hash (null without a candidate), stored_hash and the manual columns (null where nothing is stored).
    """
    decided = F.lit(False)
    cols = {}
    for m in manual:
        default = F.lit(seeded.get(m, ""))
        kept = F.col(m).isNotNull() & (F.col(m) != default) & (F.col(m) != "")
        decided = decided | kept
        cols[m] = F.when(kept, F.col(m)).otherwise(default)
    j = rows.withColumn("decided", decided)
    keep = j.filter(F.col("fresh_hash").isNotNull() | F.col("decided"))
    return keep.select("old", "new", *[c.alias(m) for m, c in cols.items()],
                       F.coalesce("fresh_hash", "stored_hash").alias("diagnostic_hash"),
                       F.col("fresh_hash").isNull().alias("orphan"),
                       (F.col("decided") & F.coalesce(F.col("fresh_hash") != F.col("stored_hash"), F.lit(False))).alias("needs_revalidation"))


def diagnostic_hash(columns: list[str | Column]):
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.sha2(F.concat_ws(",", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]), 256)


def rule_b_hash(slack: int = 15) -> Column:
    """``diagnostic_hash`` of gap_days and confidence for pairs of rule B: one of ``slack`` constants, so none is hashed per pair."""
    return F.get(F.array(*[diagnostic_hash([F.lit(k), F.lit("media")]) for k in range(slack + 1)]), F.col("gap_days"))
