"""Operator 3: mixing sources to target weights by exponential keys (Efraimidis and Spirakis), DataFrame functions only.

Sources share the word budget by weight, none above ``cap`` times its own words.  A source takes as many complete epochs
as fit; the rest of its budget goes to the documents with the smallest keys ``-ln(u) / quality``.  The running sums over
the keys are taken over a histogram of key ranges first; rows are sorted only inside the one range per source that holds
the cut, so a source with a third of all rows is never gathered.  What comes back per source is a cut, and whether a
document is selected is then a comparison with its own key: documents are never shuffled.  The cut may fall among equal
rows; it then says how many of them are taken, and only these rows are written and numbered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from leadwake.llm.common import WORD, load
from leadwake.session import materialize

CYCLE, CAP, SHARE, SEED = (5, 2, 1), 3, 1.0, "mix-1"
#: Key ranges per source: one for so many rows of the table, and at least so many.
RANGE_ROWS, RANGES = 100_000, 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """Between 0.2 and 1: falls as the mean length of words moves away from six characters; 1 without words."""
    mean = F.octet_length(text) / size
    return F.when(size > 0, F.greatest(F.lit(0.2), 1 / (1 + F.abs(mean / 6 - 1)))).otherwise(F.lit(1.0))


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    """row (the input), id, source, size, key; the key depends on the id, the text and the seed alone."""
    text = F.col(text_col)
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary")), 1, 13)
    sized = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), text.alias("body"),
                        word_count(text).alias("size"), ((F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)).alias("u"))
    keyed = sized.withColumn("key", -F.ln("u") / quality_weight(F.col("body"), F.col("size")))
    return keyed.select("row", "id", "source", "size", "key")


def _slot(ranges: int) -> Column:
    return F.floor((1 - F.exp(-F.col("key"))) * ranges).cast("long").alias("slot")


def targets(sizes: DataFrame, cycle=CYCLE, cap: int = CAP, share: float = SHARE) -> DataFrame:
    """source, source_size, target from (source, source_size), one row per source.

    Sources that the common level would lift over their cap are those with the smallest cap per weight; in that order,
    the level is the first one that its own source can take.
    """
    n = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(c)) for c in cycle]), (F.row_number().over(n) - 1) % len(cycle) + 1)
    ranked = sizes.select("source", "source_size", weight.alias("w")).withColumn("limit", F.col("source_size") * float(cap))
    order = W.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = ((F.sum("source_size").over(everything) * float(share) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
             / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    placed = ranked.withColumns({"place": F.row_number().over(order), "level": level})
    first = F.min(F.when(F.col("level") * F.col("w") <= F.col("limit"), F.struct("place", "level"))).over(everything)["level"]
    return placed.withColumn("common", first).select(
        "source", "source_size", F.coalesce(F.least("limit", F.col("common") * F.col("w")), F.col("limit")).alias("target"))


def cuts(rows: DataFrame, **shares) -> DataFrame:
    """Per source: source_size, target, epochs, slot and key of the cut, tie_key and tie_rows, from rows (source, size, key, slot).

    Rows up to the cut are taken; of the rows whose key is ``tie_key``, the next one, ``tie_rows`` are.
    """
    ranges = materialize(rows.groupBy("source", "slot").agg(F.sum("size").alias("words")))
    goal = targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), **shares)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = materialize(goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    prefix = W.partitionBy("source").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    run = ranges.withColumn("below", F.coalesce(F.sum("words").over(prefix), F.lit(0)))
    g, r = goal.alias("g"), run.alias("r")
    at = r.join(g, F.col("r.source").eqNullSafe(F.col("g.source"))).filter("below < rest and below + words >= rest").select("r.source", "r.slot", "below", "rest")
    at = materialize(at)
    inside = rows.alias("x").join(at.alias("a"), F.col("x.source").eqNullSafe(F.col("a.source")) & (F.col("x.slot") == F.col("a.slot"))).select(
        "x.source", "x.slot", "key", "size", "below", "rest")
    ties = inside.groupBy("source", "slot", "key", "below", "rest").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    up_to = W.partitionBy("source").orderBy("key").rowsBetween(W.unboundedPreceding, -1)
    # A row is taken where more than half of it fits, so all n rows of a key are where the last one does.
    placed = ties.withColumns({"lower": F.col("below") + F.coalesce(F.sum("size").over(up_to), F.lit(0)), "one": F.col("size") / F.col("n")})
    whole = F.col("lower") + F.col("size") - F.col("one") / 2 <= F.col("rest")
    fits = F.floor((F.col("rest") - F.col("lower")) / F.nullif("one", F.lit(0.0)) + 0.5).cast("long")
    last = placed.groupBy("source").agg(F.max(F.when(whole, F.col("key"))).alias("cut_key"),
                                        F.min(F.when(~whole & (F.col("n") > 1) & (fits > 0), F.struct("key", fits.alias("rows")))).alias("tie"))
    last = last.select("source", "cut_key", F.col("tie.key").alias("tie_key"), F.col("tie.rows").alias("tie_rows"))
    end = at.select("source", F.col("slot").alias("cut_slot"))
    out = goal.join(end, same(goal, end), "left").select(goal["*"], "cut_slot")
    return materialize(out.join(last, same(out, last), "left").select(out["*"], "cut_key", "tie_key", "tie_rows"))


def _first_of_equal(tied: DataFrame) -> DataFrame:
    """``tied`` with ``picked``: ``tie_rows`` rows of each source, numbered part by part so that no task holds a source's rows."""
    numbered = materialize(tied.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33).alias("part")
    counts = numbered.groupBy("source", part).agg(F.count(F.lit(1)).alias("rows"))
    before = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(F.col("source").alias("of"), F.col("part").alias("in_part"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    placed = numbered.withColumn("part", part).withColumn("nth", F.row_number().over(W.partitionBy("source", "part").orderBy("at")))
    return (placed.join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in_part")))
            .withColumn("picked", F.col("start") + F.col("nth") <= F.col("tie_rows")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, **shares) -> DataFrame:
    """row, id, source, size, source_size, target, copies: how often the mix takes each document.

    ``row`` is the whole input row as a struct, so extra columns may have any name.  A null or empty text has size 0 and is
    chosen by its key like any other.  Null sources form the last source.  Rows with the same id (or, without an id, the
    same text) share a key; where the cut falls among them, as many of them are taken as fit, in no set order.  A source's
    words differ from its target by half of the document at the cut at most.  An empty table gives an empty result; a table
    without words takes every document 0 times.
    """
    keyed = _keyed(docs, id_col, text_col, source_col, seed)
    narrow = materialize(keyed.select("source", "size", "key"))
    slot = _slot(max(RANGES, narrow.count() // RANGE_ROWS))
    limit = cuts(narrow.select("*", slot), **shares)
    k, c = keyed.select("*", slot).alias("k"), limit.alias("c")
    own = F.col("k.source").eqNullSafe(F.col("c.source"))
    found = ["row", "id", "k.source", "size", "source_size", "target", "epochs"]
    below = F.coalesce((F.col("slot") < F.col("cut_slot")) | ((F.col("slot") == F.col("cut_slot")) & (F.col("key") <= F.col("cut_key"))), F.lit(False))
    single = k.join(c, own).filter(~F.col("key").eqNullSafe(F.col("tie_key"))).select(*found, below.alias("picked"))
    split = limit.filter(F.col("tie_key").isNotNull()).alias("c")
    equal = _first_of_equal(k.join(split, own & (F.col("key") == F.col("tie_key"))).select(*found, "tie_rows"))
    return single.unionByName(equal.select(*single.columns)).select(
        "row", "id", "source", "size", "source_size", "target", (F.col("epochs") + F.col("picked").cast("long")).alias("copies"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document's row as often as it is taken, with the columns of the input."""
    chosen = mix(docs, **options).filter("copies > 0")
    return chosen.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op3(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL = r"""
WITH d AS (SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
             (('0x' || md5('mix-1:' || doc_id::VARCHAR)[1:13])::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM documents),
k AS (SELECT *, -ln(u) / CASE WHEN size > 0 THEN greatest(0.2::DOUBLE, 1 / (1 + abs(strlen(text)::DOUBLE / size / 6 - 1))) ELSE 1.0::DOUBLE END AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1 AS n FROM k GROUP BY source),
w AS (SELECT source, source_size, [5.0::DOUBLE, 2, 1][1 + n % 3] AS w, 3.0::DOUBLE * source_size AS lim FROM s),
p AS (SELECT *, row_number() OVER o AS place, (sum(source_size::DOUBLE) OVER () - coalesce(sum(lim) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
      FROM w WINDOW o AS (ORDER BY lim / w, source COLLATE "C" NULLS LAST), b AS (ORDER BY lim / w, source COLLATE "C" NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT arg_min(level, place) AS level FROM p WHERE level * w <= lim),
t AS (SELECT source, source_size, coalesce(least(lim, c.level * w), lim) AS target FROM p LEFT JOIN c ON true),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
r AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
        coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lower
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, ((epochs + (rest > 0 AND lower + size / 2.0::DOUBLE <= rest)::BIGINT) * size)::BIGINT AS taken FROM r
"""
