"""Operator 4: quality rules as a bitmask ledger, SQL functions only.

Every rule is evaluated once per document.  The ledger keeps the measurements and one failure bit per rule.  A policy is
a versioned mask: applying it, or asking what a policy would keep without one of its rules, reads the bits alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leadwake.llm.common import SPACE, WORD, load

#: Rule by bit, in order; a rule holds where the document fails.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 10 * word_chars",
    "repeated_lines": "100 * n_dup_lines > 60 * n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 20 * n_words",
}
BASE = ("few_words", "repeated_words")
#: Policies by version: the rules that reject.
POLICIES = {"v1": BASE, "v2": (*BASE, "symbols"), "v3": tuple(RULES)}
CURRENT = "v3"


def mask(rules) -> int:
    return sum(1 << list(RULES).index(r) for r in rules)


def _let(value: str, name: str, body: str) -> str:
    """Bind an expression to a name, so that it is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _repeat_words(w: str) -> str:
    """Positions covered by 3-word windows that occur twice or more in the array of words ``w``.

    A window becomes one number: the upper bits of its hash, then its place.  Sorted, equal windows are neighbours; that
    their words are equal is looked up, so a clash of hashes makes no repeat.
    """
    bits = f"cast(ceil(log2(size({w}) + 1)) as int)"
    place = lambda x: f"cast({x} & m as int)"
    same = lambda x, y: (f"({x} | m) = ({y} | m) and " + " and ".join(
        f"{w}[{place(x)} + {k}] = {w}[{place(y)} + {k}]" for k in range(3)))
    packed = f"sort_array(transform(sequence(0, size({w}) - 3), i -> (xxhash64({w}[i], {w}[i + 1], {w}[i + 2]) | m) - m + i))"
    repeated = f"filter(p, (x, k) -> (k > 0 and {same('x', 'get(p, k - 1)')}) or (k + 1 < size(p) and {same('x', 'get(p, k + 1)')}))"
    places = f"sort_array(transform({repeated}, x -> {place('x')}))"
    covered = "aggregate(transform(q, (x, k) -> least(3, coalesce(get(q, k + 1), x + 3) - x)), 0L, (a, x) -> a + x)"
    return (f"CASE WHEN size({w}) < 4 THEN 0L ELSE "
            + _let(f"shiftleft(1L, {bits}) - 1", "m", _let(packed, "p", _let(places, "q", covered))) + " END")


def measures(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words; a null text counts as empty."""
    body = F.coalesce(text, F.lit(""))
    return F.transform(F.array(body), _measure)[0]


def _measure(body: Column) -> Column:
    trimmed = F.btrim(body, F.lit(" \t\n\x0b\f\r"))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE}]+", -1))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))

    def of_words(w: Column) -> Column:
        return F.transform(F.array(lines), lambda rows: F.struct(
            F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), F.size(rows).cast("long").alias("n_lines"),
            (F.size(rows) - F.size(F.array_distinct(rows))).cast("long").alias("n_dup_lines"), w.alias("words")))[0]

    return F.transform(F.array(words), of_words)[0]


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements and failure_bits of every document; one row per input row.

    A null or empty text has no words and fails ``few_words``.  Ids may be null or repeat.  Other columns are not read.
    No rows are exchanged: each document is measured where it is read.
    """
    m = docs.select(F.col(id_col).cast("long").alias("doc_id"), measures(F.col(text_col)).alias("m"))
    flat = m.select("doc_id", *[f"m.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines")],
                    F.expr(_let("m.words", "w", _repeat_words("w"))).alias("n_repeat_words"))
    bits = " | ".join(f"(CASE WHEN {rule} THEN {1 << k}L ELSE 0L END)" for k, rule in enumerate(RULES.values()))
    return flat.withColumn("failure_bits", F.expr(bits))


def keeps(bits: Column, policy: str) -> Column:
    return bits.bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablation(book: DataFrame) -> DataFrame:
    """policy, dropped rule (null: none), n_kept: what each policy keeps, whole and without each of its rules.

    Documents are first counted by their bits, at most 2 to the number of rules rows.
    """
    counts = book.groupBy("failure_bits").agg(F.count("*").alias("n"))
    cases = F.array(*[F.struct(F.lit(name).alias("policy"), F.lit(drop).cast("string").alias("dropped"), F.lit(mask(r for r in rules if r != drop)).cast("long").alias("mask"))
                      for name, rules in POLICIES.items() for drop in (None, *rules)])
    return (counts.select("failure_bits", "n", F.explode(cases).alias("c")).groupBy("c.policy", "c.dropped")
            .agg(F.sum(F.when(F.col("failure_bits").bitwiseAND(F.col("c.mask")) == 0, F.col("n")).otherwise(0)).alias("n_kept")))


def op4(spark, sf_dir: str) -> DataFrame:
    book = ledger(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (~keeps(F.col("failure_bits"), "v1")).alias("base_failed"), keeps(F.col("failure_bits"), CURRENT).alias("kept"), "n_lines", "failure_bits")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
t AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM t) WHERE c > 1),
n AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(n.n, 0) AS n_repeat_words FROM w LEFT JOIN n ON w.doc_id = n.doc_id),
b AS (SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (100 * n_symbols > 10 * word_chars)::BIGINT
        + 8 * (100 * n_dup_lines > 60 * n_lines)::BIGINT + 16 * (word_chars < 2 * n_words OR word_chars > 20 * n_words)::BIGINT AS failure_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failure_bits & 3) <> 0 AS base_failed, failure_bits = 0 AS kept, n_lines, failure_bits FROM b
"""
