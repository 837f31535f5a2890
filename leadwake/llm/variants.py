"""Operator 11: spelling variants, found by a relational trie frontier.

Words are nodes and edges of two tries, one of the words and one of the reversed words.  A node is the hash of a prefix, an
inner node has two ways on or more (a word's end is one), and an edge leads from an inner node along one character to the next
inner node or the end of a word, with all characters between as its label: long words cost one edge, not one per character.

A frontier of states (word, position, node, edits) moves through the edge table level by level.  Two words one edit apart part
at an inner node, so a state gets its edit there: another character replaces the word's, or the word's is left out.  (One more
character is the same pair seen from the longer word.)  After that it follows only edges whose label the word holds, and a
state at the end of its word and of another is a pair.  Edits fall into the second half of a word only; those of the first
half are in the second half of the reversed word.  There nodes have few ways on, and no node near the root gathers all words.

Hashes only place rows; a pair is compared as text before it counts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leadwake.llm.common import load, map_arrow
from leadwake.session import materialize

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: One run in so many loses a code point.
SLIP = 97
#: Words of more code points travel as a digest where only their identity matters.
LONG = 64
#: Distinct words that a task holds before it passes its counts on.
HELD = 200_000
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0xC0 else 0x20 for b in range(256))


def runs(text: str | None) -> list[bytes]:
    """Runs of letters in Latin-1, one byte per code point, A-Z in lower case; what is outside of Latin-1 is no letter."""
    return text.encode("latin-1", "replace").translate(_FOLD).split() if text else []


def slipped(run: bytes, base: int) -> bytes:
    """The run, without one code point where the hash says so; ``base`` is the hash of the document's part."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), base)
    if h % SLIP:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1:]


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of at least LEAST_LENGTH code points and ``least`` occurrences.  A null id reads as an empty text."""

    def run(batches):
        total: Counter = Counter()

        def given():
            words, counts = list(total), list(total.values())
            total.clear()
            return pa.RecordBatch.from_pydict({"word": pa.array([w.decode("latin-1") for w in words], pa.string()), "n": pa.array(counts, pa.int64())})

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                base = zlib.crc32(f"{doc}:".encode())
                for r, n in Counter(runs(text)).items():
                    if len(r) >= LEAST_LENGTH:
                        w = slipped(r, base)
                        if len(w) >= LEAST_LENGTH:
                            total[w] += n
                if len(total) >= HELD:
                    yield given()
        yield given()

    some = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col).cast("string"))
    return map_arrow(some, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _both_ways(words: DataFrame) -> DataFrame:
    """way 0: the word; way 1: reversed.  ``half`` is where edits begin: a pair's edit is in exactly one of the two halves."""
    n = F.length("word")
    return words.select(F.col("word"), n.alias("len"), F.explode(F.array(
        F.struct(F.lit(0).alias("way"), F.col("word").alias("s"), F.floor(n / 2).cast("int").alias("half")),
        F.struct(F.lit(1).alias("way"), F.reverse("word").alias("s"), F.ceil(n / 2).cast("int").alias("half")))).alias("x")).select("word", "len", "x.*")


def tries(words: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges (node, char, label, child), ends (node, s) and own paths (s, len, way, at: positions of the inner nodes)."""
    short = F.length("word") <= LONG
    key = F.when(short, F.col("word")).otherwise(F.concat(F.lit("#"), F.sha2("word", 256)))
    keyed = _both_ways(words).withColumn("key", key)
    steps = keyed.select("key", "way", F.expr("explode(transform(sequence(half, len), k -> struct(k AS pos, xxhash64(way, substring(s, 1, k)) AS node, substring(s, k + 1, 1) AS char)))").alias("x")).select("key", "way", "x.*")
    inner = steps.groupBy("node").agg(F.min("char").alias("lo"), F.max("char").alias("hi")).filter("lo < hi").select("node")
    at = steps.join(inner, "node", "left_semi").groupBy("key", "way").agg(F.sort_array(F.collect_list("pos")).alias("at"))
    own = materialize(at.join(keyed.select("key", "way", "s", "len"), ["key", "way"]).select("s", "len", "way", "at"))
    parts = own.select("s", "way", F.expr("explode(transform(at, (b, i) -> struct(b, coalesce(get(at, i + 1), len) AS e)))").alias("x")).filter("x.b < x.e")
    edges = parts.select(F.expr("xxhash64(way, substring(s, 1, x.b))").alias("node"), F.expr("substring(s, x.b + 1, 1)").alias("char"),
                         F.expr("substring(s, x.b + 1, x.e - x.b)").alias("label"), F.expr("xxhash64(way, substring(s, 1, x.e))").alias("child"))
    return materialize(edges.distinct()), own.select(F.expr("xxhash64(way, s)").alias("node"), F.col("s").alias("other"), F.col("way").alias("other_way")), own


def neighbours(words: DataFrame) -> DataFrame:
    """(a, b): every ordered pair of words that differ by exactly one inserted, deleted or replaced code point, once."""
    edges, ends, own = tries(words)
    state = ["s", "len", "way", "p", "gone", "pos", "node"]  # p: where the edit is; gone: whether the character there was left out
    paths = own.select("s", "len", "way", F.explode("at").alias("p")).filter("p < len").withColumns({
        "node": F.expr("xxhash64(way, substring(s, 1, p))"), "own": F.expr("substring(s, p + 1, 1)")})
    # Left out; where the next character is the same, the words part later.
    left_out = paths.filter("substring(s, p + 2, 1) <> own").select("s", "len", "way", "p", F.lit(1).alias("gone"), (F.col("p") + 1).alias("pos"), "node")
    # Replaced, once for both of the pair: by the larger character.
    replaced = (paths.join(edges, "node").filter("char > own and substring(label, 2) = substring(s, p + 2, length(label) - 1)")
                .select("s", "len", "way", "p", F.lit(0).alias("gone"), (F.col("p") + F.length("label")).alias("pos"), F.col("child").alias("node")))
    # What the frontier reaches is stored per level, so no level is computed twice.
    level = materialize(left_out.union(replaced).filter("pos <= len"))
    arrived = [level.filter("pos = len")]
    while True:
        going = level.filter("pos < len").withColumn("char", F.expr("substring(s, pos + 1, 1)"))
        if going.isEmpty():
            break
        level = materialize(going.join(edges, ["node", "char"]).filter("label = substring(s, pos + 1, length(label))")
                            .select("s", "len", "way", "p", "gone", (F.col("pos") + F.length("label")).alias("pos"), F.col("child").alias("node")))
        arrived.append(level.filter("pos = len"))
    done = arrived[0]
    for more in arrived[1:]:
        done = done.union(more)
    met = done.select(*state).join(ends, "node").filter(
        "way = other_way and length(other) = len - gone and substring(s, 1, p) = substring(other, 1, p) and substring(s, p + 2) = substring(other, p + 2 - gone)")
    # A pair whose edit can stand at several places of a run of equal characters is left to the words as they are.
    first = F.expr("CAST(floor(len / 2) AS int)")
    once = met.filter((F.col("way") == 0) | (F.reverse("s").substr(F.lit(1), first) != F.reverse("other").substr(F.lit(1), first)))
    pair = once.select(F.when(F.col("way") == 0, F.col("s")).otherwise(F.reverse("s")).alias("a"), F.when(F.col("way") == 0, F.col("other")).otherwise(F.reverse("other")).alias("b"))
    return pair.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.*")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms followed to the last.  A form is at least twice as frequent as its word, so a chain has at most as
    many links as the largest count has bits; each round doubles how far a link reaches."""
    reach = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        further = reach.join(reach.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        reach = materialize(further.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if reach.filter("moved").isEmpty():
            return reach.select("word", "root")
        reach = reach.drop("moved")


def group(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of (word, n).

    ``form``: the near word of largest n (ties: the smallest), if that is at least twice the word's own n; else null.
    """
    words = materialize(words.select("word", "n"))
    near = materialize(neighbours(words.select("word")))
    ranked = near.join(words.select(F.col("word").alias("b"), F.col("n").alias("m")), "b").groupBy(F.col("a").alias("word")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("b").alias("b"))).alias("top"))
    placed = materialize(words.join(ranked, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("top.m") >= 2 * F.col("n"), F.col("top")).alias("top")).select(
        "word", F.col("top.b").alias("form"), "n", "n_near", (-F.col("top.m")).alias("form_n")))
    roots = _roots(placed.filter("form is not null"))
    return placed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spelling variants among the words of all whole texts.

    Null and empty texts have no words; repeated rows count each time; other columns are not read; an empty table has no words.
    """
    return group(counted(docs, id_col, text_col))


def op11(spark, sf_dir: str) -> DataFrame:
    return variants(load(spark, sf_dir, "documents"))
