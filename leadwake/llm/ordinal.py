"""Operator 2: quality by an ordinal cumulative-link regression on graded ratings.

One weight per hashed text feature is shared by all grades; ordered thresholds turn a document's single number s into
P(grade <= k) = 1 / (1 + exp(s - threshold_k)).  That gives the expected grade and the tail P(grade >= k), by which
documents are selected.  A feature's value is its share of the words, so s is a mean of word weights: long texts are
scored by one pass over the words and a memo of their weights.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from leadwake.llm.common import WORD, load, map_arrow

#: Hashed weights, and the number of rated documents the model is fitted on (documented bounds).
SLOTS, FIT_ROWS, ROUNDS = 1 << 16, 6_000, 80
#: Values are shares times this.
SCALE = 30.0
#: Rejected: documents whose probability of the given grade or more is below the limit.
KEEP_GRADE, KEEP_LIMIT = 1, 0.25
MEMO_SIZE = 150_000
_WORDS = re.compile(WORD)
_LETTERS = re.compile(r"[^\W\d_]")


def _slot(feature: str) -> int:
    return xxhash.xxh64_intdigest(feature) % SLOTS


def word_slots(word: str) -> list[int]:
    """Features of a word: the word in lower case, its first five characters, and its shape."""
    low = word.lower()
    shape = "sign" if not _LETTERS.search(word) else "long" if len(word) > 24 else "word"
    return [_slot(f"w:{low}"), _slot(f"p:{low[:5]}"), _slot(f"s:{shape}")]


def text_slots(words: list[str]) -> list[tuple[int, float]]:
    """Features of the whole text with their values: repetition of the word before, and the size class."""
    repeated = sum(map(eq, words, words[1:])) / max(len(words), 1)
    return [(_slot("t:repeat"), SCALE * repeated), (_slot(f"t:size:{len(words).bit_length()}"), 1.0)]


def _vector(text: str) -> tuple[np.ndarray, np.ndarray]:
    words = _WORDS.findall(text)
    slots, n = np.unique(np.array([s for w in words for s in word_slots(w)] or [0], np.int64), return_counts=True)
    extra = text_slots(words)
    values = SCALE * n / len(words) if words else np.zeros(len(slots))
    return np.concatenate([slots, [s for s, _ in extra]]), np.concatenate([values, [v for _, v in extra]])


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, levels: int, rounds: int = ROUNDS, ridge: float = 1e-4):
    """Weights and ``levels - 1`` ascending thresholds, by full-gradient steps with a rate per weight (Adagrad)."""
    slots = np.concatenate([s for s, _ in rows]).astype(np.int64)
    values = np.concatenate([v for _, v in rows])
    owner = np.repeat(np.arange(len(rows)), [len(s) for s, _ in rows])
    weights, seen = np.zeros(SLOTS), np.full(SLOTS, 1e-12)
    share = np.array([max((grades <= k).mean(), 1e-3) for k in range(levels - 1)])
    cut = np.log(share / np.maximum(1 - share, 1e-3))
    free = np.concatenate([cut[:1], np.log(np.maximum(np.diff(cut), 1e-3))])  # first threshold, then logs of the gaps
    free_seen = np.full(levels - 1, 1e-12)
    at = np.arange(len(rows))
    for _ in range(rounds):
        cut = np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
        s = np.bincount(owner, values * weights[slots], len(rows))
        c = 1 / (1 + np.exp(np.clip(s[:, None] - cut, -30, 30)))
        c = np.column_stack([np.zeros(len(rows)), c, np.ones(len(rows))])
        slope = c * (1 - c)
        p = np.maximum(c[at, grades + 1] - c[at, grades], 1e-9)
        by_s = (slope[at, grades + 1] - slope[at, grades]) / p / len(rows)  # of minus the mean log-likelihood
        by_cut = np.array([(((grades == k + 1) - (grades == k).astype(float)) * slope[:, k + 1] / p).mean() for k in range(levels - 1)])
        tail = np.cumsum(by_cut[::-1])[::-1]
        step = np.bincount(slots, values * by_s[owner], SLOTS) + ridge * weights
        by_free = tail * np.concatenate([[1.0], np.exp(free[1:])])
        seen += step ** 2
        free_seen += by_free ** 2
        weights -= 0.3 * step / np.sqrt(seen)
        free -= 0.1 * by_free / np.sqrt(free_seen)
    return weights, np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))


def learn(docs: DataFrame, ratings: DataFrame, levels: int, rows: int = FIT_ROWS):
    """Fit on at most ``rows`` rated documents, chosen by the hash of their id; (None, None) without two grades."""
    sample = ratings.groupBy("doc_id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("doc_id")).limit(rows)
    rated = docs.join(F.broadcast(sample), "doc_id").select("text", "grade")  # the sample's size is the bound above

    def run(batches):
        for b in batches:
            got = [_vector(t or "") for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"grade": b.column(1), "slots": pa.array([s.astype("<i4").tobytes() for s, _ in got], pa.binary()),
                                              "values": pa.array([v.astype("<f8").tobytes() for _, v in got], pa.binary())})

    got = map_arrow(rated, run, "grade int, slots binary, values binary").toArrow()
    grades = got["grade"].to_numpy()
    if len(set(grades.tolist())) < 2:
        return None, None
    vectors = [(np.frombuffer(s, "<i4"), np.frombuffer(v, "<f8")) for s, v in zip(got["slots"].to_pylist(), got["values"].to_pylist())]
    return fit(vectors, grades, levels)


class _Weights(dict):
    """Weights of words, found once each."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= MEMO_SIZE:
            self.clear()
        self[word] = value = float(self.weights[word_slots(word)].sum())
        return value


def _score_udf(spark, weights: np.ndarray):
    sent = spark.sparkContext.broadcast(weights)  # SLOTS numbers

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights = sent.value
        memo = _Weights(weights)  # given back with the partition: workers live on into later stages
        for texts in batches:
            out = []
            for t in texts.to_pylist():
                words = _WORDS.findall(t or "")
                s = SCALE * sum(map(memo.__getitem__, words)) / max(len(words), 1)
                out.append(s + sum(float(weights[k]) * v for k, v in text_slots(words)))
            yield pa.array(out, pa.float64())

    return score


def graded(labels: DataFrame) -> DataFrame:
    """Ratings 0 (bad), 1 (good but toxic), 2 (good) from the two label columns; rows without a quality label have none."""
    return labels.filter("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("quality") <= 0, 0).when(F.col("toxic") > 0, 1).otherwise(2).cast("int").alias("grade"))


def classify(docs: DataFrame, ratings: DataFrame, levels: int = 3, keep_grade: int = KEEP_GRADE, limit: float = KEEP_LIMIT,
             id_col: str = "doc_id", text_col: str = "text", rows: int = FIT_ROWS) -> DataFrame:
    """row, expected_grade, tail and kept for every document, in the order read.

    ``row`` is the whole input row as a struct, so other columns may have any name.  ``ratings`` is (doc_id, grade from 0 to
    levels - 1); of repeated ratings for an id the lowest counts.  Null and empty texts are scored by their size class.
    Without ratings of two grades nothing is known and every document is kept, with null probabilities.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    weights, cut = learn(plain, ratings, levels, rows)
    row = docs.select(F.struct("*").alias("row"))
    if weights is None:
        return row.select("row", F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("tail"), F.lit(True).alias("kept"))
    conf = docs.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(512, int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))))
    scored = row.withColumn("s", _score_udf(docs.sparkSession, weights)(F.col(f"row.{text_col}").cast("string")))
    tails = [1 / (1 + F.exp(F.lit(float(c)) - F.col("s"))) for c in cut]  # P(grade >= k + 1)
    tail = tails[keep_grade - 1]
    return scored.select("row", sum(tails[1:], tails[0]).alias("expected_grade"), tail.alias("tail"), (tail >= limit).alias("kept"))


def op2(spark, sf_dir: str) -> DataFrame:
    got = classify(load(spark, sf_dir, "documents").select("doc_id", "text"), graded(load(spark, sf_dir, "labels")))
    return got.select("row.doc_id", "expected_grade", "tail", "kept")
