"""Operator 5: toxicity by class-conditional Kneser-Ney models of how words are spelled.

A document is the set of its different words, in lower case and in any script; a word is spelled as ``    word `` and each
of its characters is predicted from the four before it.  The models of toxic and of ordinary documents discount their own
counts of 5-character grams and leave the rest to one shared Kneser-Ney model of all documents, whose lower orders are
continuation counts (how many different characters come before a gram).  Counts, continuation counts and log-likelihood
ratios are Spark tables with one row per different gram, so they grow with the corpus; nothing of them goes to the driver.

Texts are read once and never exchanged: a chunk of documents becomes one row that lists its different words and those of
each document.  Chunks fetch the ratios of their grams by a join.  Score: a logistic curve over the log-likelihood ratio
per symbol of the whole document and that of its highest words, fitted on labelled documents that no count has seen.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from leadwake.llm.common import hash_bucket, load, map_arrow
from leadwake.session import materialize

#: Characters of a gram, and words that make the peak.
ORDER, PEAK = 5, 3
#: Discount of the shared orders; of a class, whose grams in up to so many documents are left to the shared model.
DISCOUNT, CLASS_DISCOUNT = 0.75, 3.0
#: Characters of text in one chunk.
CHUNK_CHARS = 24 << 20
#: One in so many labelled documents is kept out of the counts; of these, so many at most fit the logistic curve.
CURVE_SHARE, CURVE_ROWS = 8, 20_000

_WORD = re.compile(r"\w+|[^\w\s]")
INDEX = "chunk long, doc_ids array<long>, sizes binary, words binary, vocabulary binary"
GRAMS = "gram string, n_none long, n_ordinary long, n_toxic long"


def _zip(numbers) -> bytes:
    """Numbers below 2^31, lowest bytes first: what compresses well."""
    return zlib.compress(np.asarray(numbers, np.int32).view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def _unzip(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.int32).ravel().astype(np.int64)


def _index(batches, chunk_chars: int = CHUNK_CHARS):
    """One row per chunk of (doc_id, text): the different words, frequent ones first, and those of each document as rising numbers."""
    from pyspark import TaskContext
    task, made, held, size = TaskContext.get().partitionId(), 0, [], 0
    vocabulary: dict[str, int] = {}

    def flush():
        sizes = np.array([len(w) for _, w in held], np.int64)
        words, of = np.concatenate([w for _, w in held]), np.repeat(np.arange(len(sizes)), sizes)
        often = np.argsort(-np.bincount(words, minlength=len(vocabulary)), kind="stable")
        number = np.empty(len(often), np.int64)
        number[often] = np.arange(len(often))
        words = np.sort(of * max(len(often), 1) + number[words]) - of * max(len(often), 1)
        starts = (np.cumsum(sizes) - sizes)[sizes > 0]
        steps = np.diff(words, prepend=0)
        steps[starts] = words[starts]
        named = list(vocabulary)
        return pa.RecordBatch.from_pydict({
            "chunk": pa.array([(task << 32) + made], pa.int64()), "doc_ids": pa.array([[d for d, _ in held]], pa.list_(pa.int64())), "sizes": [_zip(sizes)],
            "words": [_zip(steps)], "vocabulary": [zlib.compress("\n".join(named[k] for k in often).encode(errors="surrogatepass"), 3)]})

    for b in batches:
        for doc, text in zip(*(c.to_pylist() for c in b.columns)):
            text = text or ""
            held.append((doc, np.array([vocabulary.setdefault(w, len(vocabulary)) for w in set(_WORD.findall(text.lower()))], np.int32)))
            size += len(text) + 64
            if size >= chunk_chars:
                yield flush()
                made, held, size, vocabulary = made + 1, [], 0, {}
    if held:
        yield flush()


def spelled(words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different grams of these words, the number of symbols of each word, and the gram of each symbol.

    Windows of code points are numbered exactly: by packing ranks of the characters where ORDER of them fit into 62 bits,
    else symbol by symbol.
    """
    if not words:
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    pad = " " * (ORDER - 1)
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    raw = "".join(f"{pad}{w} " for w in words).encode("utf-32-le", "surrogatepass")
    points = np.frombuffer(raw, np.uint32)
    alphabet, ranks = np.unique(points, return_inverse=True)
    ranks, many = ranks.astype(np.int64), len(alphabet)
    starts = np.cumsum(sizes + ORDER - 1) - (sizes + ORDER - 1)  # of words, and of the window that predicts each symbol
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    code = ranks[at]
    for k in range(1, ORDER):
        if many ** (k + 1) >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
        code = code * many + ranks[at + k]
    _, first, number = np.unique(code, return_index=True, return_inverse=True)
    text = points[at[first][:, None] + np.arange(ORDER)].tobytes().decode("utf-32-le", "surrogatepass")
    return [text[k:k + ORDER] for k in range(0, len(text), ORDER)], sizes, number


def _vocabulary(raw: bytes) -> list[str]:
    text = zlib.decompress(raw).decode(errors="surrogatepass")
    return text.split("\n") if text else []


def _members(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Document and word of every entry of a chunk, by document."""
    sizes, running = _unzip(row["sizes"]), np.cumsum(_unzip(row["words"]))
    words = running - np.repeat(np.concatenate(([0], running))[np.cumsum(sizes) - sizes], sizes)
    return np.repeat(np.arange(len(sizes)), sizes), words


def _classes(row: dict) -> np.ndarray:
    out = np.zeros(len(row["doc_ids"]), np.int64)
    for x in row["known"] or []:
        out[x["pos"]] = x["class"]
    return out


def _count(batches):
    for b in batches:
        for row in b.to_pylist():
            words = _vocabulary(row["vocabulary"])
            grams, sizes, number = spelled(words)
            doc, word = _members(row)
            per_word = np.bincount(_classes(row)[doc] * max(len(words), 1) + word, minlength=3 * len(words)).reshape(3, -1)
            total = [np.bincount(number, np.repeat(n, sizes), len(grams)).astype(np.int64) if len(grams) else [] for n in per_word]
            yield pa.RecordBatch.from_pydict({"gram": pa.array(grams, pa.string()), **{n: pa.array(total[k], pa.int64()) for k, n in enumerate(("n_none", "n_ordinary", "n_toxic"))}})


def _with_classes(index: DataFrame, placed: DataFrame) -> DataFrame:
    return index.join(placed.hint("merge"), "chunk", "left")


def gram_counts(indexed: DataFrame) -> DataFrame:
    """(gram, n_none, n_ordinary, n_toxic): how often the different words of each class's documents have the gram."""
    per_chunk = map_arrow(indexed, _count, GRAMS)
    return per_chunk.groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("n_none", "n_ordinary", "n_toxic")])


def _discounted(counts: DataFrame, order: int, discounts: dict[str, float]) -> DataFrame:
    """gram, lower (its last order - 1 characters), and for each count n of it: what its discount keeps, over all grams of the
    same history (keep_n), and the share left to the lower order (rest_n), 1 for a history without n."""
    history = counts.groupBy(F.substring("gram", 1, order - 1).alias("history")).agg(
        *[F.sum(n).cast("double").alias(f"all_{n}") for n in discounts], *[F.sum(F.least(F.col(n).cast("double"), F.lit(d))).alias(f"cut_{n}") for n, d in discounts.items()])
    both = counts.withColumn("history", F.substring("gram", 1, order - 1)).join(history, "history")
    keep = [F.when(F.col(f"all_{n}") > 0, F.greatest(F.col(n) - d, F.lit(0.0)) / F.col(f"all_{n}")).otherwise(0.0).alias(f"keep_{n}") for n, d in discounts.items()]
    rest = [F.when(F.col(f"all_{n}") > 0, F.col(f"cut_{n}") / F.col(f"all_{n}")).otherwise(1.0).alias(f"rest_{n}") for n in discounts]
    return both.select("gram", F.substring("gram", 2, order - 1).alias("lower"), *keep, *rest)


def log_ratios(counts: DataFrame) -> DataFrame:
    """(gram, ratio): log P(last character | those before, toxic) - log P(... | ordinary), for every gram of ``gram_counts``.

    Every order is a group-by of the one above it; both classes back off to the shared model of all documents.
    """
    levels = {ORDER: counts.withColumn("n", F.expr("n_none + n_ordinary + n_toxic"))}
    for k in range(ORDER - 1, 0, -1):  # continuation counts
        levels[k] = materialize(levels[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n")))
    total = levels[1].agg(F.sum("n")).first()[0]
    # What is discounted here goes evenly to the same characters, so nothing is.
    lower = levels[1].select(F.col("gram").alias("lower"), (F.col("n") / float(max(total or 0, 1))).alias("p"))
    for k in range(2, ORDER + 1):
        used = {"n": DISCOUNT, **({"n_ordinary": CLASS_DISCOUNT, "n_toxic": CLASS_DISCOUNT} if k == ORDER else {})}
        kept = [f"{a}_{n}" for n in used if n != "n" for a in ("keep", "rest")]
        shared = _discounted(levels[k], k, used).join(lower, "lower").select("gram", *kept, F.expr("keep_n + rest_n * p").alias("p"))
        lower = shared.select(F.col("gram").alias("lower"), "p")
    return shared.select("gram", F.expr("ln(keep_n_toxic + rest_n_toxic * p) - ln(keep_n_ordinary + rest_n_ordinary * p)").alias("ratio"))


def _wanted(batches):
    for b in batches:
        for row in b.to_pylist():
            grams = spelled(_vocabulary(row["vocabulary"]))[0]
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(np.full(len(grams), row["chunk"], np.int64)), "pos": pa.array(np.arange(len(grams), dtype=np.int32)), "gram": pa.array(grams, pa.string())})


def _features(batches):
    for b in batches:
        found = b.column(b.schema.get_field_index("found"))
        for k, row in enumerate(b.drop_columns(["found"]).to_pylist()):
            grams, sizes, number = spelled(_vocabulary(row["vocabulary"]))
            ratio, flat = np.zeros(len(grams)), found.slice(k, 1).flatten()
            if len(flat):
                at, values = (x.to_numpy(zero_copy_only=False) for x in flat.flatten())
                ratio[at] = values
            of = np.bincount(np.repeat(np.arange(len(sizes)), sizes), ratio[number], len(sizes)) if len(grams) else np.zeros(0)
            doc, word = _members(row)
            n = len(row["doc_ids"])
            whole = np.bincount(doc, of[word], n) / np.maximum(np.bincount(doc, sizes[word], n), 1)
            each = of[word] / sizes[word]
            order = np.lexsort((-each, doc))
            rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
            top = rank < PEAK  # the same places as in doc, which is sorted
            peak = np.bincount(doc[top], each[order][top], n) / np.maximum(np.bincount(doc[top], minlength=n), 1)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(row["doc_ids"], pa.int64()), "whole": pa.array(whole), "peak": pa.array(peak)})


def features(index: DataFrame, ratios: DataFrame) -> DataFrame:
    """(doc_id, whole, peak): log-likelihood ratio per symbol of all different words of a document, and the mean of that of
    its PEAK highest words; 0 without words."""
    wanted = map_arrow(index.select("chunk", "vocabulary"), _wanted, "chunk long, pos int, gram string")
    got = wanted.join(ratios.hint("merge"), "gram").groupBy("chunk").agg(F.collect_list(F.struct("pos", "ratio")).alias("found"))
    return map_arrow(index.join(got.hint("merge"), "chunk", "left"), _features, "doc_id long, whole double, peak double")


def held_out(doc_id: Column) -> Column:
    """Rows whose label is never learnt from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def for_curve(doc_id: Column) -> Column:
    """Labelled documents that no class counts: the curve is fitted on them."""
    return hash_bucket(doc_id, 5, CURVE_SHARE) == 0


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Newton's method with a light ridge; x has a column of ones."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 1e-2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", curve_rows: int = CURVE_ROWS) -> DataFrame:
    """doc_id, held_out, score in [0, 1], predicted, one row per document.

    Labels are read from rows that are not held out; of repeated labels for an id the largest counts, null ones don't.
    A null text counts as empty; an empty one has ratios of 0 and is scored by the curve.  Where the labels that the curve is
    fitted on are not of both kinds every score is 0.  Repeated documents are scored one by one.  Other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    known = materialize(known)
    index = materialize(map_arrow(docs.select("doc_id", "text"), _index, INDEX))
    # One plan at every size: labels are dealt with the ids, never broadcast.
    placed = index.select("chunk", F.posexplode("doc_ids").alias("pos", "doc_id")).join(known.filter(~for_curve(F.col("doc_id"))).hint("shuffle_hash"), "doc_id")
    placed = placed.groupBy("chunk").agg(F.collect_list(F.struct("pos", F.when(F.col("toxic") > 0, 2).otherwise(1).alias("class"))).alias("known"))
    counted = materialize(gram_counts(_with_classes(index, placed)))
    found = materialize(features(index, materialize(log_ratios(counted))))
    sample = known.filter(for_curve(F.col("doc_id"))).orderBy(F.xxhash64("doc_id")).limit(curve_rows)
    fit = found.join(sample, "doc_id").select("whole", "peak", "toxic").toArrow()
    y = (fit["toxic"].to_numpy() > 0).astype(float)
    if len(y) == 0 or y.min() == y.max():
        score = F.lit(0.0)
    else:
        x = np.column_stack([fit[c].to_numpy() for c in ("whole", "peak")])
        centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        w = _logistic(np.column_stack([(x - centre) / scale, np.ones(len(x))]), y)
        slope = w[:-1] / scale
        margin = sum((F.col(c) * float(s) for c, s in zip(("whole", "peak"), slope)), F.lit(float(w[-1] - slope @ centre)))
        score = 1 / (1 + F.exp(-F.greatest(F.least(margin, F.lit(30.0)), F.lit(-30.0))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5(spark, sf_dir: str) -> DataFrame:
    return toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
