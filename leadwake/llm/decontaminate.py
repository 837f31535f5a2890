"""Operator 12: benchmark passages in documents, found by one Aho-Corasick automaton.

Items and documents are normalised alike: A-Z in lower case, words of digits, letters and anything beyond ASCII, one blank
between words.  The patterns are the items' windows of ten words (a shorter item is one window) with a blank on both sides.
Each document is read once; where a window ends, its words are looked up by their blanks, and their places in the original
text are those of the same words there.

The automaton is sent to every task, so its size has a bound: windows of more than ``BLOCK_BYTES`` in all are dealt into
blocks, and documents pass the blocks one after the other, carrying what was found.  No rows are exchanged.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from leadwake.llm.common import load, map_arrow
from leadwake.session import materialize

WINDOW = 10
#: Bytes of windows in one automaton; a byte is a node of some 50 bytes at most.
BLOCK_BYTES = 4_000_000
#: Bytes below 0x80 that belong to words, in lower case; all others give way to a blank.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_PLACES = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SPANS = "array<struct<start:int,stop:int>>"


def words(text: bytes | None) -> list[bytes]:
    """The normalised words of a text in UTF-8."""
    return text.translate(_FOLD).split() if text else []


def windows(text: bytes | None) -> list[str]:
    """The distinct windows of an item, one character per byte, with a blank before, after and between words."""
    w = words(text)
    return list(dict.fromkeys(f" {b' '.join(w[k:k + WINDOW]).decode('latin-1')} " for k in range(max(1, len(w) - WINDOW + 1)))) if w else []


def patterns(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, window): every window of every item, once."""

    def run(batches):
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = [w.encode("latin-1") for w in windows(text)]
                yield pa.RecordBatch.from_pydict({"item": pa.array([item] * len(found), pa.string()), "window": pa.array(found, pa.binary())})

    return map_arrow(items.select(F.col(id_col).cast("string"), F.col(text_col).cast("string").cast("binary")), run, "item string, window binary").distinct()


def automaton(rows: list[tuple[str | None, bytes]]) -> ahocorasick.Automaton:
    """Windows to (number of words, their items)."""
    owners: dict[bytes, list] = {}
    for item, window in rows:
        owners.setdefault(window, []).append(item)
    found = ahocorasick.Automaton()
    for window, items in owners.items():
        found.add_word(window.decode("latin-1"), (window.count(b" ") - 1, tuple(items)))
    if owners:
        found.make_automaton()
    return found


def occurrences(auto: ahocorasick.Automaton, w: list[bytes]) -> tuple[list[list[int]], set]:
    """Maximal hit runs of words [first, end) and the items of the windows that occur."""
    runs: list[list[int]] = []
    items: set = set()
    if not w or not len(auto):
        return runs, items
    text = f" {b' '.join(w).decode('latin-1')} "
    ends = None
    seen = set()
    for at, (n, owners) in auto.iter(text):
        if ends is None:
            ends = np.cumsum(np.fromiter((len(x) + 1 for x in w), np.int64, len(w)))  # the blank behind each word
        last = int(np.searchsorted(ends, at))
        first = last + 1 - n
        while runs and first <= runs[-1][1]:  # windows of several lengths end in order, but may start before an earlier one
            first = min(first, runs.pop()[0])
        runs.append([first, last + 1])
        if id(owners) not in seen:  # the tuple lives as long as the automaton
            seen.add(id(owners))
            items.update(owners)
    return runs, items


_BUILT: dict[int, ahocorasick.Automaton] = {}


def _built(key: int, rows: list[tuple[str | None, bytes]]) -> ahocorasick.Automaton:
    """A worker keeps the automaton of the block it saw last from task to task."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = automaton(rows)
    return _BUILT[key]


def _scan(docs: DataFrame, rows: list[tuple[str | None, bytes]], last: bool) -> DataFrame:
    """One block of windows over all documents; runs of words and items are merged with those found before.  After the last
    block the runs are also places in the text, and the text itself stays behind."""
    sent, key = docs.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().int  # BLOCK_BYTES and as many item ids as windows

    def run(batches):
        auto = _built(key, sent.value)
        for b in batches:
            counts, runs, items, spans = [], [], [], []
            for text, r, it in zip(*(b.column(c).to_pylist() for c in ("__text", "__runs", "__items"))):
                w = words(text)
                found, owners = occurrences(auto, w)
                counts.append(len(w))
                runs.append(_merged(r, found))
                items.append(sorted({*it, *(x for x in owners if x is not None)}))
                spans.append(places(text, runs[-1]) if last else [])
            fresh = {"__n": pa.array(counts, pa.int64()), "__runs": pa.array(runs, pa.list_(pa.list_(pa.int32()))), "__items": pa.array(items, pa.list_(pa.string())),
                     "__spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))}
            yield pa.RecordBatch.from_arrays([fresh[c] if c in fresh else b.column(c) for c in schema.names], names=schema.names)

    schema = StructType([f for f in docs.schema if not (last and f.name == "__text")])
    return map_arrow(docs, run, schema)


def _merged(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    if not a or not b:
        return a or b
    out: list[list[int]] = []
    for first, end in sorted(a + b):
        if out and first <= out[-1][1]:
            out[-1][1] = max(end, out[-1][1])
        else:
            out.append([first, end])
    return out


def places(text: bytes | None, runs: list[list[int]]) -> list[dict]:
    """Runs of words as code points of the original text, end exclusive."""
    if not runs:
        return []
    at = [m.span() for m in _PLACES.finditer(text.decode())]
    return [{"start": at[a][0], "stop": at[b - 1][1]} for a, b in runs]


def find(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None,
         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """row (the document's columns, or those to keep), n_words, n_hit, runs (hit words), spans (code points of the original), items (ids, sorted).

    Null and empty texts have no words; items without words are never found.  Repeated items count once, documents each on
    their own.  An item without id hits words but isn't listed.  Texts are read whole, of any length.
    """
    found = materialize(patterns(items, item_id, item_text))
    total = found.agg(F.sum(F.octet_length("window"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    kept = docs.columns if keep is None else keep
    table = docs.select(F.struct(*[docs[f"`{c}`"] for c in kept]).alias("row"), F.col(text_col).cast("string").cast("binary").alias("__text"),
                        F.array().cast("array<array<int>>").alias("__runs"), F.array().cast("array<string>").alias("__items"), F.lit(0).cast("long").alias("__n"), F.array().cast(SPANS).alias("__spans"))
    for k in range(blocks):
        part = found if blocks == 1 else found.filter(F.pmod(F.xxhash64("item", "window"), F.lit(blocks)) == k)
        rows = [(r.item, bytes(r.window)) for r in part.collect()]  # block_bytes at most, but for the spread of the hash
        table = _scan(table, rows, k == blocks - 1)
        if k < blocks - 1:
            table = materialize(table)
    hit = F.aggregate("__runs", F.lit(0), lambda a, r: a + r[1] - r[0])
    return table.select("row", F.col("__n").alias("n_words"), hit.cast("long").alias("n_hit"), F.col("__runs").alias("runs"), F.col("__spans").alias("spans"), F.col("__items").alias("items"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents in which no window occurs, with their columns."""
    return find(docs, items).filter("n_hit = 0").select("row.*")


def op12(spark, sf_dir: str) -> DataFrame:
    found = find(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH low AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS a, 'abcdefghijklmnopqrstuvwxyz' AS b),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), a, b), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, low),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), a, b), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, low),
p AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS g
      FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM i WHERE len(w) > 0)),
s AS (SELECT DISTINCT n FROM p),
t AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, s WHERE len(w) >= n)),
o AS (SELECT doc_id, k, t.n, item_id FROM t JOIN p ON t.n = p.n AND t.g = p.g),
h AS (SELECT doc_id, count(DISTINCT x)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS x FROM o) GROUP BY doc_id),
m AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM o) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN m ON d.doc_id = m.doc_id
"""
