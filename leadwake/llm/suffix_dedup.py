"""Operator 6: removal of repeated 100-byte strings by deep-shallow suffix sorting.

To bring equal strings together without shuffling every suffix, each 100-byte window is put under its minimizer, the
32-byte gram with the smallest hash inside it: equal windows have the same minimizer at the same place.  Consecutive
windows under one minimizer form a stretch.  Stretches with equal bytes are settled by order alone.  Where different
stretches share a minimizer, the suffixes that begin at the minimizer, and the reversed prefixes before it, are sorted:
multikey quicksort orders them to a shallow depth and blind tries order the groups that still agree there.  With both
orders and their common-prefix lengths, windows are equal exactly where they fall in the same range of both.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from leadwake.llm.common import load, map_arrow
from leadwake.session import materialize

WINDOW, GRAM = 100, 32
SPAN = WINDOW - GRAM + 1
#: Bytes scanned at once; stretches sorted at once; different stretches per minimizer beyond which windows are dealt singly.
CHUNK_BYTES, CHUNK_ROWS, CROWDED = 2 << 20, 20_000, 20_000
#: Depth of the multikey quicksort in bytes; blind tries take over below.
SHALLOW = 24

_RANDOM = np.random.default_rng(20240229)
_BYTE_A, _BYTE_B, _BYTE_C = (_RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(3))
_ODD = _RANDOM.integers(1, 1 << 62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict = {}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _powers(n: int, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """base to the i and its inverse modulo 2^64, for i below n at least."""
    have = _POWERS.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        out = []
        for b in (base, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS[int(base)] = have = tuple(out)
    return have


class _Ranges:
    """Hashes of any byte range, independent of where it lies."""

    def __init__(self, data: np.ndarray, table: np.ndarray, base: np.uint64):
        power, self.inverse = _powers(len(data) + 1, base)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(table[data] * power[:len(data)], dtype=np.uint64)))

    def hash(self, start: np.ndarray, length) -> np.ndarray:
        return _mix((self.sums[start + length] - self.sums[start]) * self.inverse[start] + np.uint64(1))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    h, width = _BYTE_A[data], 1
    for k in range(GRAM.bit_length() - 1):
        h = h[:-width] * _ODD[k] + h[width:]
        width *= 2
    return _mix(h)


def stretches(data: np.ndarray, ends: np.ndarray):
    """Stretches of texts laid end to end: (text, start in the text, number of windows, minimizer's place, its hash, hash of all bytes)."""
    starts = np.concatenate(([0], ends[:-1]))
    count = len(data) - WINDOW + 1
    if count <= 0:
        return None
    grams = _gram_hashes(data)
    shift = np.uint64(max(24, len(data).bit_length()))
    least = (grams >> shift << shift) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while width * 2 <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < SPAN:
        least = np.minimum(least[:width - SPAN], least[SPAN - width:])
    place = (least & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64)
    edge = np.zeros(count + 1, np.int64)  # the last 99 starts of a text hold no window
    off, on = np.minimum(np.maximum(starts, ends - WINDOW + 1), count), np.minimum(ends, count)
    np.add.at(edge, off, 1)
    np.add.at(edge, on, -1)
    valid = np.cumsum(edge)[:count] == 0
    begin = valid.copy()
    begin[1:] &= ~valid[:-1] | (place[1:] != place[:-1])
    stop = valid.copy()
    stop[:-1] &= ~valid[1:] | (place[1:] != place[:-1])
    lo, hi = np.flatnonzero(begin), np.flatnonzero(stop)
    if not len(lo):
        return None
    n, p = hi - lo + 1, place[lo]
    text = np.searchsorted(ends, lo, side="right")
    return text, lo - starts[text], n, p - lo, grams[p], _Ranges(data, _BYTE_B, _ODD[6]).hash(lo, n + WINDOW - 1)


def _pack(tag, start, n=0, d=0):
    """One number that sorts by tag and start: 15 bits of tag, 32 of start, 8 each of windows and the minimizer's distance."""
    return (np.asarray(tag, np.int64) << 48) | (np.asarray(start, np.int64) << 16) | (np.asarray(n, np.int64) << 8) | np.asarray(d, np.int64)


def _scan(batches):
    """Rows (m, sh, doc, p, kind): kind 0 a stretch that is the first of its bytes in the chunk; kind 1 a run of later ones, its length in sh."""
    held, size = [], 0

    def flush():
        docs = np.array([d for d, _, _ in held], np.int64)
        tags = np.array([t for _, t, _ in held], np.int64)
        data = np.frombuffer(b"".join(x for _, _, x in held), np.uint8)
        found = stretches(data, np.cumsum([len(x) for _, _, x in held]))
        if found is None:
            return
        text, lo, n, d, m, sh = found
        m, sh = m.astype(np.int64), sh.astype(np.int64)
        doc, p = docs[text], _pack(tags[text], lo, n, d)
        order = np.lexsort((p, doc, sh, m))
        same = np.zeros(len(order), bool)
        same[1:] = (m[order][1:] == m[order][:-1]) & (sh[order][1:] == sh[order][:-1])
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        first = order[head]
        later = np.zeros(len(order), bool)
        later[order] = same & ((doc[order] != doc[first]) | (p[order] != p[first]))
        drop = np.zeros(len(order), bool)
        drop[order] = same & ~later[order]  # the same row given twice
        new = np.flatnonzero(~later & ~drop)
        yield pa.RecordBatch.from_pydict({"m": m[new], "sh": sh[new], "doc": doc[new], "p": p[new], "kind": np.zeros(len(new), np.int8)})
        k = np.flatnonzero(later)
        if len(k):
            joined = np.zeros(len(k), bool)  # goes on where the one before ended
            joined[1:] = (text[k][1:] == text[k][:-1]) & (lo[k][1:] == (lo + n)[k][:-1])
            run = np.flatnonzero(~joined)
            length = np.add.reduceat(n[k], run)
            key = _mix(doc[k][run].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"m": key, "sh": length.astype(np.int64), "doc": doc[k][run], "p": _pack(tags[text[k]][run], lo[k][run]), "kind": np.ones(len(run), np.int8)})

    for b in batches:
        for doc, tag, text in zip(*(c.to_pylist() for c in b.columns)):
            raw = text.encode()
            if len(raw) >= WINDOW:
                held.append((doc, tag, raw))
                size += len(raw)
                if size >= CHUNK_BYTES:
                    yield from flush()
                    held, size = [], 0
    if held:
        yield from flush()


def _quicksort_words(words: np.ndarray, order: np.ndarray, group: np.ndarray, active: np.ndarray) -> None:
    """One digit of multikey quicksort for all groups at once: each round splits every unfinished group in three by its pivot.

    ``order`` lists rows, ``group`` the first place of each place's group; both are changed for the places in ``active``.
    """
    while len(active):
        start = group[active]
        size = np.bincount(np.searchsorted(active, start), minlength=len(active))[np.searchsorted(active, start)]
        w = words[order[active]]
        pivot = words[order[start + size // 2]]
        side = (w > pivot).astype(np.int8) - (w < pivot)
        turn = np.lexsort((side, start))
        order[active] = order[active][turn]
        side = side[turn]
        fresh = np.ones(len(active), bool)
        fresh[1:] = (start[1:] != start[:-1]) | (side[1:] != side[:-1])
        first = active[np.maximum.accumulate(np.where(fresh, np.arange(len(active)), 0))]
        group[active] = first
        many = np.bincount(np.searchsorted(active, first), minlength=len(active))[np.searchsorted(active, first)] > 1
        active = active[(side != 0) & many]


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix of two strings of equal length."""
    differ = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return len(a) - (differ.bit_length() + 7) // 8


def blind_trie(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """The order of strings of equal length, and the common prefix of each with the one before it.

    Inner nodes know only a depth and the byte on each branch.  A string runs down blindly to any leaf, one comparison with
    that leaf gives the depth where it must branch off, and a second descent puts it there.
    """
    root = [0]  # a leaf is a list of equal strings; a node is (depth, {byte: child})
    whole = len(strings[0])
    for k in range(1, len(strings)):
        s, node = strings[k], root
        while type(node) is tuple:
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        depth = _common(s, strings[node[0]])
        if depth == whole:
            node.append(k)
            continue
        parent, node = None, root
        while type(node) is tuple and node[0] < depth:
            parent, node = node, node[1][s[node[0]]]
        if type(node) is tuple and node[0] == depth:
            node[1][s[depth]] = [k]
            continue
        below = node
        while type(below) is tuple:
            below = next(iter(below[1].values()))
        fork = (depth, {strings[below[0]][depth]: node, s[depth]: [k]})
        if parent is None:
            root = fork
        else:
            parent[1][s[parent[0]]] = fork
    order, shared, stack = [], [], [(root, 0)]
    while stack:
        node, depth = stack.pop()
        if type(node) is tuple:
            children = [node[1][b] for b in sorted(node[1])]
            stack += [(c, node[0]) for c in reversed(children[1:])] + [(children[0], depth)]
        else:
            order += node
            shared += [depth] + [whole] * (len(node) - 1)
    return order, shared


def deep_shallow(rows: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort byte rows inside each segment (segments are contiguous): the order, and the common prefix with the row before, -1 at a segment's start."""
    n, width = rows.shape
    order = np.arange(n)
    head = np.ones(n, bool)
    head[1:] = segment[1:] != segment[:-1]
    group = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    shared = np.full(n, -1, np.int64)
    for depth in range(0, min(SHALLOW, width), 8):
        size = np.bincount(group, minlength=n)[group]
        active = np.flatnonzero(size > 1)
        if not len(active):
            break
        block = np.zeros((n, 8), np.uint8)
        block[:, :min(8, width - depth)] = rows[:, depth:depth + 8]
        words = block.view(">u8").ravel().astype(np.uint64)
        before = group.copy()
        _quicksort_words(words, order, group, active)
        split = np.flatnonzero((group == np.arange(n)) & (before != np.arange(n)))  # a new group inside an old one
        differ = words[order[split]] ^ words[order[split - 1]]
        lead = np.zeros(len(split), np.int64)
        for k in range(1, 8):
            lead += (differ >> np.uint64(64 - 8 * k)) == 0
        shared[split] = depth + lead
    size = np.bincount(group, minlength=n)
    for start in np.flatnonzero(size > 1):
        at = order[start:start + size[start]]
        turn, common = blind_trie([rows[k].tobytes() for k in at])
        order[start:start + len(at)] = at[turn]
        shared[start + 1:start + len(at)] = common[1:]
    return order, shared


def _settle(m, doc, p, content):
    """Runs (doc, p of the start, length) of windows that also begin earlier, among stretches sorted by minimizer.

    A row that is given again, of a document whose row repeats, counts once.
    """
    first: dict = {}
    for k, key in enumerate(zip(m.tolist(), doc.tolist(), p.tolist(), content)):
        first.setdefault(key, k)
    if len(first) < len(m):
        kept = np.fromiter(first.values(), np.int64)
        m, doc, p, content = m[kept], doc[kept], p[kept], [content[k] for k in kept]
    tag, lo, n, d0 = p >> 48, p >> 16 & 0xFFFFFFFF, p >> 8 & 0xFF, p & 0xFF
    right, left = np.zeros((len(m), WINDOW), np.uint8), np.zeros((len(m), SPAN - 1), np.uint8)
    for k, c in enumerate(content):
        raw, d = np.frombuffer(c, np.uint8), d0[k]
        right[k, :len(raw) - d] = raw[d:d + WINDOW]
        left[k, :d] = raw[:d][::-1]
    age = np.lexsort((lo + d0, tag, doc))  # oldest first
    ranges = []
    for rows in (right, left):
        order, shared = deep_shallow(rows, m)
        ranges.append((order, shared))
    again = np.zeros((len(m), SPAN), bool)  # by place of the start in the stretch
    for d in range(SPAN):
        mine = age[(d <= d0[age]) & (d > d0[age] - n[age])]
        if len(mine) < 2:
            continue
        ids = []
        for (order, shared), depth in zip(ranges, (WINDOW - d, d)):
            number = np.empty(len(m), np.int64)
            number[order] = np.cumsum(shared < depth)
            ids.append(number[mine])
        _, first = np.unique(ids[0] * (len(m) + 1) + ids[1], return_index=True)
        later = np.ones(len(mine), bool)
        later[first] = False
        mine = mine[later]
        again[mine, d0[mine] - d] = True
    flat = np.zeros((len(m), SPAN + 2), np.int8)
    flat[:, 1:-1] = again
    step = np.diff(flat, axis=1)
    row, start = np.nonzero(step == 1)
    _, stop = np.nonzero(step == -1)
    return doc[row], _pack(tag[row], lo[row] + start), (stop - start).astype(np.int64)


def _resolve(batches):
    """Take whole minimizers together, about CHUNK_ROWS stretches at a time; rows come sorted by minimizer."""
    parts, size = [], 0

    def settle(table):
        doc, p, length = _settle(table["m"].to_numpy(), table["doc"].to_numpy(), table["p"].to_numpy(), table["content"].to_pylist())
        return pa.RecordBatch.from_pydict({"doc": doc, "p": p, "length": length})

    for b in batches:
        parts.append(b)
        size += len(b)
        if size >= CHUNK_ROWS:
            table = pa.Table.from_batches(parts)
            m = table["m"].to_numpy()
            cut = int(np.searchsorted(m, m[-1]))
            if cut:
                yield settle(table.slice(0, cut))
                parts, size = table.slice(cut).to_batches(), len(m) - cut
    if size:
        yield settle(pa.Table.from_batches(parts))


def _cut_out(texts: DataFrame, stretches_: DataFrame) -> DataFrame:
    """(m, doc, p, content, kinds) of stretches, from the texts."""

    def run(batches):
        for b in batches:
            out = {"m": [], "doc": [], "p": [], "content": [], "kinds": []}
            for doc, text, wanted in zip(*(c.to_pylist() for c in b.columns)):
                raw = text.encode()
                for w in wanted:
                    lo = w["p"] >> 16 & 0xFFFFFFFF
                    row = (w["m"], doc, w["p"], raw[lo:lo + (w["p"] >> 8 & 0xFF) + WINDOW - 1], w["kinds"])
                    for name, value in zip(out, row):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict({name: pa.array(v, pa.binary() if name == "content" else pa.int64()) for name, v in out.items()})

    per_doc = stretches_.groupBy("doc", F.shiftright("p", 48).alias("tag")).agg(F.collect_list(F.struct("m", "p", "kinds")).alias("wanted"))
    return map_arrow(texts.join(per_doc, ["doc", "tag"]).select("doc", "text", "wanted"), run, "m long, doc long, p long, content binary, kinds long")


def _singly(crowded: DataFrame) -> DataFrame:
    """Runs of one window each, for minimizers under which very many different stretches lie: windows meet by two hashes and
    the earliest is found by a map-side combined minimum."""

    def run(batches):
        for b in batches:
            doc, p, content = b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3).to_pylist()
            if not content:
                continue
            data = np.frombuffer(b"".join(content), np.uint8)
            base = np.concatenate(([0], np.cumsum([len(c) for c in content])[:-1]))
            n = p >> 8 & 0xFF
            row = np.repeat(np.arange(len(p)), n)
            inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            at = base[row] + inner
            one, two = (_Ranges(data, table, odd).hash(at, WINDOW).astype(np.int64) for table, odd in ((_BYTE_B, _ODD[6]), (_BYTE_C, _ODD[7])))
            yield pa.RecordBatch.from_pydict({"one": one, "two": two, "doc": doc[row], "p": _pack(p[row] >> 48, (p[row] >> 16 & 0xFFFFFFFF) + inner)})

    windows = materialize(map_arrow(crowded, run, "one long, two long, doc long, p long"))
    first = windows.groupBy("one", "two").agg(F.min(F.struct("doc", "p")).alias("first"))
    return windows.join(first, ["one", "two"]).filter(F.struct("doc", "p") > F.col("first")).select("doc", "p", F.lit(1).cast("long").alias("length"))


def _release(spark) -> None:
    """Let Spark drop the shuffle files of finished phases now instead of at the driver's next collection."""
    spark.sparkContext._jvm.java.lang.System.gc()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) of every row.

    A null text counts as empty; texts under 100 bytes lose nothing.  A null id comes after all others.  Rows that repeat an
    id and its text are one document; rows with one id and different texts follow each other in the order of a hash of the
    text.  Other columns are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("doc"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    docs = docs.withColumn("tag", F.pmod(F.xxhash64("text"), F.lit(1 << 15)).cast("long"))
    texts = docs.select("doc", "tag", "text").filter(F.octet_length("text") >= WINDOW)
    rows = map_arrow(texts, _scan, "m long, sh long, doc long, p long, kind byte").repartition("m")  # serves both windows
    same, shared = W.partitionBy("m", "sh").orderBy("doc", "p"), W.partitionBy("m")
    rows = rows.withColumns({"place": F.row_number().over(same), "rank": F.rank().over(same)})
    rows = rows.withColumns({"low": F.min("sh").over(shared), "high": F.max("sh").over(shared), "kinds": F.sum((F.col("place") == 1).cast("long")).over(shared)})
    open_ = (F.col("kind") == 0) & (F.col("place") == 1) & (F.col("low") < F.col("high"))
    later = (F.col("kind") == 1) | (F.col("rank") > 1)
    rows = materialize(rows.filter(open_ | later).select("m", "sh", "doc", "p", "kind", "kinds", later.alias("later")))
    _release(spark)
    settled = rows.filter("later").select("doc", "p", F.when(F.col("kind") == 1, F.col("sh")).otherwise(F.shiftright("p", 8).bitwiseAND(F.lit(255))).alias("length"))
    cut = materialize(_cut_out(texts, rows.filter("not later")))
    _release(spark)
    alone = cut.filter(F.col("kinds") <= CROWDED).select("m", "doc", "p", "content").repartition("m").sortWithinPartitions("m")
    found = settled.union(materialize(map_arrow(alone, _resolve, "doc long, p long, length long")))
    found = found.union(materialize(_singly(cut.filter(F.col("kinds") > CROWDED).select("m", "doc", "p", "content"))))
    _release(spark)
    start = F.shiftright("p", 16).bitwiseAND(F.lit(0xFFFFFFFF))
    per_doc = found.groupBy("doc", F.shiftright("p", 48).alias("tag")).agg(F.collect_list(F.struct(start.alias("a"), "length")).alias("runs"))

    def remove(batches):
        for b in batches:
            sizes, gone, spans, kept = [], [], [], []
            for body, runs in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw = body.encode()
                cuts: list[list[int]] = []
                for a, z in sorted((r["a"], r["a"] + r["length"] + WINDOW - 1) for r in runs or []):
                    if cuts and a <= cuts[-1][1]:
                        cuts[-1][1] = max(cuts[-1][1], z)
                    else:
                        cuts.append([a, z])
                edges = [0, *(x for c in cuts for x in c), len(raw)]
                sizes.append(len(raw))
                gone.append(sum(z - a for a, z in cuts))
                spans.append(len(cuts))
                kept.append(b"".join(raw[edges[k]:edges[k + 1]] for k in range(0, len(edges), 2)))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(gone, pa.int64()),
                                              "n_spans": pa.array(spans, pa.int64()), "kept": pa.array(kept, pa.binary())})

    return map_arrow(docs.join(per_doc, ["doc", "tag"], "left").select("doc_id", "text", "runs"), remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op6(spark, sf_dir: str) -> DataFrame:
    got = remove_repeats(load(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
