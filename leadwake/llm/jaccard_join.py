"""Operator 8: Jaccard join of documents on word shingles by grouped prefixes.

Documents with equal shingle sets are one class, classes with equal size and prefix one group.  Shingles have one global
order: frequent ones (found by a sketch of fixed size) last, others by hash.  A prefix is long enough that two documents
over the threshold share at least ``surplus`` tokens of it, so a group with fewer shared tokens takes no part.  Group pairs
are filtered by size and by the number of shared prefix tokens, then expanded to members and verified on whole sets.

Only components are asked for, so first every group is verified against one leader, and then exactly those pairs that the
components found so far leave open.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from leadwake.llm.common import components, load, map_arrow
from leadwake.session import materialize

WORDS, PERCENT = 5, 80
#: Slots of the frequency sketch; the classes made of it are one byte each.
SLOTS = 1 << 22
#: Every so many shingles of a document add one to what a prefix must share.
STEP = 20
MEMO_SIZE = 150_000
#: Bits by which two prefixes are compared before their shared tokens are counted.
BITS = 512
#: Bits of a sketch of ids, 8 MB whatever the number of ids; the more of them, the more rows pass in vain.
ID_BITS = 1 << 26


_SPACES = re.compile(rb"[\x20\x09-\x0D]")
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A word's hash is the sum of a number per byte times a power of STEP_UP per place, modulo 2^64.
_LETTERS = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP_UP = 0x9E3779B97F4A7C15
_STEP_DOWN = pow(_STEP_UP, -1, 1 << 64)
#: Bytes of a text that are hashed at once; a segment ends where a word does.
SEGMENT = 1 << 20
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers of base, and what doubling them has already given."""
    known = _POWERS.get(base, np.ones(1, np.uint64))
    while len(known) < n:
        known = np.concatenate([known, known * np.uint64(pow(base, len(known), 1 << 64))])
    _POWERS[base] = known if len(known) <= 4 * SEGMENT else known[:SEGMENT]
    return known


def _segment(raw: bytes) -> np.ndarray:
    """Hashes of the words of some bytes, by running sums: no loop over words."""
    b = np.frombuffer(raw, np.uint8)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_LETTERS[b] * _powers(_STEP_UP, len(b))[:len(b)], out=sums[1:])
    edges = np.flatnonzero(np.diff(_IS_SPACE[b].view(np.int8), prepend=1, append=1))
    first, end = edges[::2], edges[1::2]
    return _mix((sums[end] - sums[first]) * _powers(_STEP_DOWN, len(b))[first])


def word_hashes(text: str) -> np.ndarray:
    raw = text.encode().lower()  # bytes: only A-Z change, only ASCII white space separates
    out, start = [], 0
    while start < len(raw):
        cut = _SPACES.search(raw, start + SEGMENT) if len(raw) - start > SEGMENT else None
        end = cut.start() if cut else len(raw)
        out.append(_segment(raw[start:end]))
        start = end
    return np.concatenate(out) if len(out) > 1 else out[0] if out else np.zeros(0, np.uint64)


def distinct(values: np.ndarray) -> np.ndarray:
    """Ascending and without repeats; a sort is faster here than a hash table."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the distinct five-word runs, ascending; of all words where there are fewer; none without words."""
    h = word_hashes(text) if text else np.zeros(0, np.uint64)
    if not len(h):
        return h
    if len(h) < WORDS:
        return _mix(np.array([(h * _ODD[:len(h)]).sum() + np.uint64(len(h))], np.uint64))
    total = np.zeros(len(h) - WORDS + 1, np.uint64)
    for k in range(WORDS):
        total += h[k:len(h) - WORDS + 1 + k] * _ODD[k]
    return distinct(_mix(total))


def surplus(n):
    return n // STEP + 1


def prefix_length(n: int) -> int:
    return min(n, n - -(-PERCENT * n // 100) + surplus(n))


def frequent(docs: DataFrame) -> np.ndarray:
    """A byte per sketch slot: 0, or four times the binary logarithm of its count where tasks found it well above the mean.

    The order made of it need not be exact, only the same everywhere.
    """

    def run(batches):
        counts, total = np.zeros(SLOTS, np.uint32), 0
        for b in batches:
            found = [shingles(t) for t in b.column(0).to_pylist()]
            found = np.concatenate(found) if found else np.zeros(0, np.uint64)
            slots = np.sort((found % np.uint64(SLOTS)).astype(np.int64))
            heads = np.flatnonzero(np.diff(slots, prepend=-1))
            counts[slots[heads]] += np.diff(heads, append=len(slots)).astype(np.uint32)
            total += len(found)
        high = np.flatnonzero(counts >= 8 + 4 * total / SLOTS)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(high.astype(np.int32)), "n": pa.array(counts[high].astype(np.int64))})

    got = map_arrow(docs.select("text"), run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # SLOTS rows at most
    classes = np.zeros(SLOTS, np.uint8)
    classes[got["slot"].to_numpy()] = np.minimum(255, 4 * np.log2(np.maximum(got["n"].to_numpy(), 2))).astype(np.uint8)
    return classes


def _signatures(docs: DataFrame, classes: np.ndarray) -> DataFrame:
    """doc_id, n, key of the set and mark (a hash of size and prefix)."""
    sent = docs.sparkSession.sparkContext.broadcast(classes)  # SLOTS bytes

    def run(batches):
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                s = shingles(t)
                rows.append((len(s), hashlib.blake2b(s.astype("<u8").tobytes(), digest_size=16).digest(), _mark(_prefix(s, sent.value), len(s))))
            n, key, mark = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "n": pa.array(n, pa.int64()), "key": pa.array(key, pa.binary()), "mark": pa.array(mark, pa.int64())})

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n long, key binary, mark long")


def _prefixes(docs: DataFrame, classes: np.ndarray) -> DataFrame:
    """gid (the mark), n and tokens of the prefix.  A task gives them with the first document of a mark only, so many copies
    cost little.  Made from the texts again: stored, the tokens would take more room than all other tables here."""
    sent = docs.sparkSession.sparkContext.broadcast(classes)  # SLOTS bytes

    def run(batches):
        given: set[int] = set()
        for b in batches:
            rows = []
            for t in b.column(0).to_pylist():
                s = shingles(t)
                head = _prefix(s, sent.value)
                mark = _mark(head, len(s))
                if len(s) and mark not in given:
                    rows.append((mark, len(s), head.astype(np.int64)))
                    if len(given) >= MEMO_SIZE:
                        given.clear()
                    given.add(mark)
            mark, n, head = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_pydict({"gid": pa.array(mark, pa.int64()), "n": pa.array(n, pa.int64()), "prefix": pa.array(head, pa.list_(pa.int64()))})

    return map_arrow(docs.filter("doc_id is not null").select("text"), run, "gid long, n long, prefix array<long>")


def _prefix(s: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the global order; a token holds its frequency class in the top byte."""
    order = np.sort((classes[(s % np.uint64(SLOTS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8)))
    return order[:prefix_length(len(s))].astype("<u8")


def _mark(head: np.ndarray, n: int) -> int:
    return xxhash.xxh3_64_intdigest(head.tobytes(), seed=n) - (1 << 63)


def _places(ids: np.ndarray) -> np.ndarray:
    return (_mix(ids.astype(np.int64).view(np.uint64) * _ODD[0]) % np.uint64(ID_BITS)).astype(np.int64)


def _id_sketch(ids: DataFrame) -> np.ndarray:
    """The places of some ids in a row of ``ID_BITS`` bits, in bytes."""

    def run(batches):
        for b in batches:
            place = np.unique(_places(b.column(0).to_numpy(zero_copy_only=False)))
            word, first = np.unique(place >> 3, return_index=True)
            bits = np.bitwise_or.reduceat(1 << (place & 7), first) if len(place) else place
            yield pa.RecordBatch.from_pydict({"word": pa.array(word.astype(np.int32)), "bits": pa.array(bits.astype(np.int32))})

    got = map_arrow(ids, run, "word int, bits int").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # ID_BITS / 8 rows at most
    sketch = np.zeros(ID_BITS // 8, np.uint8)
    sketch[got["word"].to_numpy()] = got["bits"].to_numpy().astype(np.uint8)
    return sketch


def _is_in(ids: pa.Array, sketch: np.ndarray) -> np.ndarray:
    place = _places(ids.fill_null(0).to_numpy(zero_copy_only=False))
    return ((sketch[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0) & ids.is_valid().to_numpy(zero_copy_only=False)


def _likely(rows: DataFrame, sketch: np.ndarray, inside: bool = True) -> DataFrame:
    """All rows whose first column is among the sketch's ids, and few others: what a join would drop isn't dealt out for it.
    Or, not ``inside``, the rest: none of its rows has such an id."""
    sent = rows.sparkSession.sparkContext.broadcast(sketch)  # ID_BITS bits

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(_is_in(b.column(0), sent.value) == inside))

    return map_arrow(rows, run, rows.schema)


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose doc_id isn't in ``gone`` (doc_id); those without an id stay.  Only rows whose id may be there are dealt out."""
    sketch = _id_sketch(gone)
    wide = rows.select("doc_id", *[c for c in rows.columns if c != "doc_id"])
    return _likely(wide, sketch, inside=False).unionByName(_likely(wide, sketch).join(gone, "doc_id", "left_anti")).select(*rows.columns)


def _need(n: Column) -> Column:
    """Tokens that a prefix of a set of n shares with that of any set over the threshold."""
    return F.floor(F.ceil(n * PERCENT / 100) / STEP) + 1


def _sizes_fit(a: Column, b: Column) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def _repeated(tokens: DataFrame) -> DataFrame:
    """One row per token and group, of tokens that occur in two groups or more; frequent tokens are all kept, so only short
    runs of rows meet in a window."""
    hot = F.shiftrightunsigned("token", 56) > 0
    dealt = tokens.filter(~hot).repartition("token").groupBy("token", "gid").agg(F.first("n").alias("n"))  # no second exchange
    rest = dealt.withColumn("c", F.count("*").over(W.partitionBy("token"))).filter("c > 1").drop("c")
    return rest.unionByName(tokens.filter(hot).distinct())


def verify(both: DataFrame) -> DataFrame:
    """Pairs (a, b) of ids with the sizes of the intersection and union of their shingles (sa, sb, as binary)."""

    def run(batches):
        for b in batches:
            shared, union = [], []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                shared.append(int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0)
                union.append(len(x) + len(y) - shared[-1])
            yield pa.RecordBatch.from_pydict({"a": b.column(0), "b": b.column(1), "shared": pa.array(shared, pa.int64()), "whole": pa.array(union, pa.int64())})

    return map_arrow(both.select("a", "b", "sa", "sb"), run, "a long, b long, shared long, whole long")


def linked(verified: DataFrame) -> DataFrame:
    return verified.filter(F.col("shared") * 100 >= F.col("whole") * PERCENT).select("a", "b")


def _shared_counts(sets: DataFrame, often: np.ndarray, ids: np.ndarray) -> DataFrame:
    """(id, reach): how many of a set's shingles occur, at most, in another of the sets; frequent shingles count without a look.
    Sets are those of the sketch's ids; the few others that pass, and shingles that look alike, can only raise a count."""
    sent = sets.sparkSession.sparkContext.broadcast(often)  # SLOTS bytes
    among = sets.sparkSession.sparkContext.broadcast(ids)  # ID_BITS bits

    def run(batches):
        for b in batches:
            b = b.filter(pa.array(_is_in(b.column(0), among.value)))
            for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = np.frombuffer(raw, "<u8")
                hot = sent.value[(s % np.uint64(SLOTS)).astype(np.int64)] > 0
                rest = (s[~hot] >> np.uint64(24)).astype(np.int64)  # narrow rows: equal where shingles are, by chance where not
                yield pa.RecordBatch.from_pydict({"id": np.full(len(rest) + 1, i), "token": pa.array(np.append(rest, 0), mask=np.append(np.zeros(len(rest), bool), True)),
                                                  "hot": np.append(np.zeros(len(rest), np.int64), int(hot.sum()))})

    tokens = map_arrow(sets.select("id", "shingles"), run, "id long, token long, hot long")
    rare = tokens.filter("token is not null").withColumn("c", F.count("*").over(W.partitionBy("token"))).filter("c > 1").groupBy("id").agg(F.count("*").alias("n"))
    hot = tokens.filter("token is null").groupBy("id").agg(F.max("hot").alias("n"))
    return rare.union(hot).groupBy("id").agg(F.sum("n").alias("reach"))


def _release(spark) -> None:
    """Let Spark drop the shuffle files of finished phases now instead of at the driver's next collection."""
    spark.sparkContext._jvm.java.lang.System.gc()


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    Rows with one id count as one document and link together.  A text without words has no shingles and is its own
    component.  A row without id gets no component.  Other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    often = frequent(docs)
    seen = materialize(_signatures(docs, often))
    classes = materialize(seen.filter("n > 0 and doc_id is not null").groupBy("key", "n", "mark").agg(F.min("doc_id").alias("id")))
    placed_rows = materialize(seen.select("doc_id", "n", "key").join(classes.select("key", "id"), "key", "left").select("doc_id", "n", "id"))
    twice = placed_rows.groupBy("doc_id").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high")
    one_id = placed_rows.join(twice, "doc_id").select(F.col("id").alias("a"), F.col("low").alias("b"))  # rows of one id
    members = materialize(classes.select("key", "n", "id", F.col("mark").alias("gid"), F.count("*").over(W.partitionBy("mark")).alias("members")))
    tokens = _prefixes(docs, often).select(F.explode("prefix").alias("token"), "gid", "n")
    rows = _repeated(tokens)
    # a group that shares too few tokens takes no part
    rows = rows.withColumn("c", F.count("*").over(W.partitionBy("gid"))).filter(F.col("c") >= _need(F.col("n")))
    rows = materialize(rows.select("token", "gid", "n", (F.col("c") / F.col("n")).alias("share")))
    _release(spark)
    inside = members.join(rows.select("gid").distinct(), "gid", "left_semi").unionByName(members.filter("members > 1")).distinct()
    wanted = materialize(inside.select("key", "id", "gid", "n"))

    # Every group against one leader: of the groups that share a token, the one with the largest share of repeated tokens.
    first = rows.groupBy("token").agg(F.max(F.struct("share", "gid", "n")).alias("top")).select("token", F.col("top.gid").alias("leader"), F.col("top.n").alias("m"))
    near = (rows.join(first, "token").filter((F.col("gid") != F.col("leader")) & _sizes_fit(F.col("n"), F.col("m")))
            .groupBy("gid", "leader").agg(F.count("*").alias("c")).groupBy("gid").agg(F.max(F.struct("c", "leader")).alias("top")).select("gid", F.col("top.leader").alias("leader")))
    heads = wanted.groupBy("gid").agg(F.min("id").alias("head"))
    star = materialize(near.join(heads, "gid").withColumnRenamed("head", "id").join(heads.select(F.col("gid").alias("leader"), F.col("head").alias("to")), "leader").select("id", "to")
                       .union(wanted.join(heads, "gid").filter("id <> head").select("id", F.col("head").alias("to"))))

    def whole(batches):
        for b in batches:
            sets = [shingles(t).astype("<u8").tobytes() for t in b.column(4).to_pylist()]
            same = pa.array([hashlib.blake2b(s, digest_size=16).digest() == k for s, k in zip(sets, b.column(1).to_pylist())])
            yield pa.RecordBatch.from_pydict({"id": b.column(0), "to": b.column(2), "target": b.column(3), "shingles": pa.array(sets, pa.binary())}).filter(same)

    # One plan at every size: ids and texts are dealt by id, never broadcast; of the texts hardly more than those asked for.
    asked = wanted.select("id", "key").join(star, "id", "left").join(star.select(F.col("to").alias("id"), F.lit(True).alias("target")).distinct(), "id", "left")
    texts = _likely(docs, _id_sketch(wanted.select("id"))).join(asked.hint("shuffle_hash"), F.col("id") == F.col("doc_id")).select("id", "key", "to", "target", "text")
    sets = materialize(map_arrow(texts, whole, "id long, to long, target boolean, shingles binary"))
    _release(spark)
    # A set already lies beside the id it is held against, so only sets meet here.
    ends = sets.filter("target").select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    tried = materialize(verify(sets.filter("to is not null").select(F.col("id").alias("a"), F.col("to").alias("b"), F.col("shingles").alias("sa")).join(ends, "b")))
    links = materialize(linked(tried).union(one_id))
    found = components(links)

    # What is still open: members of two components in groups that share enough tokens.
    placed = wanted.join(found, F.col("id") == F.col("node"), "left").select("id", "gid", "n", F.coalesce("root", "id").alias("root"))
    placed = materialize(placed)
    spread = placed.groupBy("gid").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    marked = rows.select("token", "gid", "n").join(spread, "gid")
    mixed = marked.groupBy("token").agg(F.min("low").alias("l"), F.max("high").alias("h")).filter("l < h").select("token")
    # What an open pair shares are such tokens only, so a group with too few of them is settled.
    group = W.partitionBy("gid")
    marked = marked.join(mixed, "token", "left_semi").withColumn("m", F.count("*").over(group)).filter(F.col("m") >= _need(F.col("n")))
    marked = materialize(marked.select("*", *[c.over(group).alias(name) for name, c in _bits(F.col("token")).items()]))
    # Only shingles that another open document has can be shared; most documents with changes of their own drop out here.
    unsettled = _id_sketch(placed.join(marked.select("gid").distinct(), "gid").select("id"))
    reach = placed.join(_shared_counts(sets, often, unsettled), "id").groupBy("gid").agg(F.max("reach").alias("reach"))
    marked = materialize(marked.join(reach, "gid").filter(F.col("reach") * 100 >= F.col("n") * PERCENT))
    x, y = marked.alias("x"), marked.alias("y")
    enough = F.least("x.reach", "y.reach") * (100 + PERCENT) >= (F.col("x.n") + F.col("y.n")) * PERCENT
    apart = (F.col("x.low") != F.col("y.high")) | (F.col("x.high") != F.col("y.low"))
    behind = F.greatest(_rest(F.col("x.n")), _rest(F.col("y.n")))
    due = F.ceil((F.col("x.n") + F.col("y.n")) * PERCENT / (100 + PERCENT))
    # Narrow rows meet at every token they share; what they share at most is bounded before, and counted after, the pair is made.
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.gid") < F.col("y.gid")) & _sizes_fit(F.col("x.n"), F.col("y.n")) & enough & apart & (_most_shared() + behind >= due))
    open_groups = (met.select(F.col("x.gid").alias("ga"), F.col("y.gid").alias("gb"), (due - behind).alias("least")).groupBy("ga", "gb", "least").agg(F.count("*").alias("c"))
                   .filter("c >= least").select("ga", "gb"))
    open_groups = open_groups.union(spread.filter("low < high").select(F.col("gid").alias("ga"), F.col("gid").alias("gb")))
    a, b = (placed.select(F.col("id").alias(i), F.col("gid").alias(g), F.col("root").alias(r)) for i, g, r in (("a", "ga", "ra"), ("b", "gb", "rb")))
    pairs = materialize(open_groups.join(a, "ga").join(b, "gb").filter("ra <> rb and (ga <> gb or a < b)").select("a", "b"))
    _release(spark)
    some = _likely(sets.select("id", "shingles"), _id_sketch(pairs.select("a").union(pairs.select("b"))))
    both = (pairs.join(some.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
            .join(some.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b"))
    more = materialize(linked(verify(both)))
    found = components(links.union(more))

    roots = placed_rows.join(found, F.col("id") == F.col("node"), "left")
    return roots.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "id", "doc_id")).alias("component_id"))


def _bits(token: Column) -> dict[str, Column]:
    """A group's tokens as ``BITS`` bits in longs: narrow, of one width whatever the length of the text."""
    at = F.pmod(token, F.lit(BITS)).cast("int")
    one = F.expr(f"shiftleft(1L, cast(pmod(token, {BITS}) as int) % 64)")
    return {f"bits{k}": F.bit_or(F.when(F.floor(at / 64) == k, one).otherwise(F.lit(0).cast("long"))) for k in range(BITS // 64)}


def _most_shared() -> Column:
    """No more tokens than these are in both of x and y: each bit that one of them lacks is a token of the other's alone."""
    alone = lambda a, b: sum((F.bit_count(F.col(f"{a}.bits{k}").bitwiseAND(F.bitwise_not(F.col(f"{b}.bits{k}")))) for k in range(BITS // 64)), F.lit(0))
    return F.least(F.col("x.m") - alone("x", "y"), F.col("y.m") - alone("y", "x"))


def _rest(n: Column) -> Column:
    """Tokens behind the prefix.  What two sets share beyond their prefixes lies behind the prefix that ends first."""
    return F.greatest(F.lit(0), F.ceil(n * PERCENT / 100) - _surplus(n))


def _surplus(n: Column) -> Column:
    return F.floor(n / STEP) + 1


def op8(spark, sf_dir: str) -> DataFrame:
    return join(load(spark, sf_dir, "documents"))
