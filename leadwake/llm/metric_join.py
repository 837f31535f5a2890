"""Operator 9: exact range join of vectors by cosine, partitioned by pivots.

Angles are a metric.  Each vector's home is the cell of its nearest pivot.  It is also sent to every cell that could hold a
vector within the range: the cell's members keep within known rings around the pivots, and the triangle inequality says
how far outside of a ring a neighbour can be; the hyperplane between two pivots gives a second bound.  Cells are then
joined independently, each home vector against all that came, so every link of a vector is found in its own home.

Large cells are cut into blocks by salt, so no task holds more than two blocks.  Equal vectors are one class with a weight.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leadwake.llm.common import components, load, map_arrow
from leadwake.session import materialize

COSINE = 0.9
#: Vectors per cell aimed at, pivots at most, pivots whose rings are kept, rows per block.
CELL, PIVOTS, RINGS, BLOCK = 4096, 1024, 64, 8192
#: Single-precision products are trusted when they are this far from the threshold, and checked in double otherwise.
MARGIN = 1e-4


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _usable(vectors: DataFrame) -> DataFrame:
    """(id, bytes, dim) of vectors without nulls, other than zero and finite: their doubles in one binary value."""

    def run(batches):
        for b in batches:
            out = []
            for k, v in enumerate(b.column(1).to_pylist()):
                x = None if not v or None in v else np.asarray(v, np.float64) + 0.0
                out.append(x.astype("<f8").tobytes() if x is not None and np.isfinite(x).all() and x.any() else None)
            kept = pa.array([o is not None for o in out])
            table = pa.RecordBatch.from_pydict({"id": b.column(0), "v": pa.array(out, pa.binary()), "dim": pa.array([len(o or b"") // 8 for o in out], pa.int32())})
            yield table.filter(kept)

    return map_arrow(vectors.filter("id is not null and v is not null"), run, "id long, v binary, dim int")


def _assign(rows: DataFrame, dim: int, pivots: np.ndarray) -> DataFrame:
    """id, v, home; and the angles to the pivots that have rings."""
    sent = rows.sparkSession.sparkContext.broadcast(pivots)  # PIVOTS vectors at most

    def run(batches):
        for b in batches:
            if len(b):
                cos = np.clip(_unit(_matrix(b.column(1), dim)) @ sent.value.T, -1, 1)
                ring = np.arccos(cos[:, :RINGS])
                yield pa.RecordBatch.from_pydict({"id": b.column(0), "w": b.column(2), "v": b.column(1), "home": pa.array(cos.argmax(axis=1).astype(np.int32)),
                                                  "ring": pa.array(list(ring), pa.list_(pa.float64()))})

    return map_arrow(rows.select("id", "v", "w").select("id", "v", "w"), run, "id long, w long, v binary, home int, ring array<double>")


def _replicate(rows: DataFrame, dim: int, pivots: np.ndarray, low: np.ndarray, high: np.ndarray, sizes: np.ndarray, cosine: float) -> DataFrame:
    """(cell, hb, cb, role, id, w, v): role 0 for home vectors, once per block of comers, role 1 for comers, once per home block."""
    reach = math.acos(cosine) + 1e-9
    chord = math.sqrt(2 - 2 * cosine) + 1e-9
    apart = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 1e-18))
    sent = rows.sparkSession.sparkContext.broadcast((pivots, low, high, apart, sizes))  # PIVOTS times (dim + RINGS + PIVOTS) numbers at most

    def comers(batches):
        for b in batches:
            if not len(b):
                continue
            points, least, most, gap, members = sent.value
            unit = _unit(_matrix(b.column(2), dim))
            cos, home = unit @ points.T, b.column(3).to_numpy()
            own = cos[np.arange(len(home)), home]
            ring = np.arccos(np.clip(cos[:, :least.shape[1]], -1, 1))
            near = (own[:, None] - cos) <= chord * gap[home]
            near &= members[None, :] > 0
            for k in range(ring.shape[1]):
                near &= (ring[:, k:k + 1] >= least[None, :, k] - reach) & (ring[:, k:k + 1] <= most[None, :, k] + reach)
            near[np.arange(len(home)), home] = True
            for part in np.array_split(np.arange(len(home)), max(1, len(home) * near.shape[1] // 50_000)):
                row, cell = np.nonzero(near[part])
                row = part[row]
                take = pa.array(row)
                yield pa.RecordBatch.from_pydict({"cell": pa.array(cell.astype(np.int32)), "id": b.column(0).take(take), "w": b.column(1).take(take), "v": b.column(2).take(take),
                                                  "home": pa.array(cell == home[row])})

    return map_arrow(rows.select("id", "w", "v", "home"), comers, "cell int, id long, w long, v binary, home boolean")


def _labels(size: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> None:
    """Lower each node's label to the smallest of its neighbours' until nothing changes."""
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label[:] = label[label]
        if (label == before).all():
            return


def _join_block(dim: int, cosine: float):
    def run(table: pa.Table) -> pa.Table:
        role = table["role"].to_numpy()
        ids, weights = table["id"].to_numpy(), table["w"].to_numpy()
        exact = _unit(_matrix(table["v"].combine_chunks(), dim))
        quick = exact.astype(np.float32)
        mine, all_ = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        # a label is the place of a row in the order of ids, the same for both roles of one vector
        known, place = np.unique(ids, return_inverse=True)
        label, links = np.arange(len(known)), np.zeros(len(known), np.int64)
        step = max(1, 4_000_000 // max(len(all_), 1))
        for k in range(0, len(mine), step):
            part = mine[k:k + step]
            cos = quick[part] @ quick[all_].T
            r, c = np.nonzero(cos >= cosine - MARGIN)
            close = np.abs(cos[r, c] - cosine) <= MARGIN
            r, c = part[r], all_[c]
            good = ids[r] != ids[c]
            test = np.flatnonzero(close & good)
            good[test] = np.einsum("ij,ij->i", exact[r[test]], exact[c[test]]) >= cosine
            r, c = r[good], c[good]
            np.add.at(links, place[r], weights[c])
            _labels(len(known), place[r], place[c], label)
        counted, tied = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(known)))
        return pa.table({"a": pa.array(np.concatenate([known[counted], known[tied]])), "b": pa.array([None] * len(counted) + known[label[tied]].tolist(), pa.int64()),
                         "links": pa.array(np.concatenate([links[counted], np.zeros(len(tied), np.int64)]))})

    return run


def join(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    A null id, and a vector that is null, empty, zero or holds nulls or numbers that aren't finite, links with nothing; so
    does one of another length than most.  Equal vectors link with each other, repeated rows too.  Other columns are not
    read.  A row without id has no component and isn't kept.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    usable = materialize(_usable(rows))
    dims = usable.groupBy("dim").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "dim").first()
    if dims is None:
        return rows.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    dim = dims.dim
    usable = usable.filter(F.col("dim") == dim)
    distinct = materialize(usable.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("w")))
    n = distinct.count()
    k = max(1, min(PIVOTS, -(-n // CELL)))
    chosen = distinct.orderBy(F.xxhash64("v"), "v").limit(k).toArrow()  # PIVOTS vectors at most
    pivots = _unit(_matrix(chosen["v"].combine_chunks(), dim))
    placed = materialize(_assign(distinct, dim, pivots))
    # PIVOTS times RINGS rows at most
    rings = placed.select("home", F.posexplode("ring").alias("k", "r")).groupBy("home", "k").agg(F.min("r").alias("low"), F.max("r").alias("high"), F.count("*").alias("c")).toArrow()
    low, high, sizes = np.full((k, min(k, RINGS)), np.inf), np.full((k, min(k, RINGS)), -np.inf), np.zeros(k, np.int64)
    cell, ring = rings["home"].to_numpy(), rings["k"].to_numpy()
    low[cell, ring], high[cell, ring], sizes[cell] = rings["low"].to_numpy(), rings["high"].to_numpy(), rings["c"].to_numpy()
    sent = materialize(_replicate(placed, dim, pivots, low, high, sizes, cosine))
    load_ = sent.groupBy("cell").agg(F.count("*").alias("came"), F.sum(F.col("home").cast("long")).alias("here"))
    blocks = load_.select("cell", F.ceil(F.col("here") / BLOCK).cast("int").alias("hbs"), F.ceil(F.col("came") / BLOCK).cast("int").alias("cbs"))
    dealt = sent.join(F.broadcast(blocks), "cell")  # PIVOTS rows at most
    salt = lambda count: F.pmod(F.xxhash64("id"), F.col(count)).cast("int")
    mine = dealt.filter("home").select("cell", salt("hbs").alias("hb"), F.explode(F.sequence(F.lit(0), F.col("cbs") - 1)).alias("cb"), F.lit(0).alias("role"), "id", "w", "v")
    all_ = dealt.select("cell", F.explode(F.sequence(F.lit(0), F.col("hbs") - 1)).alias("hb"), salt("cbs").alias("cb"), F.lit(1).alias("role"), "id", "w", "v")
    found = materialize(mine.union(all_).groupBy("cell", "hb", "cb").applyInArrow(_join_block(dim, cosine), "a long, b long, links long"))
    links = found.groupBy("a").agg(F.sum("links").alias("links"))
    roots = components(found.filter("b is not null"))
    classes = distinct.select("v", F.col("id").alias("class"), "w")
    placed = usable.select("id", "v").join(classes, "v").groupBy("id").agg(F.min("class").alias("class"), F.max("w").alias("w"))
    placed = placed.join(links, F.col("class") == F.col("a"), "left").join(roots, F.col("class") == F.col("node"), "left").select(
        "id", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n"), F.coalesce("root", "class").alias("root"))
    out = rows.select("id").join(placed, "id", "left")
    component = F.coalesce("root", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def op9(spark, sf_dir: str) -> DataFrame:
    return join(load(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
g AS (SELECT vec_id, v FROM e WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(v, lambda x: abs(x))) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
r(node, root) AS (SELECT a, least(a, min(b)) FROM l GROUP BY a UNION SELECT l.a, r.root FROM r JOIN l ON l.b = r.node WHERE r.root < l.a),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT e0.vec_id, (SELECT count(*) FROM l WHERE l.a = e0.vec_id)::BIGINT AS n_links, coalesce(c.root, e0.vec_id) AS component_id, coalesce(c.root, e0.vec_id) = e0.vec_id AS kept
FROM embeddings e0 LEFT JOIN c ON c.node = e0.vec_id
"""
