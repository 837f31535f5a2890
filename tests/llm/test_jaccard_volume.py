"""What the Jaccard join sends from task to task: tokens, and texts only of documents that can have a link."""

import random

import numpy as np
import pyarrow as pa

from leadwake.llm import jaccard_join
from leadwake.session import materialize


def shuffled(spark, work) -> int:
    """Bytes that all stages of some work write for others to read."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm

    def written():
        sc.listenerBus().waitUntilEmpty(30_000)
        none = jvm.java.util.ArrayList()
        stages = sc.statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none)
        return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteBytes() for k in range(stages.size())}

    before = written()
    work()
    return sum(v for k, v in written().items() if k not in before)


def test_texts_without_a_link_are_not_dealt_out(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(f"{rng.getrandbits(64):x}" for _ in range(3000))) for k in range(150)]
    rows += [(1000 + k, rows[k][1] + " end") for k in range(4)] + [(2000, None), (None, "no id " * 9)]
    docs = materialize(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = []
    moved = shuffled(spark, lambda: got.extend(jaccard_join.join(docs).collect()))
    assert {r.doc_id: r.component_id for r in got} == {i: i and i % 1000 if i != 2000 else i for i, _ in rows}
    assert moved < 0.6 * sum(len(t or "") for _, t in rows)


def test_sketch_loses_no_id(spark):
    ids = [0, 1, -1, 7, 1 << 40, -(1 << 63), (1 << 63) - 1]
    sketch = jaccard_join._id_sketch(spark.createDataFrame([(i,) for i in ids * 2], "id long"))
    assert jaccard_join._is_in(pa.array(ids), sketch).all() and 1 <= np.unpackbits(sketch).sum() <= len(ids)
    assert not jaccard_join._id_sketch(spark.createDataFrame([], "id long")).any()
    rows = spark.range(10_000).selectExpr("if(id % 1000 = 5, null, id) as id", "string(id) as text")
    assert {0, 1, 7} <= {r.id for r in jaccard_join._likely(rows, sketch).collect()} < set(range(20))


def test_only_rows_that_may_go_are_dealt_out(spark):
    rng = random.Random(4)
    rows = [(f"{rng.getrandbits(4000):x}", k if k % 50 else None, "x") for k in range(3000)]
    docs = materialize(spark.createDataFrame(rows + rows[:60], "text string, doc_id long, lang string").repartition(3))
    gone = materialize(spark.createDataFrame([(k,) for k in range(1, 3000, 10)] + [(9999,)], "doc_id long"))
    width, got = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = shuffled(spark, lambda: got.extend(jaccard_join.without(docs, gone).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", width)
    assert sorted(map(tuple, got), key=repr) == sorted((r for r in rows + rows[:60] if r[1] is None or r[1] % 10 != 1), key=repr)
    assert moved < 0.3 * sum(len(t) for t, _, _ in rows)
