"""Redaction: the text of ``redact`` over the spans of ``find``, in one Python step."""

from leadwake.llm import pii

ROWS = [(1, "write to a@b.cd or 10.0.0.1, call +49 (30) 1234567 é", 1), (2, None, 2), (3, "", 3), (3, "plain words", 4), (None, "x@y.zz", 5),
        (4, "anna12 (at) mailer dot com " * 3, 6), (5, "4111 1111 1111 1111 🙂 c@d.ef", 7)]


def test_redacted_equals_found_spans(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, redacted long").repartition(3)
    weights = pii.learn(docs.select("doc_id", "text"))
    spans = {r.row.redacted: [(s.kind, s.start, s.stop) for s in r.spans] for r in pii.find(docs, weights=weights).collect()}
    got = {r.row.redacted: r.redacted for r in pii.redacted(docs, weights=weights).collect()}
    assert got == {k: t and pii.redact(t, spans[k]) for _, t, k in ROWS}
    assert got[1] == "write to <email> or <ip>, call <phone> é" and got[2] is None and got[3] == ""


def test_stage_holds_one_worker_a_task(spark):
    import corpus_pipeline as c
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t, _ in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    out = c.redact_personal_data(spark, docs, "")
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()}[5] == ("<card> 🙂 <email>", 16)
