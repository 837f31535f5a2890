"""Fingerprints of files of any size, and steps whose failures stay in their row."""

import hashlib
import io
import os

from pyspark.sql import functions as F

from leadwake.functions.isolated import isolated
from leadwake.operators import text
from leadwake.sources import files


def test_fingerprints_stream_and_skip_absent_paths(spark, tmp_path):
    big, small = tmp_path / "in" / "a b%20.bin", tmp_path / "in" / "deep" / "empty.txt"
    small.parent.mkdir(parents=True)
    big.write_bytes(os.urandom(3_000_001))
    small.write_bytes(b"")
    rows = files.fingerprints(spark, [str(tmp_path / "in"), str(tmp_path / "in" / "deep"), str(tmp_path / "absent")], chunk=4096).collect()
    assert {(os.path.basename(r.path), r.sha256, r.bytes, r.error) for r in rows} == {
        (f.name, hashlib.sha256(f.read_bytes()).hexdigest(), f.stat().st_size, None) for f in (big, small)} and len(rows) == 2
    assert files.fingerprints(spark, str(tmp_path / "absent")).collect() == []
    only = files.fingerprints(spark, str(tmp_path / "in"), "*.txt").collect()
    assert [os.path.basename(r.path) for r in only] == ["empty.txt"]


def test_fingerprints_hold_one_chunk_and_report_unreadable_files(spark, tmp_path):
    for name in ("good", "bad"):
        (tmp_path / name).write_bytes(b"x" * 10)

    class Endless(io.RawIOBase):
        """More bytes than a row could hold, made as they are read."""
        left = 5_000

        def read(self, n=-1):
            assert n == 1 << 20
            self.left -= 1
            return b"\0" * n if self.left >= 0 else b""

    def opener(path):
        if path.endswith("bad"):
            raise PermissionError("no access")
        return Endless()

    found = {os.path.basename(r.path): r for r in files.fingerprints(spark, str(tmp_path), opener=opener).collect()}
    assert found["good"].bytes == 5_000 << 20 and found["good"].error is None
    assert (found["bad"].sha256, found["bad"].bytes, found["bad"].error) == (None, None, "PermissionError: no access")


def test_isolated_keeps_failures_in_their_row(spark):
    def half(n):
        if n == 3:
            return "not a number"
        if n == 4:
            raise KeyError("four")
        return None if n is None else 10 // n

    df = spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 4, None)], "n int").repartition(2)
    got = {r.n: (r.r["value"], r.r["error"]) for r in df.select("n", isolated(half, "bigint")(F.col("n")).alias("r")).collect()}
    assert got[1] == (10, None) and got[2] == (5, None) and got[None] == (None, None)
    assert got[0][0] is None and got[0][1].startswith("ZeroDivisionError") and got[4] == (None, "KeyError: 'four'")
    assert got[3][0] is None and got[3][1].startswith("Arrow")


def test_bad_pages_fail_their_document_alone(spark):
    long = "palavra " * 40
    pages = [(1, 0, long.encode(), None), (1, 1, "ação".encode("latin-1"), "latin-1"), (2, 0, long.encode(), None), (2, 1, b"\xff", None),
             (2, 2, b"x", "no-such"), (3, 0, None, None), (4, 0, b"curto", "ascii")]
    df = text.extract_batch(spark.createDataFrame(pages, "doc_id int, page int, content binary, encoding string"))
    got = {r.doc_id: r for r in df.collect()}
    assert {k: r.status for k, r in got.items()} == {1: "ok", 2: "erro", 3: "sem_texto", 4: "texto_insuficiente"}
    assert got[1].text.endswith("ação") and got[1].error == "" and got[1].pages == 2
    assert got[2].error.startswith("UnicodeDecodeError") and (got[2].pages, got[2].characters, got[2].text, got[2].sha256) == (0, 0, "", "")
    assert {r.doc_id for r in text.review_rows(df).collect()} == {2, 3, 4} and "text" not in text.review_rows(df).columns
    assert {(r.status, r.documents) for r in text.batch_summary(df).collect()} == {("ok", 1), ("erro", 1), ("sem_texto", 1), ("texto_insuficiente", 1)}
