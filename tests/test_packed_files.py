"""Monthly quote files are kept packed; their fingerprints are those of the lines."""

import gzip
import hashlib
from pathlib import Path

import __spark_entry__ as entry
from leadwake.plans import catalog_sources
from leadwake.plans.registry import Context
from leadwake.sources import files


def test_fingerprint_of_packed_files_is_that_of_their_contents(spark, tmp_path):
    content = {"a.txt.gz": b"line\n" * 70_000, "b.txt.gz": b"", "c.txt": b"plain\n"}
    for name, data in content.items():
        (tmp_path / name).write_bytes(gzip.compress(data) if name.endswith(".gz") else data)
    (tmp_path / "bad.txt.gz").write_bytes(b"not packed")
    found = {Path(r.path).name: r for r in files.fingerprints(spark, str(tmp_path), chunk=4096, opener=files.open_unpacked).collect()}
    assert {n: (r.sha256, r.bytes, r.error) for n, r in found.items() if n != "bad.txt.gz"} == {
        n: (hashlib.sha256(d).hexdigest(), len(d), None) for n, d in content.items()}
    assert found["bad.txt.gz"].sha256 is None and found["bad.txt.gz"].error


def test_monthly_files_take_a_fraction_of_their_lines(spark):
    folder = Path(catalog_sources._monthly_files(Context(spark, entry.SMALL)).removeprefix("file:"))
    stored = sum(f.stat().st_size for f in folder.rglob("*.txt*") if not f.name.startswith("."))
    lines = sum(r["bytes"] for r in entry.queries()["src_15_file_fingerprints"](spark, entry.SMALL).collect())
    assert 0 < 4 * stored < lines
