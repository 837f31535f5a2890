"""Text queries on documents and labels that the given tables don't hold, against their SQL."""

from collections import Counter

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as entry

TEXTS = [None, "", "   ", "abc", "Spieß.", "abcdß", "Groß ßøæ.", "漢字漢字漢字漢字漢字", "Жизнь прекрасна", "abcd½²ªº", "abcdIıiİ z9", "abcdı", "ΑΣ ς ᾳ ΑΣ xς",
         "abcdéͅ ᾳz", "abcdK", "abcdÅngström", "abcd가각 z", "abcd... !?", "abcd🙂🙂", "Un été à la plage", "abcd\tⅣ ﬁn"]


def rows(found):
    return Counter(tuple(None if v != v else v for v in r) for r in found)


def compare(spark, folder, name, documents, labels=()):
    d, q, t = zip(*labels) if labels else ((), (), ())
    pq.write_table(pa.table({"doc_id": pa.array([i for i, _ in documents], pa.int64()), "text": pa.array([t for _, t in documents], pa.string()),
                             "n_chars": pa.array([len(t or "") for _, t in documents], pa.int64())}), folder / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array(d, pa.int64()), "quality": pa.array(q, pa.int32()), "toxic": pa.array(t, pa.int32())}), folder / "labels.parquet")
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    found = entry.queries()[name](spark, str(folder))
    want = con.execute(f"SELECT {', '.join(found.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert rows(map(tuple, found.collect())) == rows(want)


def test_literal_evidence_of_letters_beyond_ascii(spark, tmp_path):
    compare(spark, tmp_path, "txt_05_literal_evidence", list(enumerate(TEXTS)))


def test_directions_count_blank_and_repeated_documents(spark, tmp_path):
    documents = [*enumerate(TEXTS), (3, "another"), (None, "no id"), (40, None), (41, " ")]
    compare(spark, tmp_path, "txt_08_labelled_directions", documents,
            [(0, 1, 0), (1, 1, 1), (2, 0, 0), (3, 1, 0), (4, None, 1), (5, 1, None), (6, 1, 0), (6, 0, 0), (41, 1, 0), (None, 1, 0), (99, 1, 1)])
