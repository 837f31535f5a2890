"""The digest of a table depends on its rows alone."""

import hashlib

from leadwake.operators.digest import table_digest


def test_digest_follows_rows_not_their_layout(spark):
    rows = [(k % 50, f"t{k % 7}", None if k % 5 == 0 else k * 0.5) for k in range(400)]
    make = lambda r: spark.createDataFrame(r, "id long, t string, x double")
    of = lambda df: tuple(table_digest(df, ["id", "t", "x"]).first())
    first = of(make(rows))
    assert first[0] == 400 and first == of(make(rows[::-1]).repartition(7)) == of(make(rows).coalesce(1))
    for changed in (rows[1:], rows + rows[:1], [(rows[0][0], rows[0][1], 9.25), *rows[1:]], [(rows[0][0], "", rows[0][2]), *rows[1:]]):
        assert of(make(changed)) != first
    assert of(make([(1, "2;1:3", None)])) != of(make([(1, "2", None)]))
    assert of(make([])) == (0, hashlib.sha256(b"").hexdigest())
