import __spark_entry__ as entry


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert sum(r["n_docs"] for r in rows) == 200 and all(r["n_tokens"] > 0 for r in rows)
