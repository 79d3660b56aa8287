"""The driver contract; the optional part may be missing."""

import __spark_entry__ as entry


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    out = entry.entry(spark)
    assert out.columns == ["query_id", "rank", "doc_id", "score"] and out.limit(1).count() == 1
