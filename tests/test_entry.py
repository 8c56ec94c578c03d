"""The driver's contract."""

import __spark_entry__ as e


def test_queries_have_sql_of_the_same_name():
    assert set(e.oracle_sql()) <= set(e.queries())
    assert "scan_documents" in e.queries()


def test_entry(spark):
    assert e.entry(spark).columns == ["doc_id", "line_number", "start_col", "type", "text", "confidence", "band"]
