"""The entry file, with and without the training-data subpackage."""

import sys

import __spark_entry__ as entry_file
from talkmill.queries import ORACLE_SQL, QUERIES


def test_names_agree():
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert set(entry_file.oracle_sql()) <= set(entry_file.queries())


def test_flagship(spark):
    rows = entry_file.entry(spark)
    assert rows.count() > 0 and "score" in rows.columns


def test_without_the_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert entry_file.queries() == QUERIES and entry_file.oracle_sql() == ORACLE_SQL
