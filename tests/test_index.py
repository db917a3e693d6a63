"""The term index: what is read, what a sync does, and results after changes, compaction and odd rows."""

import pytest
from pyspark.sql import functions as F

from talkmill.operators import retrieval
from talkmill.sources.index import TermIndex, term_counts

DOCS = "doc_id long, text string, key string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k") for r in rows], DOCS)


@pytest.fixture
def rows():
    return [(1, "alpha beta gamma"), (2, "alpha alpha betamax"), (3, None), (4, ""), (None, "alpha beta"), (5, "Älpha béta 12"), (6, "x y z")]


def test_sync_and_queries(spark, tmp_path, rows):
    index = TermIndex(spark, str(tmp_path / "i"))
    assert index.matching("alpha").collect() == [] and index.ranked(["alpha"]).collect() == []
    assert tuple(index.sync(frame(spark, rows)).first()) == (6, 0, 0, 0)
    keys = lambda q: sorted(r["key"] for r in index.matching(q).collect())
    assert keys("alpha bet") == [1, 2, 5] and keys("beta alpha") == [1, 5] and keys("gam") == [1] and keys("") == [] and keys("alpha nothing") == []
    changed = [(1, "delta"), (2, "alpha alpha betamax"), (5, None), (7, "alpha new"), (7, "alpha new")]
    assert tuple(index.sync(frame(spark, changed)).first()) == (1, 2, 3, 1)
    assert keys("alpha") == [2, 7] and keys("delta") == [1] and keys("gamma") == []
    assert tuple(index.sync(frame(spark, changed)).first()) == (0, 0, 0, 4)
    before = index.ranked(["alpha", "new"]).collect()
    index.compact()
    assert index.ranked(["alpha", "new"]).collect() == before and index.documents().select("segment").distinct().count() == 1
    own = retrieval.bm25(frame(spark, changed[:-1]), ["alpha", "new"]).collect()
    assert [(r["key"], r["score"], r["matched"]) for r in before] == [(r["doc_id"], r["score"], r["matched"]) for r in own]


def test_scan_is_pruned(spark, tmp_path):
    """The terms and the prefix of a query reach the scan of the postings."""
    index = TermIndex(spark, str(tmp_path / "i"))
    index.sync(spark.range(200).selectExpr("id AS doc_id", "concat('term', id, ' common') AS text"))
    plan = index.hits(["common"], "term19")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(term,term19)" in plan and "EqualTo(term,common)" in plan or "In(term" in plan
    assert {r["key"] for r in index.matching("common term19").collect()} == {19, *range(190, 200)}


def test_a_sync_splits_texts_once(spark, tmp_path, rows, monkeypatch):
    """Counts are those of a plain version, nothing but postings and documents stays, and postings are exchanged once, to be sorted."""
    assert [(c.term, c.tf) for c in spark.sql("SELECT array('a', 'a', 'b', 'c', 'c', 'c') AS t").select(term_counts(F.col("t")).alias("c")).first().c] == [("a", 2), ("b", 1), ("c", 3)]
    assert spark.sql("SELECT array() :: array<string> AS t, null :: array<string> AS u").select(term_counts(F.col("t")), term_counts(F.col("u"))).first()[:] == (None, None)
    plans, write = [], TermIndex._write
    monkeypatch.setattr(TermIndex, "_write", lambda self, texts, segment: (plans.append(texts._jdf.queryExecution().optimizedPlan().toString()), write(self, texts, segment)))
    index = TermIndex(spark, str(tmp_path / "i"))
    index.sync(frame(spark, [*rows, rows[1], (5, "zz new zz")]))
    assert plans[0].count("Relation [") == 1 and "translate" not in plans[0]
    assert not list((tmp_path / "i" / "texts").iterdir()) and not list((tmp_path / "i" / "latest").iterdir())
    two = index.documents().where("key = 5").first()
    words = {1: {"alpha": 1, "beta": 1, "gamma": 1}, 2: {"alpha": 2, "betamax": 1}, 5: {"zz": 2, "new": 1} if two["size"] == 3 and index.hits(["zz"]).where("key = 5").count() else {"alpha": 1, "beta": 1, "12": 1}}
    got = {}
    for r in index._postings().collect():
        got.setdefault(r.key, {})[r.term] = r.tf
    assert got == words and {r.key: r["size"] for r in index.documents().collect()} == {1: 3, 2: 3, 3: index.documents().where("key = 3").first()["size"], 4: 0, 5: 3, 6: 0}
