"""Passes over lines read them once; chunks give Python the lengths of lines alone."""

import pytest
from pyspark.sql import functions as F

from talkmill.operators import cleaning, records
from talkmill.plans import transcripts

LINES = "doc_id long, pos double, line string"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_notes_without_reading_twice(spark):
    end = ["[0:01] words", *["[0:02] you"] * 5, *["[0:03] [music]"] * 2]
    marks = ["[0:01] (applause)" if i % 5 else "[0:02] words" for i in range(40)]
    rows = [(1, float(i), x) for i, x in enumerate(end)] + [(2, float(i), x) for i, x in enumerate(marks)] + [(3, 0.0, "[music]"), (4, 0.0, "[0:01] you")]
    lines = spark.createDataFrame(rows, LINES)
    trimmed, collapsed = cleaning.trim_end(lines), cleaning.collapse_noise(lines)
    for out in (trimmed, collapsed):
        assert "Union" not in _plan(out) and "Join" not in _plan(out)
    got = {(r.doc_id, r.pos): r.line for r in trimmed.collect()}
    assert got == {(k, p): x for k, p, x in rows if k in (2, 4)} | {(1, 0.0): end[0], (1, 1.0): "[Recording ended - 7 lines of trailing noise removed]", (3, 0.0): "[Recording ended - 1 lines of trailing noise removed]"}
    got = {(r.doc_id, r.pos): r.line for r in collapsed.collect() if r.doc_id == 2}
    assert got[2, 2.0] == "[...] [non-speech audio removed - 3 markers collapsed]" and len(got) == 24
    sparse = [(5, float(i), "[0:01] (applause)" if i % 3 else "[0:02] words") for i in range(24)]
    got = {r.pos: r.line for r in cleaning.collapse_noise(spark.createDataFrame(sparse, LINES)).collect()}
    assert len(got) == 9 and got[23.0 + 1e9] == "[16 scattered non-speech markers removed]"


def test_lines_are_dealt_by_the_number_of_documents(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    want = sorted(transcripts.noise_collapse(spark, sf).collect())
    monkeypatch.setattr(transcripts, "EACH", 4)
    out = transcripts.noise_collapse(spark, sf)
    assert ", 50)" in out._jdf.queryExecution().executedPlan().toString() and sorted(out.collect()) == want


def test_chunks_of_lengths(spark):
    texts = {1: "ab\n" * 30, 2: "x" * 100 + "\ny", 3: None, 4: "", 5: "é\n😀" * 20}
    out = records.chunks(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 5)
    plan = _plan(out)
    assert "MapInPandas" in plan and "transform(split(" in plan.replace(" ", "").lower().replace("coalesce(", "")
    got = out.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("chars").alias("chars")).collect()
    assert {r.doc_id: (r.n, r.chars) for r in got} == {1: (5, 91), 2: (2, 103), 5: (3, 61)}


def test_cleaning_is_dealt_and_written(spark, monkeypatch):
    """The counts are the same however many tasks hold the documents; no RDD checkpoint is made of the lines."""
    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(type(spark.range(0)), "checkpoint", lambda *a, **b: pytest.fail("lines are checkpointed as serialised rows"))
    want = sorted(map(tuple, transcripts.clean_transcripts(spark, sf).collect()))
    monkeypatch.setattr(transcripts, "EACH", 20)
    asked, deal = [], cleaning.dealt
    monkeypatch.setattr(cleaning, "dealt", lambda rows, n, *keys: (asked.append(n), deal(rows, n, *keys))[1])
    assert sorted(map(tuple, transcripts.clean_transcripts(spark, sf).collect())) == want and len(want) == 8
    assert asked == [10] * 6, "all passes but the one that looks at a line alone"
