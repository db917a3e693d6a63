"""Line dedup against plain Python."""

from collections import defaultdict

from pyspark.sql import functions as F

from talkmill.llm.lines import LineRuns, dedup_lines, without_lines
from talkmill.tables import load

BLANK = " \t\n\x0b\f\r"


def plain(rows, min_chars=20, min_docs=3):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))
    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(d)
    out = {}
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == d]
        out[d] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_whole_table(spark):
    docs = load(spark, "/root/testdata/sf0.01", "documents")
    want = plain([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in dedup_lines(docs).collect()}
    assert got == want and sum(w[1] for w in want.values())


def test_edges(spark):
    line, upper = "a line of many characters", "\x0b A LINE of many characters\r"
    long = "\n".join(f"line number {i} of a long text" for i in range(5_000))
    rows = [(1, line), (2, upper + "\n\n"), (3, line + "\n" + line), (4, None), (5, ""), (6, "É" * 20), (7, "é" * 20), (8, "É" * 20), (9, "É" * 20)]
    rows += [(10, long), (11, long), (12, long), (13, "x" * 19), (14, "x" * 19), (15, "x" * 19)]
    docs = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, n_lines string")
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in dedup_lines(docs, batches=3).collect()}
    assert got == plain(rows)
    assert dedup_lines(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, line), (None, line), (1, line), (1, line), (2, line)], "doc_id long, text string")
    assert sorted(r.n_dropped for r in dedup_lines(odd).collect()) == [0, 0, 0, 0, 0]


def test_runs_merge_without_exchange(spark):
    """Levels compact more than once, runs are merged bucket by bucket, and no table is left behind."""
    runs, before = LineRuns(spark, 2), len(spark.catalog.listTables())
    for i in range(7):
        runs.add(spark.createDataFrame([(100 - i, k, k) for k in range(i, i + 5)], "doc_id long, h1 long, h2 long"))
    assert len(runs.levels) == 3 and all(runs.levels)
    plan = runs.merged(*runs.levels[:2])._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "Exchange" not in plan
    want = {k: 100 - max(0, k - 4) for k in range(1, 10)}
    assert {r.h1: r.last for r in runs.settled().collect()} == want
    assert len(spark.catalog.listTables()) == before


def test_any_batches_and_clashing_columns(spark):
    docs = load(spark, "/root/testdata/sf0.001", "documents").withColumns({c: F.lit(c) for c in ("id", "h", "d", "r", "row", "lines", "drop", "at", "h1", "batch", "n_dropped")})
    want = plain([(r.doc_id, r.text) for r in docs.collect()])
    for batches in (1, 2, 9):
        got = without_lines(docs, batches=batches)
        assert got.columns == docs.columns
        assert {r.doc_id: r.text for r in got.collect()} == {d: t for d, (_, _, t) in want.items()}
    first = without_lines(docs).first()
    assert first.row == "row" and first.n_dropped == "n_dropped" and first.n_chars == len(first.text)
