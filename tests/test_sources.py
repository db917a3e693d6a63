"""Sources and sinks on small files."""

import json

import pytest
from pyspark.sql import functions as F

from talkmill.sources import census, logs, markdown, vocabulary

NOTE = """---
title: Pricing
type: meeting
date: 2026-03-01T10:00:00
people: [[alex-chen], [mat]]
decisions:
  - text: Keep it
    topic: pricing
action_items:
  - assignee: mat
    task: Send doc
    due: Friday
    status: open
---
## Summary
[MAT 0:10] hi
"""


def test_markdown(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "skip").mkdir()
    (tmp_path / "a" / "one.md").write_text(NOTE)
    (tmp_path / "a" / ".hidden.md").write_text(NOTE)
    (tmp_path / "skip" / "two.md").write_text(NOTE)
    (tmp_path / "a" / "bare.md").write_text("no frontmatter")
    rows = markdown.read_corpus(spark, str(tmp_path), ("skip",))
    assert rows.count() == 2
    c = F.col("content")
    front = markdown.frontmatter(c)
    got = {r.path.rsplit("/", 1)[1]: r for r in rows.select("path", front.alias("f"), markdown.body(c).alias("b"), markdown.scalar(front, "title").alias("t"), markdown.repaired(front).alias("r")).collect()}
    one = got["one.md"]
    assert one.t == "Pricing" and one.b.startswith("## Summary") and got["bare.md"].f == "" and got["bare.md"].b == "no frontmatter"
    assert "date: 2026-03-01T10:00:00+00:00" in one.r and "people: [alex-chen, mat]" in one.r and 'due: "Friday"' in one.r
    assert markdown.resolve_slug(rows, "one").count() == 1
    pytest.importorskip("yaml")
    m = markdown.parse(rows).first()
    assert m.title == "Pricing" and m.decisions[0].topic == "pricing" and m.action_items[0].due == "Friday"


def test_event_log(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    (log / "events.jsonl").write_text("\n".join(json.dumps({"v": 1, "seq": s, "timestamp": "2026-01-01T00:00:00Z", "event_type": "x"}) for s in (5, 6)) + "\nbroken{\n" + json.dumps({"v": 1, "timestamp": "2026-01-01T00:00:00Z", "event_type": "old"}) + "\n")
    events = logs.read_events(spark, str(log))
    assert sorted((r.seq, r.event_type) for r in events.collect()) == [(1, "old"), (5, "x"), (6, "x")]
    new = spark.createDataFrame([(f"2026-02-0{i}", "y", f"p{i}") for i in range(1, 8)], "ts string, event_type string, payload string").withColumn("ts", F.col("ts").cast("timestamp"))
    logs.append_events(new, events, str(tmp_path / "out"))
    out = spark.read.json(str(tmp_path / "out"))
    assert [(r.seq, r.payload) for r in out.orderBy("seq").collect()] == [(6 + i, f"p{i}") for i in range(1, 8)]


def test_upsert_and_jobs(spark):
    base = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    changes = spark.createDataFrame([(2, "b", 1), (2, "c", 2), (3, "d", 1)], "k int, v string, at int")
    assert sorted((r.k, r.v) for r in logs.upsert(base, changes, ["k"], "at").collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert [r.k for r in logs.removed(base, changes, ["k"]).collect()] == [1]
    jobs = spark.createDataFrame([(1, "running", "up", 0), (2, "running", "gone", 0), (3, "running", "gone", 2), (4, "queued", None, 0)], "job int, state string, owner string, retries int")
    got = logs.recovered_jobs(jobs, spark.createDataFrame([("up",)], "owner string"))
    assert sorted((r.job, r.state, r.retries) for r in got.collect()) == [(1, "running", 0), (2, "queued", 1), (3, "failed", 3), (4, "queued", 0)]


def test_census(spark, tmp_path):
    for name, size in (("a.pdf", 10), ("b.tar.gz", 7), ("c", 200_000), ("d.MD", 5)):
        (tmp_path / name).write_bytes(b"x" * size)
    got = {(r.measure, r.value): r.files for r in census.census(census.files(spark, str(tmp_path))).collect()}
    assert got["format", "tar.gz"] == 1 and got["category", "plain_text"] == 1 and got["size", "under_100_kib"] == 3 and got["size", "100_kib_to_1_mib"] == 1 and got["category", "other"] == 1


def test_vocabulary_and_conversion(spark, tmp_path):
    (tmp_path / "v.toml").write_text('[[entries]]\ncanonical = "Big Query"\nkind = "product"\npriority = 3\naliases = ["BQ", "", "Big Query"]\n[[entries]]\naliases = ["x"]\n')
    (tmp_path / "bad.toml").write_text("[[")
    rows = vocabulary.read_vocabulary(spark, str(tmp_path)).orderBy("place").collect()
    assert [(r.entry, r.canonical, r.kind, r.priority, r.place, r.form) for r in rows] == [(0, "Big Query", "product", 3, 0, "Big Query"), (0, "Big Query", "product", 3, 1, "BQ")]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.html").write_text("<p>a &amp; b</p><script>x()</script>")
    (tmp_path / "d" / "b.txt").write_text("plain é")
    (tmp_path / "d" / "c.pdf").write_text("%PDF")
    got = {r.format: r.text for r in vocabulary.converted(spark, str(tmp_path / "d")).collect()}
    assert got == {"html": "a & b", "txt": "plain é", "pdf": None}


def test_stable_read(spark, tmp_path):
    (tmp_path / "one.md").write_text(NOTE)
    assert markdown.stable_read(spark, str(tmp_path), lambda c: c.count()) == 1
    tries = []

    def work(corpus):
        tries.append(corpus.count())
        (tmp_path / f"new{len(tries)}.md").write_text(NOTE)

    with pytest.raises(RuntimeError):
        markdown.stable_read(spark, str(tmp_path), work)
    assert tries == [1, 2]
