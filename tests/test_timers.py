"""Timers: something happens though no row comes; streams give what replays give, in any order of arrival."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from talkmill.streaming import operators as O


def replayed(spark, op, rows, schema, order):
    return sorted(map(str, op.replay(spark.createDataFrame(rows, schema), "k", order).collect()))


def streamed(spark, tmp_path, op, batches, schema, order, name, late="0 seconds"):
    source = str(tmp_path / "in")
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(source)
    files = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = op.follow(files, "k", order, late).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.table(name).collect()


NUDGE = "k string, ms long, kind string, text string, source string, opportunity string, confidence int, nudge string"


def test_nudges_expire_without_a_row(spark, tmp_path):
    draft = ("draft", "t", "s", "ask", 90, None)
    rows = [("a", 1_000, *draft), ("a", 20_000, *draft), ("b", 2_000, *draft), ("b", 3_000, "dismissed", None, None, None, 0, "nudge-1"), (None, 1_000, *draft), ("a", None, *draft)]
    op = O.expiring_nudges(("ask",))
    want = replayed(spark, op, rows, NUDGE, ["text"])
    assert want == ["Row(k='a', event='expired', nudge='nudge-2', text=None, ms=50000, supersedes=None)", "Row(k='a', event='shown', nudge='nudge-1', text='t', ms=1000, supersedes=None)", "Row(k='a', event='shown', nudge='nudge-2', text='t', ms=20000, supersedes='nudge-1')", "Row(k='b', event='shown', nudge='nudge-1', text='t', ms=2000, supersedes=None)"]
    # the last batch is of another key: it only moves the watermark
    other = [("c", 90_000, "helpful", None, None, None, 0, "none")]
    got = streamed(spark, tmp_path, op, [rows[:1], rows[1:], other], NUDGE, ["text"], "ends")
    assert sorted(map(str, got)) == want


PARTIAL = "k string, ms long, epoch long, sequence long, revision long, text string"


def test_coalesced_partials(spark, tmp_path):
    rows = [("a", 0, 0, 1, 1, "we"), ("a", 200, 0, 1, 3, "we ship"), ("a", 249, 0, 1, 2, "we shi"), ("a", 250, 0, 1, 4, "we ship it"), ("a", 400, 1, 1, 1, "new epoch"), ("a", 450, 0, 9, 9, "old epoch"), ("a", 900, 0, 9, 9, "dropped"), ("a", 901, 1, 2, None, "x"), ("a", 902, 1, 2, 1, " ")]
    rows = [(k, ms + 1_000, *r) for k, ms, *r in rows]
    op = O.coalesced_partials(250)
    want = replayed(spark, op, rows, PARTIAL, ["revision"])
    assert want == [f"Row(k='a', ms={m}, epoch={e}, sequence=1, revision={r}, text='{t}', n={n})" for m, e, r, t, n in ((1_250, 0, 3, "we ship", 3), (1_500, 1, 1, "new epoch", 3))]
    got = streamed(spark, tmp_path, op, [rows[:2], rows[2:6], [("b", 5_000, 0, 0, 0, "later")]], PARTIAL, ["revision"], "partials")
    assert sorted(str(r) for r in got if r.k == "a") == want


def test_files_settle_by_the_clock(spark, tmp_path):
    schema = "k string, ms long, size long"
    rows = [("f", 1, 10), ("f", 1_000, 20), ("f", 2_500, 20), ("f", 9_000, 30), ("empty", 1, 0), ("empty", 5_000, None)]
    op = O.settling(2_000)
    want = ["Row(k='f', ms=11000, size=30)", "Row(k='f', ms=3000, size=20)"]
    assert replayed(spark, op, rows, schema, ["size"]) == want
    got = streamed(spark, tmp_path, op, [rows[:2], rows[2:], [("g", 60_000, 0)]], schema, ["size"], "files")
    assert sorted(map(str, got)) == want
    assert op.replay(spark.createDataFrame([], schema), "k", ["size"]).count() == 0


TALK = "k long, ms long, line long, speaker long, start long, end long"


def plain(lines, segments):
    out = {}
    for line, a, b in lines:
        total = {}
        for speaker, c, d in segments:
            if min(b, d) > max(a, c):
                total[speaker] = total.get(speaker, 0) + min(b, d) - max(a, c)
        if total:
            out[line] = min(total, key=lambda s: (-total[s], s))
    return out


def test_reattribution_in_any_order(spark):
    rng = random.Random(3)
    lines = [(i, 1_000 * i, 1_000 * i + rng.randrange(200, 3_000)) for i in range(12)]
    segments = [(rng.randrange(3), a := rng.randrange(0, 12_000), a + rng.randrange(0, 2_500)) for _ in range(25)]
    rows = [(line, None, a, b) for line, a, b in lines] + [(None, s, a, b) for s, a, b in segments]
    talks = []
    for k in range(30):
        rng.shuffle(rows)
        talks += [(k, n, *r) for n, r in enumerate(rows)] + [(k, 99, 3, None, 0, 1), (k, 99, None, None, 0, 9_000), (k, 99, None, 1, None, 9_000)]
    told = O.reattribution().replay(spark.createDataFrame(talks, TALK), "k", ["line"]).collect()
    want = plain(lines, segments)
    for k, own in itertools.groupby(sorted(told, key=lambda r: (r.k, r.revision)), key=lambda r: r.k):
        own = list(own)
        assert {r.line: r.speaker for r in own} == want  # the last word on each line
        by = {line: [r.speaker for r in own if r.line == line] for line in want}
        assert all(a != b for told in by.values() for a, b in itertools.pairwise(told))  # told only when it changes


@pytest.mark.parametrize("first", ["lines", "segments"])
def test_reattribution_as_a_stream(spark, tmp_path, first):
    lines, segments = [(1, 0, 4_000), (2, 4_000, 8_000), (3, 50_000, 51_000)], [(7, 0, 1_000), (8, 1_000, 3_000), (7, 3_000, 8_000), (7, 0, 900)]
    a, b = [(1, 10 + i, i, None, s, e) for i, s, e in lines], [(1, 20 + n, None, k, s, e) for n, (k, s, e) in enumerate(segments)]
    batches = [a, b[:2], b[2:]] if first == "lines" else [[(k, ms - 15, *r) for k, ms, *r in b], a]
    got = streamed(spark, tmp_path, O.reattribution(1_000), batches, TALK, ["line"], f"told_{first}", "60 seconds")
    last = {}
    for r in sorted(got, key=lambda r: r.revision):
        last[r.line] = r.speaker
    assert last == plain(lines, segments) == {1: 7, 2: 7}
    assert [r.speaker for r in sorted(got, key=lambda r: r.revision) if r.line == 1] == ([7, 8, 7] if first == "lines" else [7])
