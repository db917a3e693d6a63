"""Stateful steps on hand-made rows; a stream gives what a replay gives."""

import datetime

import pandas as pd
from pyspark.sql import functions as F

from talkmill.streaming import operators as O
from talkmill.streaming import windows


def steps(op, rows, order):
    return list(op._run(dict(op.initial), pd.DataFrame(rows), order)[1].itertuples(index=False, name=None))


def test_topic_shifts():
    rows = [{"turn": i, "text": t} for i, t in enumerate(["pricing plans annual", "pricing annual discount", "ok", "kubernetes cluster upgrade", "moving on: kubernetes cluster costs"])]
    got = steps(O.topic_shifts(), rows, ["turn"])
    assert [g[1] for g in got] == ["cluster kubernetes upgrade", "cluster costs kubernetes moving"] and got[0][2] == 0.0


def test_nudges():
    draft = {"kind": "draft", "text": "t", "source": "s", "opportunity": "ask", "confidence": 70, "nudge": None}
    rows = [{**draft, "ms": 0}, {**draft, "ms": 5_000}, {**draft, "ms": 11_000}, {**draft, "ms": 12_000, "kind": "dismissed", "nudge": "nudge-2"}, {**draft, "ms": 12_500, "kind": "dismissed", "nudge": "nudge-2"}, {**draft, "ms": 22_000}, {**draft, "ms": 26_000}, {**draft, "ms": 90_000, "confidence": 64}, {**draft, "ms": 91_000, "opportunity": "no"}]
    assert steps(O.nudges(("ask",)), rows, ["ms"]) == [("nudge-1", "t", 0, None), ("nudge-2", "t", 11_000, "nudge-1"), ("nudge-3", "t", 26_000, None)]


def test_partials():
    texts = [(0, "we"), (50, "we will"), (100, "we will ship"), (300, "we will ship it"), (420, "we shall"), (600, "we will ship it now")]
    rows = [{"audio_ms": a, "text": t} for a, t in texts]
    assert steps(O.stable_partials(), rows, ["audio_ms"]) == [(50, "we", "will", 1), (300, "we will ship", "it", 2)]
    rows = [{"sequence": 1, "revision": 2, "final": False, "text": "b"}, {"sequence": 1, "revision": 1, "final": False, "text": "a"}, {"sequence": 1, "revision": 1, "final": True, "text": "c"}, {"sequence": 1, "revision": 3, "final": False, "text": "d"}]
    assert [r[3] for r in steps(O.newest_partials(), [{**r, "n": i} for i, r in enumerate(rows)], ["n"])] == ["b", "c"]


def test_speech_sessions_latency():
    p = [0.9] * 2 + [0.1] + [0.9] * 9 + [0.4] * 3 + [0.1] * 20
    got = steps(O.speech(), [{"n": i, "probability": x} for i, x in enumerate(p)], ["n"])
    on = [w for w, s in got if s]
    assert on == list(range(on[0], on[-1] + 1)) and on[0] == 11 and on[-1] == 31
    events = ["stop", "start", "start", "stop", "done"]
    assert [r[1:] for r in steps(O.sessions(), [{"n": i, "event": e} for i, e in enumerate(events)], ["n"])] == [("new", False), ("active", True), ("active", False), ("processing", True), ("complete", True)]
    assert steps(O.latency(3), [{"n": i, "ms": m} for i, m in enumerate([5, 1, 9, 2])], ["n"])[-1] == (3, 2, 9)


def test_stream_is_replay(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(c, t, f"topic{(c + t // 3) % 3} alpha{t // 3} beta{t // 3}") for c in range(3) for t in range(9)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    for lo in (0, 4, 7):
        table.where((F.col("turn") >= lo) & (F.col("turn") < {0: 4, 4: 7, 7: 9}[lo])).coalesce(1).write.mode("append").parquet(source)
    op = O.topic_shifts()
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = op.follow(stream, "conv_id", ["turn"]).writeStream.format("memory").queryName("shifts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    want = sorted(map(tuple, op.replay(table, "conv_id", ["turn"]).collect()))
    assert sorted(map(tuple, spark.table("shifts").collect())) == want and want


def test_windows_drop_late_rows(spark, tmp_path):
    at = datetime.datetime(2026, 1, 1)
    source = str(tmp_path / "in")
    for offsets in ([0, 600, 4_200], [12_000], [300], [24_000]):
        spark.createDataFrame([(at + datetime.timedelta(seconds=s), "click", 1.0) for s in offsets], "ts timestamp, event_type string, value double").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").option("maxFilesPerTrigger", 1).parquet(source)
    q = windows.tumbling(stream).writeStream.format("memory").queryName("hours").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {(r.start - at).total_seconds() / 3600: r.n for r in spark.table("hours").collect()}
    assert got[0.0] in (2, 3) and got[1.0] == 1 and got[3.0] == 1
