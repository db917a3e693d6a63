"""Typed views of event logs, and logs and transcripts as streams with a cursor."""

import json

import pytest
from pyspark.sql import functions as F

from talkmill.sources import events

AT = "2026-01-01T00:00:00Z"
SAMPLE = {"string": "x", "long": 3, "array<string>": ["a", "b"], "variant": {"k": 1}}


def lines(spark, *rows):
    return spark.createDataFrame([(r if isinstance(r, str) or r is None else json.dumps(r),) for r in rows], "value string")


def test_every_kind_has_its_fields(spark):
    full = [{"seq": n, "timestamp": AT, "event_type": k, **{f: SAMPLE[t] for f, t, _ in events.fields(k)}} for n, k in enumerate(events.KINDS)]
    bare = [{"timestamp": AT, "event_type": k, **{f: SAMPLE[t] for f, t, required in events.fields(k) if required}} for k in events.KINDS]
    rows = events.envelopes(lines(spark, *full, *bare))
    got = {(r.event_type, r.known): r.n for r in rows.groupBy("event_type", "known").agg(F.count("*").alias("n")).collect()}
    assert got == {(k, True): 2 for k in events.KINDS} and len(events.KINDS) == 17


@pytest.mark.parametrize("kind", ["recording.completed", "live.utterance.final", "agent.annotation"])
def test_a_lacking_field_makes_an_event_unknown(spark, kind):
    full = {"timestamp": AT, "event_type": kind, **{f: SAMPLE[t] for f, t, _ in events.fields(kind)}}
    required = [f for f, _, needed in events.fields(kind) if needed]
    rows = events.envelopes(lines(spark, *({k: v for k, v in full.items() if k != f} for f in required), full))
    assert rows.where("known").count() == 1 and rows.where("not known").count() == len(required) and events.of_kind(rows, kind).count() == 1


def test_envelopes(spark):
    rows = events.envelopes(lines(
        spark, {"seq": 5, "timestamp": AT, "event_type": "LiveUtteranceFinal", "source": "mic", "transcript_path": "p", "line": 7, "text": "hi", "offset_ms": 1, "duration_ms": 2}, {"v": 2, "timestamp": AT, "event_type": "later.kind", "deep": {"a": [1, {"b": "c"}]}},
        {"timestamp": AT}, {"event_type": "NoteAdded"}, {"timestamp": "noon", "event_type": "NoteAdded"}, "{broken", "", None, "[1]", {"timestamp": AT, "event_type": "recording.started", "source": "s"},
    ))
    assert {(r.v, r.seq, r.event_type, r.known) for r in rows.select("v", "seq", "event_type", "known").collect()} == {(1, 5, "live.utterance.final", True), (2, 0, "later.kind", False), (1, 0, "recording.started", True)}
    said = events.of_kind(rows, "live.utterance.final").first()
    assert (said.line, said.text, said.speaker, said.session_id, said.duration_ms) == (7, "hi", None, None, 2)
    assert events.of_kind(rows, "recording.started").first().capabilities == []
    assert rows.where("not known").select(events.field(F.col("body"), "$.deep.a[1].b", "string")).first()[0] == "c"


def test_a_stopped_stream_goes_on_where_it_was(spark, tmp_path):
    """Two runs of one query over a growing folder: no line is lost, none comes twice, nothing before the cursor."""
    source, sink, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    line = lambda n: json.dumps({"line": n, "ts": f"2026-01-01T00:00:{n % 60:02}Z", "text": f"t{n}"})

    def run():
        stream = events.stream_lines(spark, source, after=3)
        q = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return sorted(r.line for r in spark.read.parquet(sink).collect())

    lines(spark, *(line(n) for n in range(1, 11)), "{broken", "").coalesce(1).write.mode("append").text(source)
    assert run() == list(range(4, 11))
    assert run() == list(range(4, 11))
    lines(spark, *(line(n) for n in range(9, 21))).coalesce(2).write.mode("append").text(source)  # two lines again
    assert run() == list(range(4, 21))


def test_a_stream_of_events(spark, tmp_path):
    source = str(tmp_path / "in")
    lines(spark, *({"seq": n, "timestamp": AT, "event_type": "MicMuted", "source": "s"} for n in range(5)), "{").coalesce(1).write.text(source)
    q = events.stream_events(spark, source, after=1).select("seq", "event_type", "known").writeStream.format("memory").queryName("muted").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("muted").collect())) == [(n, "MicMuted", True) for n in (2, 3, 4)]


def test_totals_are_one_pass(spark, tmp_path):
    """All views read the log once and parse a line once; a kind without events has the count 0, other known kinds are left out."""
    full = [{"seq": n, "timestamp": AT, "event_type": "NoteAdded", "meeting_path": "p", "text": f"t{n}"} for n in (1, 2)]
    rest = [{"seq": 5, "timestamp": AT, "event_type": "NoteAdded", "text": "x"}, {"seq": 7, "timestamp": AT, "event_type": "new"}, {"seq": 9, "timestamp": AT, "event_type": "MicMuted", "source": "s"}]
    lines(spark, *full, *rest, "{").write.text(str(tmp_path / "log"))
    views = {"NoteAdded": (lambda own: own["seq"], lambda own: own["text"]), "DeviceChanged": (lambda own: own["seq"], lambda own: own["new_device"])}
    out = events.totals(events.envelopes(spark.read.text(str(tmp_path / "log"))), views, (F.col("seq"), F.lit(None).cast("string")))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and plan.lower().count("parsejson(") == 1
    assert sorted(map(tuple, out.collect()), key=str) == sorted([("NoteAdded", 2, 3, "t2"), ("DeviceChanged", 0, None, None), ("NoteAdded", 1, 5, None), ("new", 1, 7, None)], key=str)
