"""Text functions on hand-made cases."""

import datetime

from pyspark.sql import functions as F

from talkmill.functions import noise
from talkmill.functions import text as T


def value(spark, column, **row):
    schema = ", ".join(f"{k} string" for k in row)
    return spark.createDataFrame([tuple(row.values())], schema).select(column.alias("x")).first()[0]


def test_slugs_topics_and_values(spark):
    t = F.col("t")
    assert value(spark, T.slugify(t), t="  Sarah O'Neil -- Ünal 2 ") == "sarah-o-neil-ünal-2"
    assert value(spark, T.normalize_topic(t), t="We should use (the) Pricing, for annual plans now") == "pricing annual plans now"
    assert value(spark, T.normalize_decision(t), t="Go:  with B!  ") == "go with b"
    assert value(spark, T.title_keywords(t), t="Weekly sync: pricing plan für Q3") == ["pricing", "plan", "für"]
    assert value(spark, T.keywords(t), t="Pricing about pricing and ROADMAP") == ["pricing", "roadmap"]


def test_durations(spark):
    t = F.col("t")
    cases = {"1h 2m 3s": 3723, "48m": 2880, "0m": None, "junk": None, "23:45": 1425, "1:02:03": 3723}
    for text, seconds in cases.items():
        assert value(spark, T.clock_seconds(t), t=text) == seconds


def test_names(spark):
    a, b = F.col("a"), F.col("b")
    likely = {("Sarah Chen", "Sarah"): True, ("Sarah", "Sam"): False, ("Alex Chen", "alex kumar"): False, ("Alex Chen", "Alex Chen"): False, ("Alex Chen", "Alex chen jr"): True, ("", "Al"): False}
    for (x, y), same in likely.items():
        assert value(spark, T.names_likely_same(a, b), a=x, b=y) == same
    plausible = {("Mo-Han", "mohan"): "separator_variant", ("José", "jose"): "separator_variant", ("An", "an"): None, ("sami", "sam"): "phonetic_edit", ("jonathan", "jonatan"): "phonetic_edit", ("kim", "tim"): None, ("Al Ba", "Al Bo"): None}
    for (x, y), reason in plausible.items():
        assert value(spark, T.plausibly_same(a, b), a=x, b=y) == reason


def test_deadlines_and_owners(spark):
    t = F.col("t")
    deadlines = {"send it (due Friday)": "friday", "ship (by March 21) soon": "march 21", "done by next week, ok": "next week", "standby mode": None, "nearby shops": None, "none": None}
    for text, due in deadlines.items():
        assert value(spark, T.inline_deadline(t), t=text) == due
    assert value(spark, T.due_phrase(t), t="Send it by Friday (soon)") == "friday"
    assert value(spark, T.due_phrase(t), t="Send it (due 2026-03-21)") == "2026-03-21"
    assert value(spark, T.owner_prefix(t), t="@mat: Send  it ").asDict() == {"owner": "mat", "content": "Send  it"}
    assert value(spark, T.owner_prefix(t), t="@: x").asDict() == {"owner": None, "content": "@: x"}
    assert value(spark, T.topic_prefix(t), t="Pricing: keep it") == "Pricing"
    confidence = {"We decided to go": "explicit", "maybe later": "tentative", "Ship it": "strong"}
    for text, c in confidence.items():
        assert value(spark, T.decision_confidence(t), t=text) == c


def test_status_and_age(spark):
    now = F.lit("2026-03-20 12:00:00").cast("timestamp_ntz")
    for (status, due), want in {("open", "2026-03-19"): "stale", ("open", "2026-03-20"): "open", ("open", None): "open", ("open", "soon"): "open", ("done", None): None, ("stale", None): "stale"}.items():
        assert value(spark, T.commitment_status(F.col("s"), F.col("d"), now), s=status, d=due) == want
    row = spark.createDataFrame([(datetime.datetime(2026, 3, 18, 11, 30),), (datetime.datetime(2027, 1, 1),), (None,)], "m timestamp_ntz")
    assert [r[0] for r in row.select(T.days_since(F.col("m"), now)).collect()] == [2.0, 0.0, 999.0]


def test_noise(spark):
    t = F.col("t")
    markers = {"[music]": True, "(soft music).": True, "(music director)": False, "(see attached)": False, "[0:00]": False, "[...] [x music]": False, "[Śmiech]": True, "": False, "(a b c d music)": False}
    for text, is_marker in markers.items():
        assert value(spark, noise.noise_marker(t), t=text) == is_marker, text
    phrases = {"Thank you for watching!": True, "thank you for watching the demo": False, "Subtitles by X": True, "www.x.org": True, "...": False}
    for text, known in phrases.items():
        assert value(spark, noise.known_phrase(t), t=text) == known, text
    assert [value(spark, noise.script(t), t=x) for x in ("hello", "東京", "привет", "123", "é東")] == ["latin", "cjk", "other", None, "latin"]
    assert value(spark, T.speaker_labels(t), t="[SARAH CHEN 0:45] hi\n[mat 1:02:03] yo\n[SARAH CHEN 1:00] x\n[note] y") == ["Sarah Chen", "Mat"]
