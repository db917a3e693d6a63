"""The event envelope: one log line of JSON as a VARIANT, typed views of its kinds, and logs and transcripts followed as streams.

A line has `v`, `seq`, `timestamp` and `event_type`; what else it has belongs to its kind. The body stays whole as a VARIANT, so kinds that
are not known here pass through unread, and a view reads only the fields it names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.sources.logs import LINE

#: Kinds of events and their fields; a field ending in ? may be missing. Fixed values.
KINDS = {
    "recording.started": "session_id? string, source string, capabilities? array<string>",
    "recording.completed": "path string, title string, word_count long, content_type string, duration string",
    "AudioProcessed": "path string, title string, word_count long, content_type string, source_path string",
    "WatchProcessed": "path string, title string, word_count long, source_path string",
    "NoteAdded": "meeting_path string, text string",
    "sensitive.marker": "session_id string, text string",
    "VaultSynced": "source_path string, vault_path string, strategy string",
    "VoiceMemoProcessed": "path string, title string, word_count long, source_path string, device? string",
    "DeviceChanged": "old_device string, new_device string",
    "meeting.insight.detected": "insight variant, meeting_title string",
    "KnowledgeUpdated": "meeting_path string, facts_written long, facts_skipped long, people_updated array<string>",
    "MicMuted": "source string",
    "MicUnmuted": "source string",
    "live.utterance.final": "session_id? string, source string, transcript_path string, line long, text string, speaker? string, offset_ms long, duration_ms long",
    "screen_context.unavailable": "reason string, message string",
    "sensitivity.override": "surface string, query? string",
    "agent.annotation": "agent variant, subkind string, target variant, body string, citations? array<string>, confidence string, provenance? variant",
}

#: Earlier names of kinds. Fixed values.
EARLIER = {"RecordingCompleted": "recording.completed", "MeetingInsightExtracted": "meeting.insight.detected", "LiveUtteranceFinal": "live.utterance.final"}


def fields(kind: str) -> list[tuple[str, str, bool]]:
    """(name, type, required) of the fields of a kind."""
    parts = (part.split(" ", 1) for part in KINDS[kind].split(", "))
    return [(name.rstrip("?"), type_, not name.endswith("?")) for name, type_ in parts]


def field(body: Column, path: str, type_: str) -> Column:
    """The value at a JSON path of a VARIANT as a type; null if it is missing or cannot be read so. A number is read as a string and a whole string as a number."""
    return F.try_variant_get(body, path, type_)


def envelopes(lines: DataFrame) -> DataFrame:
    """(v, seq, ts, event_type, known, body variant) of lines (value): earlier names become the present ones.

    Lines that are no JSON, or without a time or a kind, are skipped. `v` is 1 and `seq` 0 where they are missing. Kinds that `KINDS` does not have,
    and events without a field that their kind requires, are not `known`, but are kept with all they have.
    """
    # A generator of one row: filters stay above it, so that a line is parsed once and not again for each condition.
    rows = lines.select(F.explode(F.array(F.try_parse_json("value"))).alias("body"))
    body = F.col("body")
    kind = field(body, "$.event_type", "string")
    earlier = F.create_map(*(F.lit(x) for pair in EARLIER.items() for x in pair))
    rows = rows.withColumns({"ts": field(body, "$.timestamp", "timestamp"), "event_type": F.coalesce(F.try_element_at(earlier, kind), kind)})
    rows = rows.where("ts is not null and event_type is not null")
    known = F.lit(False)
    for name in KINDS:
        has = F.lit(True)
        for f, type_, required in fields(name):
            has = has & field(body, f"$.{f}", type_).isNotNull() if required else has
        known = F.when(F.col("event_type") == name, has).otherwise(known)
    v, seq = F.coalesce(field(body, "$.v", "int"), F.lit(1)), F.coalesce(field(body, "$.seq", "long"), F.lit(0))
    return rows.select(v.alias("v"), seq.cast("long").alias("seq"), "ts", "event_type", known.alias("known"), "body")


def typed(kind: str) -> dict[str, Column]:
    """The kind's fields as columns over `body`; arrays that are missing are empty."""
    out = {}
    for name, type_, _ in fields(kind):
        value = field(F.col("body"), f"$.{name}", type_)
        out[name] = F.coalesce(value, F.array().cast(type_)) if type_.startswith("array") else value
    return out


def of_kind(events: DataFrame, kind: str) -> DataFrame:
    """(seq, ts, the kind's fields): the typed view of one kind of `envelopes`."""
    rows = events.where((F.col("event_type") == kind) & F.col("known"))
    return rows.select("seq", "ts", *(value.alias(name) for name, value in typed(kind).items()))


def totals(events: DataFrame, views: dict[str, tuple[Callable[[dict[str, Column]], Column], Callable[[dict[str, Column]], Column]]], unknown: tuple[Column, Column]) -> DataFrame:
    """(kind, n, total, last): of each kind of the views, and of each unknown kind, the count, the sum of a number and the greatest text.

    A view gives (number, text) from its kind's typed fields, `seq` among them; `unknown` are those of events that are not known. All of it
    is one pass over the log; a view's kind without an event has the count 0.
    """
    number = text = None
    of = lambda kind: (F.col("event_type") == kind) & F.col("known")
    for kind, (n, t) in views.items():
        own = typed(kind) | {"seq": F.col("seq")}
        number = (F.when if number is None else number.when)(of(kind), n(own).cast("long"))
        text = (F.when if text is None else text.when)(of(kind), t(own))
    rows = events.where(F.col("event_type").isin(*views) | ~F.col("known")).groupBy("known", F.col("event_type").alias("kind")).agg(
        F.count("*").alias("n"), F.sum(number.otherwise(unknown[0])).alias("total"), F.max(text.otherwise(unknown[1])).alias("last")
    )
    none = events.sparkSession.createDataFrame([(True, kind) for kind in views], "known boolean, kind string").withColumns({"n": F.lit(0).cast("long"), "total": F.lit(None).cast("long"), "last": F.lit(None).cast("string")})
    both = rows.unionByName(none).groupBy("known", "kind").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("last").alias("last"))
    return both.drop("known")


def stream_events(spark: SparkSession, path: str, after: int = 0) -> DataFrame:
    """A stream of `envelopes` of a log folder with a seq beyond `after`.

    The query's checkpoint is the cursor: a restarted query goes on behind the files it has read, none twice. Writers add files, as
    `append_events` does; lines added to a file that has been read are not seen.
    """
    return envelopes(spark.readStream.text(path)).where(F.col("seq") > after)


def stream_lines(spark: SparkSession, path: str, after: int = 0, late: str = "1 hour") -> DataFrame:
    """A stream of transcript lines beyond a cursor, each once though its writer repeats it within `late`; malformed lines are skipped."""
    rows = spark.readStream.text(path).select(F.from_json("value", LINE).alias("l")).select("l.*").where(F.col("line") > after)
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["line"])
