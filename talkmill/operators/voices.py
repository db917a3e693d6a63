"""Voices and live sessions: solo clips, energy windows, attributed transcripts, scores of nudges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkmill.operators.intervals import dominant_speaker, merged
from talkmill.operators.retrieval import dot, unit
from talkmill.streaming.stateful import Operator


def solo_profiles(windows: DataFrame, clips: DataFrame, least_seconds: float = 3.0, least_snr: float = 10.0, most_clipped: float = 0.05, least_likeness: float = 0.5) -> DataFrame:
    """(clip, embedding, windows, consistency, refused): the mean voice of each clip, or why it is refused.

    windows: (clip, embedding); clips: (clip, speech_seconds, snr, clipping). Refused are, in this order, clips that are too short, noisy or
    clipped, have fewer than two windows, windows of different lengths, or two windows less alike than least_likeness. A clip's
    windows are few, as a clip is one recording by one person.
    """
    units = windows.select("clip", unit(F.col("embedding")).alias("v")).where("v is not null")
    own = units.groupBy("clip").agg(F.collect_list("v").alias("vs"))
    rows = clips.join(own, "clip", "left").withColumn("vs", F.coalesce("vs", F.array().cast("array<array<double>>")))
    pairs = F.transform("vs", lambda a: F.array_min(F.transform("vs", lambda b: dot(a, b))))
    even = F.size(F.array_distinct(F.transform("vs", F.size))) <= 1
    rows = rows.withColumn("consistency", F.when(even & (F.size("vs") > 1), F.round(F.array_min(pairs), 6)))
    refused = (
        F.when(F.col("speech_seconds") < least_seconds, "short").when(F.col("snr") < least_snr, "noisy").when(F.col("clipping") > most_clipped, "clipped")
        .when(F.size("vs") < 2, "few windows").when(~even, "uneven windows").when(F.col("consistency") < least_likeness, "several voices")
    )
    total = F.aggregate(F.slice("vs", F.lit(2), F.greatest(F.size("vs") - 1, F.lit(0))), F.get("vs", F.lit(0)), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return rows.withColumn("refused", refused).select("clip", F.when(F.col("refused").isNull(), unit(total)).alias("embedding"), F.size("vs").cast("long").alias("windows"), "consistency", "refused")


def active_segments(one: DataFrame, other: DataFrame, key: str, seconds: float, threshold: float, gap: float = 0.01) -> DataFrame:
    """(key, start, end, n): where one of two sources of energy windows (key, i, start, rms) is over the threshold; windows meet by their number i."""
    both = one.join(other.select(key, "i", F.col("rms").alias("other")), [key, "i"]).where((F.col("rms") > threshold) | (F.col("other") > threshold))
    return merged(both.select(key, "start", (F.col("start") + seconds).alias("end")), [key], gap)


def attributed(lines: DataFrame, segments: DataFrame, key: str, share: float = 0.6) -> DataFrame:
    """lines (key, line, at, speaker) in which the first line without a speaker takes the next one's, and lines of a key without any speaker the dominant one.

    The dominant speaker has at least that share of the segments' time.
    """
    order = Window.partitionBy(key).orderBy("at", "line")
    ahead = F.first("speaker", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    rows = lines.withColumns({"place": F.row_number().over(order), "ahead": ahead, "known": F.count("speaker").over(Window.partitionBy(key))})
    rows = rows.join(dominant_speaker(segments, [key], share).withColumnRenamed("speaker", "dominant"), key, "left")
    who = F.when(F.col("known") == 0, F.col("dominant")).when((F.col("place") == 1) & F.col("speaker").isNull(), F.col("ahead")).otherwise(F.col("speaker"))
    return rows.select(key, "line", "at", who.alias("speaker"))


def judged(repeat_ms: int = 60_000) -> Operator:
    """rows of opportunities (kind `label`: name, opportunity, start_ms, end_ms), then of nudges (kind `nudge`: text, opportunity, evidence_ms, delivered_ms,
    stale) -> (matched, useful, repeated, stale): a nudge matches the first free opportunity of its time and kind; one of a taken one, or of the
    same text within repeat_ms, is a repetition.
    """

    def step(s: dict, row: dict) -> tuple[dict, list[tuple]]:
        if row["kind"] == "label":
            s["open"].append([row["name"], row["opportunity"], int(row["start_ms"]), int(row["end_ms"])])
            return s, []
        fits = [o for o in s["open"] if o[2] <= row["evidence_ms"] <= o[3] and o[1] in (None, row["opportunity"])]
        free = next((o[0] for o in fits if o[0] not in s["taken"]), None)
        said = f"{row['opportunity']}:{' '.join((row['text'] or '').lower().split())}"
        repeated = (free is None and bool(fits)) or (said in s["said"] and row["delivered_ms"] - s["said"][said] <= repeat_ms)
        s["said"][said] = int(row["delivered_ms"])
        if free is not None:
            s["taken"].append(free)
        return s, [(free, free is not None, repeated, bool(row["stale"]))]

    return Operator(step, {"open": [], "taken": [], "said": {}}, "matched string, useful boolean, repeated boolean, stale boolean")


def nudge_scores(rows: DataFrame, fixture: str = "fixture") -> DataFrame:
    """One row of counts and ratios over all fixtures: nudges, useful, repeated, stale, opportunities, precision, recall. rows: as `judged` takes, with the fixture."""
    labels = rows.where("kind = 'label'").agg(F.count("*").alias("opportunities"))
    out = judged().replay(rows, fixture, ["kind", "delivered_ms", "start_ms", "name"])
    sums = out.agg(F.count("*").alias("nudges"), *(F.count_if(c).alias(c) for c in ("useful", "repeated", "stale")))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6)).otherwise(1.0)
    return sums.join(labels).withColumns({"precision": ratio("useful", "nudges"), "recall": ratio("useful", "opportunities")})  # two rows of one
