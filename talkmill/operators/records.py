"""Records around meetings: phrases to expect, jobs, calendars, owners, voices, facts, chunks, scores."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkmill.functions import noise
from talkmill.functions import text as T
from talkmill.operators import cleaning
from talkmill.operators.identity import near_keys

#: Phrases that announce a commitment. Fixed values.
COMMITMENT_PHRASES = ("i'll send", "i will send", "let me follow up", "i'll follow up", "action item:", "todo:", "i'll get", "i will get", "let me check", "i'll look into")
#: What a provider's privacy class adds to its score. Fixed values.
PRIVACY_PENALTY = {"on_device": 0, "local_service": 25, "cloud": 250}


def boost_phrases(meetings: DataFrame, limit: int) -> DataFrame:
    """(place, phrase): people by meetings and last meeting, then title words by newest meeting; each phrase once, case aside; the first `limit`."""
    people = meetings.groupBy("person").agg(F.count("*").alias("n"), F.max("date").alias("last"))
    first = people.select(F.col("person").alias("phrase"), F.lit(0).alias("tier"), (-F.col("n")).alias("a"), F.col("last").alias("b"))
    words = meetings.select(F.explode(T.title_keywords(F.col("title"))).alias("phrase"), "date").groupBy("phrase").agg(F.max("date").alias("b"))
    rows = first.unionByName(words.select("phrase", F.lit(1).alias("tier"), F.lit(0).cast("long").alias("a"), "b"))
    own = F.struct("tier", "a", (-F.unix_timestamp(F.col("b").cast("timestamp"))).alias("b"), "phrase")
    best = rows.groupBy(F.lower("phrase").alias("k")).agg(F.min(own).alias("o")).orderBy("o").limit(limit)
    return best.select(F.row_number().over(Window.orderBy("o")).cast("long").alias("place"), F.col("o.phrase").alias("phrase"))


def job_list(jobs: DataFrame, limit: int) -> DataFrame:
    """Running jobs, then queued, failed and others; in each the newest first. jobs: (job, state, created)."""
    bucket = F.when(F.col("state") == "running", 0).when(F.col("state") == "queued", 1).when(F.col("state") == "failed", 2).otherwise(3)
    return jobs.orderBy(bucket, F.desc("created"), "job").limit(limit)


def next_job(jobs: DataFrame) -> DataFrame:
    return jobs.where("state = 'queued'").orderBy("created", "job").limit(1)


def calendar_match(meetings: DataFrame, entries: DataFrame, day: str = "day") -> DataFrame:
    """(meeting_id, entry): of a day's calendar entries that share a title word, the nearest in time, ties to the least entry.

    Both: (day, title, at in seconds); entries: (entry). Meetings never meet a day's entries: for each word of a day only the least entry of each moment is kept,
    and a moment at which a meeting begins takes the last moment of an entry before it and the first after it. A missing moment is the farthest.
    """
    words = lambda df, key: df.select(day, key, "at", F.explode(F.array_distinct(T.title_keywords(F.col("title")))).alias("w"))
    asked = words(meetings, "meeting_id").where(F.col(day).isNotNull())
    given = words(entries, "entry").where(F.col(day).isNotNull()).groupBy(day, "w", "at").agg(F.min("entry").alias("entry"))
    moments = asked.select(day, "w", "at").distinct().withColumn("entry", F.lit(None).cast(given.schema["entry"].dataType))
    own = Window.partitionBy(day, "w")
    met = F.when(F.col("entry").isNotNull() & F.col("at").isNotNull(), F.struct("at", "entry"))
    rows = given.unionByName(moments).withColumns({"before": F.max(met).over(own.orderBy("at")), "after": F.min(met).over(own.orderBy(F.desc("at"))), "least": F.min("entry").over(own)})
    rated = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.lit(False).alias("far"), F.abs(F.col(f"{c}.at") - F.col("at")).alias("gap"), F.col(f"{c}.entry").alias("entry")))
    away = F.col("at").isNull() | (F.col("before").isNull() & F.col("after").isNull())
    farthest = F.struct(F.lit(True).alias("far"), F.lit(0).cast(rows.schema["at"].dataType).alias("gap"), F.col("least").alias("entry"))
    near = rows.where("entry is null and least is not null").select(day, "w", F.col("at").alias("m_at"), F.when(away, farthest).otherwise(F.least(rated("before"), rated("after"))).alias("near"))
    same = F.col("m.at").eqNullSafe(F.col("n.m_at")) & (F.col(f"m.{day}") == F.col(f"n.{day}")) & (F.col("m.w") == F.col("n.w"))
    return asked.alias("m").join(near.alias("n"), same).groupBy("m.meeting_id").agg(F.min("n.near")["entry"].alias("entry"))


def withheld_owners(items: DataFrame, labels: DataFrame) -> DataFrame:
    """items without owners where a meeting of several people has one speaker label or none. labels: (meeting_id, n_people, n_labels)."""
    rows = items.join(labels, "meeting_id", "left")
    hidden = (F.coalesce("n_people", F.lit(0)) > 1) & (F.coalesce("n_labels", F.lit(0)) <= 1)
    return rows.withColumns({"who": F.when(~hidden, F.col("who")), "withheld": hidden & F.col("who").isNotNull()}).drop("n_people", "n_labels")


def unanimous_voices(votes: DataFrame, least: float) -> DataFrame:
    """(meeting, speaker, profile): speakers all of whose segments name one profile well enough, and which no other speaker of the meeting has.

    votes: (meeting, speaker, profile, similarity).
    """
    rows = votes.groupBy("meeting", "speaker").agg(F.min("profile").alias("profile"), F.max("profile").alias("other"), F.min("similarity").alias("low"), F.count_if(F.col("profile").isNull()).alias("unknown"))
    sure = rows.where((F.col("profile") == F.col("other")) & (F.col("low") >= least) & (F.col("unknown") == 0))
    alone = sure.groupBy("meeting", "profile").agg(F.count("*").alias("n")).where("n = 1")
    return sure.join(alone, ["meeting", "profile"]).select("meeting", "speaker", "profile")


def mapping_lines(text: Column) -> Column:
    """(label, name) of lines such as `SPEAKER_1 = Name` or `SPEAKER_1: Name`; unknown names go."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\s*[-*]?\s*[A-Z]+_[0-9]+\s*[:=]\s*\S") & ~x.rlike(r"(?i)[:=]\s*(unknown|n/a|none)\s*$"))
    return F.transform(lines, lambda x: F.struct(F.regexp_extract(x, "([A-Z]+_[0-9]+)", 1).alias("label"), F.trim(F.regexp_extract(x, "[:=](.*)$", 1)).alias("name")))


def facts(meetings: DataFrame, items: DataFrame) -> DataFrame:
    """(person, kind, text, n): a fact for each item of a person; a presence fact only for those without another."""
    rows = items.where("who is not null").groupBy(F.col("who").alias("person"), "kind", F.col("what").alias("text")).agg(F.count("*").alias("n"))
    present = meetings.groupBy("person").agg(F.count("*").alias("n")).join(rows.select("person").distinct(), "person", "left_anti")
    return rows.unionByName(present.select("person", F.lit("presence").alias("kind"), F.lit("attended").alias("text"), "n"))


def chunks(documents: DataFrame, tokens: int, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, chunk, start, chars): parts of whole lines that hold at most 4 * tokens characters, longer lines by themselves. Python sees the lengths of lines alone."""
    most = 4 * tokens

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, sizes in zip(b[key], b["sizes"]):
                at, size, n = 0, 0, 0
                for length in sizes.tolist():
                    if size and size + length > most:
                        out.append((k, n, at, size))
                        at, size, n = at + size, 0, n + 1
                    size += length + 1
                if size > 1 or n:
                    out.append((k, n, at, size))
            yield pd.DataFrame(out, columns=[key, "chunk", "start", "chars"])

    sizes = F.transform(F.split(F.coalesce(F.col(column).cast("string"), F.lit("")), "\n"), F.length).alias("sizes")
    return documents.where(F.col(key).isNotNull()).select(F.col(key).cast("long"), sizes).mapInPandas(each, f"{key} long, chunk int, start long, chars long")


def live_texts(lines: DataFrame) -> DataFrame:
    """(doc_id, text): live transcript lines (doc_id, pos, line) without labels, foreign script and noise markers, joined by blanks; texts without a line left go."""
    bare = lines.withColumn("line", F.trim(noise.text_part(F.col("line")))).where("line <> ''")
    kept = cleaning.collapse_noise(cleaning.drop_foreign_script(bare))
    body = F.trim(noise.text_part(F.col("line")))
    short = F.regexp_replace(body, r"\.$", "")
    inner = F.substring(short, F.lit(2), F.length(short) - 2)
    marker = short.startswith("[") & short.endswith("]") & ~inner.rlike("^[0-9:]*$") & F.size(T.words(inner)).between(1, 4) & (F.octet_length(inner) <= 40)
    kept = kept.withColumn("line", body).where((F.col("line") != "") & ~marker)
    return cleaning.transcript_text(kept, " ")


def commitment_lines(lines: DataFrame) -> DataFrame:
    """lines (doc_id, pos, line) that announce a commitment, as `text` without labels, if that has over ten bytes; and the first phrase found."""
    low, text = F.lower(F.trim("line")), F.trim(F.regexp_extract(F.trim("line"), r"([^\]]*)$", 1))
    phrase = F.coalesce(*(F.when(low.contains(p), F.lit(p)) for p in COMMITMENT_PHRASES))
    return lines.withColumns({"text": text, "phrase": phrase}).where(F.col("phrase").isNotNull() & (F.octet_length("text") > 10)).select("doc_id", "pos", "text", "phrase")


def sync_counters(indexed: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """(indexed, updated, removed, same) of a refresh. Both: (key, revision)."""
    both = indexed.select(key, F.col("revision").alias("a")).join(current.select(key, F.col("revision").alias("b")), key, "full")
    return both.agg(
        F.count_if(F.col("a").isNull()).alias("indexed"), F.count_if(F.col("a") != F.col("b")).alias("updated"), F.count_if(F.col("b").isNull()).alias("removed"), F.count_if(F.col("a") == F.col("b")).alias("same")
    )


def excerpt(text: Column, size: int) -> Column:
    """At most `size` characters, cut at the last blank before."""
    return F.when(F.length(text) <= size, text).otherwise(F.regexp_extract(F.substring(text, 1, size), r"(?s)^(.*\S)\s", 1))


def why_matched(text: Column, aliases: dict[str, tuple[str, ...]]) -> Column:
    """`concept: alias` of the first alias of each concept that a text holds."""
    low = F.lower(text)
    parts = [F.coalesce(*(F.when(low.contains(a), F.lit(f"{c}: {a}")) for a in own)) for c, own in aliases.items()]
    return F.concat_ws("; ", *parts)


def name_corrections(tokens: DataFrame, names: DataFrame) -> DataFrame:
    """(token, name): tokens that are no name but have one candidate of one key, or else one candidate an edit away (two from six letters on).

    names: (name). Candidates meet by key, or by what is left after deletions.
    """
    own = names.select("name", T.compact_key(F.col("name")).alias("key")).distinct()
    asked = tokens.select("token", T.compact_key(F.col("token")).alias("t_key")).distinct().join(names.select(F.col("name").alias("token")), "token", "left_anti")
    same = asked.join(own, asked["t_key"] == own["key"]).select("token", "name", F.lit(0).alias("tier"))
    met = near_keys(asked, "token", "t_key").join(near_keys(own, "name", "key"), "block").select("token", "name").distinct()
    pairs = met.join(asked, "token").join(own, "name")
    pairs = pairs.where(F.substring("t_key", 1, 1) == F.substring("key", 1, 1))
    budget = F.when(F.least(F.length("t_key"), F.length("key")) >= 6, 2).otherwise(1)
    edits = pairs.where((F.col("t_key") != F.col("key")) & (F.length("t_key") >= 4) & F.levenshtein("t_key", "key", 2).between(0, budget)).select("token", "name", F.levenshtein("t_key", "key", 2).alias("tier"))
    rows = same.unionByName(edits)
    best = rows.groupBy("token").agg(F.min("tier").alias("tier"))
    return rows.join(best, ["token", "tier"]).groupBy("token").agg(F.min("name").alias("name"), F.max("name").alias("other")).where("name = other").select("token", "name")


def scorecard(rows: DataFrame, truth: str, said: str) -> DataFrame:
    """One row of counts and ratios: right, wrong, missed and spurious answers; null means no answer."""
    t, s = F.col(truth), F.col(said)
    hit, wrong, missed, spurious = (F.count_if(x) for x in (t == s, (t != s), t.isNotNull() & s.isNull(), t.isNull() & s.isNotNull()))
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 6))
    return rows.agg(hit.alias("right"), wrong.alias("wrong"), missed.alias("missed"), spurious.alias("spurious"), ratio(hit, hit + wrong + spurious).alias("precision"), ratio(hit, hit + wrong + missed).alias("recall"))


def routed(candidates: DataFrame, key: str, target_ms: int) -> DataFrame:
    """(key, provider, score): of the usable providers the one of the least score, ties to the least place. candidates: (provider, place, ms, privacy, usable).

    Score is the measured latency, a penalty for the privacy class, and once more what the latency has over the target.
    """
    penalty = F.create_map(*(F.lit(x) for kv in PRIVACY_PENALTY.items() for x in kv))[F.col("privacy")]
    score = F.col("ms") + penalty + F.greatest(F.col("ms") - target_ms, F.lit(0))
    best = candidates.where("usable").groupBy(key).agg(F.min(F.struct(score.cast("long").alias("score"), "place", "provider")).alias("b"))
    return best.select(key, F.col("b.provider").alias("provider"), F.col("b.score").alias("score"))


def latest_links(sessions: DataFrame, links: DataFrame) -> DataFrame:
    """(session, kind, target): the latest link of each session and kind. links: (session, kind, target, at)."""
    rows = links.join(sessions.select("session").distinct(), "session", "left_semi")
    return rows.groupBy("session", "kind").agg(F.max(F.struct("at", "target"))["target"].alias("target"))
