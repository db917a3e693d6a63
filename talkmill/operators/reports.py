"""Reports over meetings and their items: consistency, stale commitments, research, profiles, relationships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkmill.functions.text import commitment_status, days_since, name_rank, normalize_decision, normalize_topic, slugify
from talkmill.operators.filters import owner_matches
from talkmill.tables import dealt


def top(rows: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The k first rows of each key, with their rank."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn(name, place).where(F.col(name) <= k)


def newer_counts(meetings: DataFrame) -> DataFrame:
    """(date, newer): how many meetings of the corpus are strictly newer, for each distinct date.

    Meetings are counted by date first. Dates are then summed by month, so that the running sums over all
    history see months alone, and each month its own days.
    """
    days = meetings.where("date is not null").groupBy("date").agg(F.count("*").alias("n")).withColumn("month", F.trunc("date", "month"))
    months = days.groupBy("month").agg(F.sum("n").alias("of_month"))
    after = months.withColumn("later", F.coalesce(F.sum("of_month").over(Window.orderBy(F.desc("month")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("month").orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, -1)
    rows = days.withColumn("own", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(after.select("month", "later"), "month")
    return rows.select("date", (F.col("own") + F.col("later")).cast("long").alias("newer"))


def stale_commitments(meetings: DataFrame, items: DataFrame, as_of: str, stale_after_days: int = 14) -> DataFrame:
    """Open commitments and action items with a reason to be stale: age, newer meetings, a due date, no owner."""
    open_ = items.where((F.col("status") == "open") & F.col("kind").isin("commitment", "action-item"))
    rows = open_.join(meetings.select("meeting_id", "path", "date"), "meeting_id").join(newer_counts(meetings), "date")
    age = F.floor(F.timestamp_diff("SECOND", F.col("date"), F.lit(as_of).cast("timestamp_ntz")) / 86400).cast("long")
    rows = rows.withColumn("age_days", age)
    reasons = F.array(
        F.when(F.col("age_days") >= stale_after_days, F.concat("age_days", F.lit(" days old"))),
        F.when(F.col("newer") >= 3, F.concat("newer", F.lit(" newer meetings since"))),
        F.when(F.col("due").isNotNull() & ((F.col("newer") >= 1) | (F.col("age_days") >= 1)), F.concat(F.lit("still open with due date "), "due")),
        F.when(F.coalesce(F.trim("who"), F.lit("")) == "", F.lit("still open without an owner")),
    )
    rows = rows.withColumn("reasons", F.array_compact(reasons)).where(F.size("reasons") > 0)
    return rows.select("path", "kind", "what", "who", "due", "newer", "age_days", F.array_join("reasons", "; ").alias("reasons"))


def decision_conflicts(decisions: DataFrame) -> DataFrame:
    """Topics with more than one decision value: (topic, latest, latest_date, n_previous, n_values, resolution).

    decisions: (path, title, date, date_text, text, topic, supersedes). The latest is the last by date text, then by date, path and
    text. A conflict is resolved if there is one previous decision and `supersedes` names its date, its title (four bytes or more)
    or two of its words of four bytes or more. Each task keeps the latest and the one before, not the whole group.
    """
    rows = decisions.withColumn("key", F.when(normalize_topic(F.col("topic")) != "", normalize_topic(F.col("topic"))).otherwise(normalize_topic(F.col("text"))))
    rows = rows.where(F.col("key") != "")
    entry = F.struct("date_text", "date", "path", "text", "title", "supersedes")
    groups = rows.groupBy("key").agg(F.max(entry).alias("last"), F.min(entry).alias("first"), F.count("*").alias("n"), F.count_distinct(normalize_decision(F.col("text"))).alias("n_values"))
    long_words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: F.octet_length(w) >= 4))
    supersedes, title, what = (normalize_decision(F.coalesce(F.col(c), F.lit(""))) for c in ("last.supersedes", "first.title", "first.text"))
    dated = supersedes.contains(normalize_decision(F.substring_index("first.date_text", "T", 1)))
    named = (F.octet_length(title) >= 4) & supersedes.contains(title)
    shared = F.size(F.array_intersect(long_words(supersedes), long_words(what))) >= 2
    resolved = (F.col("n") == 2) & (supersedes != "") & (dated | named | shared)
    return groups.where("n_values > 1").select(
        F.col("key").alias("topic"), F.col("last.text").alias("latest"), F.col("last.date_text").alias("latest_date"), (F.col("n") - 1).alias("n_previous"), "n_values",
        F.when(resolved, F.concat(F.lit("Resolved by explicit supersedes: "), F.trim("last.supersedes"))).alias("resolution"),
    )


def relationship_map(meetings: DataFrame, items: DataFrame, as_of: str, limit: int, tasks: int | None = None) -> DataFrame:
    """People by score: (person, meeting_count, first_seen, last_seen, days_since, topic_count, open_commitments, top_topics, losing_touch, score).

    Score is meetings / (1 + days / 30) * min(topics / 3, 1); contact is being lost with three meetings or more and over 21 days.
    Items are summed by meeting and topic, then by person and topic, then by person; `tasks` share them.
    """
    people = meetings.groupBy("person_id", "person").agg(F.count("*").alias("meeting_count"), F.min("date").alias("first_seen"), F.max("date").alias("last_seen"))
    is_open = ((F.col("status") == "open") & (F.col("kind") != "decision")).cast("long")
    own = dealt(items.select("meeting_id", "topic", "status", "kind"), tasks, "meeting_id").join(meetings.select("meeting_id", "person_id"), "meeting_id").groupBy("meeting_id", "person_id", "topic").agg(F.sum(is_open).alias("open"))
    counts = dealt(own, tasks, "person_id").groupBy("person_id", "topic").agg(F.count("*").alias("n"), F.sum("open").alias("open"))
    place = F.row_number().over(Window.partitionBy("person_id").orderBy(F.desc("n"), "topic"))
    first = F.array_sort(F.collect_list(F.when(F.col("place") <= 3, F.struct("place", "topic"))))
    topics = counts.withColumn("place", place).groupBy("person_id").agg(
        F.count("*").alias("topic_count"), F.sum("open").alias("open_commitments"), F.array_join(F.transform(first, lambda x: x["topic"]), ", ").alias("top_topics")
    )
    rows = people.join(topics, "person_id", "left")
    rows = rows.na.fill(0, ["topic_count", "open_commitments"]).withColumn("days_since", F.round(days_since(F.col("last_seen"), F.lit(as_of).cast("timestamp_ntz")), 6))
    score = F.col("meeting_count") / (1 + F.col("days_since") / 30) * F.least(F.col("topic_count") / 3, F.lit(1.0))
    rows = rows.withColumns({"losing_touch": (F.col("meeting_count") >= 3) & (F.col("days_since") > 21.0), "score": F.round(score, 6)})
    return rows.drop("person_id").orderBy(F.desc("score"), F.desc("meeting_count"), "person").limit(limit)


def top_commitments(meetings: DataFrame, items: DataFrame, limit: int) -> DataFrame:
    """Open commitments by date (the newest first), text, person and kind: (path, date, what, person, kind)."""
    rows = items.where((F.col("status") == "open") & F.col("kind").isin("commitment", "action-item"))
    rows = rows.join(meetings.select("meeting_id", "path", "date", "person"), "meeting_id")
    return rows.orderBy(F.desc("date"), "what", "person", "kind", "path").limit(limit).select("path", "date", "what", "person", "kind")


def commitment_rows(items: DataFrame) -> DataFrame:
    """(meeting_id, what, person, status, due): the commitments and action items among intents, done ones included; without an owner: `unassigned`."""
    rows = items.where(F.col("kind").isin("commitment", "action-item"))
    return rows.select("meeting_id", "what", F.coalesce(F.nullif(F.trim("who"), F.lit("")), F.lit("unassigned")).alias("person"), "status", "due")


#: How much a role says about a person's part in a meeting. Fixed values.
ROLES = ("mentioned", "speaker", "attendee")


def attendance(people: DataFrame) -> DataFrame:
    """(meeting_id, slug, person, role, aliases): each person of a meeting once, by slug, with the strongest role and all spellings.

    people: (meeting_id, person, role), the union of all sources of names. Names without a slug go.
    """
    rank = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role"))
    rows = people.withColumns({"slug": slugify(F.col("person")), "rank": rank}).where("slug <> ''")
    best = F.max(F.struct("rank", "role"))["role"]
    return rows.groupBy("meeting_id", "slug").agg(F.min(name_rank(F.col("slug"), F.col("person")))["name"].alias("person"), best.alias("role"), F.array_sort(F.collect_set("person")).alias("aliases"))


def decisions_of(people: DataFrame, meetings: DataFrame, items: DataFrame, role: str) -> DataFrame:
    """(person, topic, n, last): the decisions of meetings that a person attended in a role. people: of `attendance`."""
    rows = people.where(F.col("role") == role).select("meeting_id", "person")
    found = items.where("kind = 'decision'").select("meeting_id", "topic").join(meetings.select("meeting_id", "date"), "meeting_id").join(rows, "meeting_id")
    return found.groupBy("person", "topic").agg(F.count("*").alias("n"), F.max("date").alias("last"))


def graph_stats(meetings: DataFrame, people: DataFrame, items: DataFrame) -> DataFrame:
    """One row: people, meetings, commitments, topics and people with other spellings. people: of `attendance`."""
    spelt = people.groupBy("slug").agg(F.count_distinct("person").alias("n"))
    a = spelt.agg(F.count("*").alias("people"), F.count_if(F.col("n") > 1).alias("with_aliases"))
    b = meetings.agg(F.count("*").alias("meetings"))
    c = items.agg(F.count_if(F.col("kind").isin("commitment", "action-item")).alias("commitments"), F.count_distinct("topic").alias("topics"))
    return a.join(b).join(c)  # three rows of one


def research(meetings: DataFrame, items: DataFrame, query: str, decisions: int = 10, intents: int = 10, topics: int = 5, recent: int = 10) -> DataFrame:
    """(section, rank, path, text, n): matched decisions, open intents, meetings and topics of a query, newest first.

    A decision matches in topic and text, another item in text, owner, status and due date. Topics count matches of every status.
    A meeting matches by its title or by an item of any status; n is then how many of its items match.
    """
    rows = items.join(meetings.select("meeting_id", "path", "date"), "meeting_id")
    is_decision = F.col("kind") == "decision"
    hay = F.when(is_decision, F.concat_ws(" ", "topic", "what")).otherwise(F.concat_ws(" ", "what", "who", "status", "due"))
    rows = rows.where(F.lower(hay).contains(query.lower()))
    order = [F.desc("date"), F.col("path"), F.col("what"), F.col("due"), F.col("l_quantity")]

    def section(name: str, found: DataFrame, k: int) -> DataFrame:
        first = found.orderBy(*order).limit(k)
        return first.select(F.lit(name).alias("section"), F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"), "path", F.col("what").alias("text"), F.lit(1).cast("long").alias("n"))

    counted = rows.groupBy("topic").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "topic").limit(topics)
    counted = counted.select(F.lit("topic").alias("section"), F.row_number().over(Window.orderBy(F.desc("n"), "topic")).cast("long").alias("rank"), F.lit(None).cast("string").alias("path"), F.col("topic").alias("text"), "n")
    titled = meetings.where(F.lower("title").contains(query.lower())).select("path", "date", "title", F.lit(0).alias("hit"))
    named = rows.join(meetings.select("meeting_id", "title"), "meeting_id").select("path", "date", "title", F.lit(1).alias("hit"))
    met = titled.unionByName(named).groupBy("path", "date", "title").agg(F.sum("hit").alias("n")).orderBy(F.desc("date"), "path").limit(recent)
    met = met.select(F.lit("meeting").alias("section"), F.row_number().over(Window.orderBy(F.desc("date"), "path")).cast("long").alias("rank"), "path", F.col("title").alias("text"), "n")
    found = section("decision", rows.where(is_decision), decisions).unionByName(section("intent", rows.where(~is_decision & (F.col("status") == "open")), intents))
    return found.unionByName(met).unionByName(counted)


def people_listing(people: DataFrame, meetings: DataFrame) -> DataFrame:
    """(slug, person, aliases, meeting_count, first_seen, last_seen): everybody of the meetings, other spellings as aliases. people: of `attendance`."""
    seen = people.join(meetings.select("meeting_id", "date"), "meeting_id").groupBy("slug").agg(
        F.min(name_rank(F.col("slug"), F.col("person")))["name"].alias("person"), F.count("*").alias("meeting_count"), F.min("date").alias("first_seen"), F.max("date").alias("last_seen")
    )
    spelt = people.select("slug", F.explode("aliases").alias("alias")).distinct().groupBy("slug").agg(F.array_sort(F.collect_set("alias")).alias("spelt"))
    rows = seen.join(spelt, "slug")
    return rows.select("slug", "person", F.array_except("spelt", F.array("person")).alias("aliases"), "meeting_count", "first_seen", "last_seen")


def profile_sections(meetings: DataFrame, people: DataFrame, items: DataFrame, selector: str, as_of: str, recent: int = 5, intents: int = 10, decisions: int = 5, topics: int = 5) -> DataFrame:
    """(section, rank, path, text, status, n): a person's newest meetings, live commitments, decisions and topics.

    people: of `attendance`, with all spellings. The selector names a person by slug, or by the slug of an alias; if it fits several
    people the query fails, because a profile must not mix them. Meetings, decisions and topics count where the person spoke or attended,
    topics once a meeting; commitments are the person's own, deduplicated, stale ones marked.
    """
    key = slugify(F.lit(selector))
    mine = people.where((F.col("slug") == key) | F.exists("aliases", lambda a: slugify(a) == key))
    several = F.concat(F.lit(f"{selector!r} fits several people: "), F.array_join(F.array_sort(F.collect_set("slug").over(Window.partitionBy())), ", "))
    # collect_set over the selector's own rows: slugs of one name, a handful
    one = mine.select("slug").distinct().withColumn("n", F.count("*").over(Window.partitionBy()))
    one = one.select(F.when(F.col("n") > 1, F.raise_error(several)).otherwise(F.col("slug")).cast("string").alias("slug"))
    met = people.join(F.broadcast(one), "slug").where(F.col("role").isin("attendee", "speaker")).select("meeting_id").distinct()
    own = meetings.join(met, "meeting_id").select("meeting_id", "path", "date", "title")
    theirs = items.withColumn("slug", slugify(F.col("who"))).join(F.broadcast(one), "slug").drop("slug")
    live = dedup_commitments(theirs, as_of).join(meetings.select("meeting_id", "path", "date"), "meeting_id")
    inside = items.join(own.select("meeting_id", "path", "date"), "meeting_id")

    def section(name: str, rows: DataFrame, text: str, status: Column, k: int) -> DataFrame:
        order = [F.desc("date"), F.col(text), F.col("path")] if name != "meeting" else [F.desc("date"), F.col("path")]
        first = rows.orderBy(*order).limit(k)
        place = F.row_number().over(Window.orderBy(*order)).cast("long")  # over k rows
        return first.select(F.lit(name).alias("section"), place.alias("rank"), "path", F.col(text).alias("text"), status.alias("status"), F.lit(1).cast("long").alias("n"))

    none = F.lit(None).cast("string")
    order = [F.desc("n"), F.col("topic")]
    counted = inside.select("meeting_id", "topic").distinct().groupBy("topic").agg(F.count("*").alias("n")).orderBy(*order).limit(topics)
    counted = counted.select(F.lit("topic").alias("section"), F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"), none.alias("path"), F.col("topic").alias("text"), none.alias("status"), "n")
    parts = section("meeting", own, "title", none, recent).unionByName(section("intent", live, "what", F.col("status"), intents))
    return parts.unionByName(section("decision", inside.where("kind = 'decision'").select("path", "date", "what").distinct(), "what", none, decisions)).unionByName(counted)


def person_profile(meetings: DataFrame, items: DataFrame, name: str, exact: bool = False) -> DataFrame:
    """One row for the people whose name contains the text, or (exact) has its slug: meetings, first and last seen, decisions, open intents, top topics."""
    own = meetings.where(slugify(F.col("person")) == slugify(F.lit(name)) if exact else F.lower("person").contains(name.lower()))
    seen = own.agg(F.count("*").alias("n_meetings"), F.min("date").alias("first_seen"), F.max("date").alias("last_seen"), F.sum("duration_min").alias("duration_min"))
    rows = items.join(own.select("meeting_id"), "meeting_id", "left_semi")
    counts = rows.agg(
        F.count_if(F.col("kind") == "decision").alias("n_decisions"),
        F.count_if((F.col("kind") != "decision") & (F.col("status") == "open")).alias("n_open_intents"),
    )
    best = rows.groupBy("topic").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "topic").limit(5)
    best = best.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "topic"))), lambda x: x["topic"]), ", ").alias("topics"))
    return seen.join(counts).join(best)  # three rows of one


def dedup_commitments(items: DataFrame, as_of: str, owner: str | None = None) -> DataFrame:
    """(meeting_id, what, who, due, status, n): live commitments and action items, one row for each (meeting, text, owner, due), case and blanks aside.

    Only open and stale ones live; an open one past its due date is stale, and one stale duplicate makes the row stale. `owner` keeps
    those of one owner, by normalised equality or slug. Of the spellings of a text the first in the order of characters stays.
    """
    rows = items.where(F.col("kind").isin("commitment", "action-item")).withColumn("state", commitment_status(F.col("status"), F.col("due"), F.lit(as_of).cast("timestamp_ntz"))).where("state is not null")
    if owner is not None:
        rows = rows.where(owner_matches(F.col("who"), owner))
    fold = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    groups = rows.groupBy("meeting_id", *(fold(F.col(c)).alias(f"k_{c}") for c in ("what", "who", "due")))
    stale = F.bool_or(F.col("state") == "stale")
    out = groups.agg(F.min("what").alias("what"), F.min("who").alias("who"), F.min("due").alias("due"), F.when(stale, "stale").otherwise("open").alias("status"), F.count("*").alias("n"))
    return out.drop("k_what", "k_who", "k_due")


def commitments_by_status(meetings: DataFrame, items: DataFrame, as_of: str) -> DataFrame:
    """(person, status, n): commitments of each person, open or stale by their due dates."""
    rows = items.where("kind <> 'decision'").withColumn("state", commitment_status(F.col("status"), F.col("due"), F.lit(as_of).cast("timestamp_ntz")))
    rows = rows.where("state is not null").join(meetings.select("meeting_id", "person"), "meeting_id")
    return rows.groupBy("person", F.col("state").alias("status")).agg(F.count("*").alias("n"))


def shared_meetings(attendance: DataFrame, tasks: int | None = None) -> DataFrame:
    """(a, b, n): how many meetings each pair of people shares. attendance: (meeting_id, person). `tasks` share the meetings, and then the pairs."""
    one = dealt(attendance, tasks, "meeting_id").distinct()
    pairs = one.withColumnRenamed("person", "a").join(one.withColumnRenamed("person", "b"), "meeting_id").where("a < b")
    return dealt(pairs.select("a", "b"), tasks, "a", "b").groupBy("a", "b").agg(F.count("*").alias("n"))


def dashboard(meetings: DataFrame) -> DataFrame:
    """Totals of a corpus in one row."""
    return meetings.agg(
        F.count("*").alias("meetings"), F.round(F.sum("duration_min") / 60, 2).alias("hours"), F.count_distinct("person_id").alias("people"),
        F.count_if(F.col("duration_min").isNull() | (F.col("duration_min") == 0)).alias("duration_skipped"), F.count_if(F.col("sensitivity") == "restricted").alias("restricted"),
    )
