"""Named queries over meetings, items and insights, each with its SQL twin.

"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.functions import text as T
from talkmill.operators import filters, reports
from talkmill.plans import mapping as M
from talkmill.plans.mapping import AS_OF, SQL


def list_meetings(spark: SparkSession, sf: str) -> DataFrame:
    """Filtered listing, newest first."""
    f = filters.SearchFilters(type="meeting", since="1998-01-01T00:00:00", person="customer#0000001", recorded_by="high")
    return filters.list_meetings(M.meetings(spark, sf), f, 50).select("path", "date_text", "title")


def list_since_instant(spark: SparkSession, sf: str) -> DataFrame:
    """Since as an instant, unrestricted, newest first."""
    rows = filters.since_instant(M.meetings(spark, sf), "2000-06-01 00:00:00").where(filters.unrestricted())
    return filters.newest(rows, 100).select("path", "date_text", "type")


def restricted_stubs(spark: SparkSession, sf: str) -> DataFrame:
    """All meetings of a person, restricted ones as stubs."""
    rows = M.all_meetings(spark, sf)
    return filters.with_stubs(rows).select("path", "date_text", "title", "person")


def text_search(spark: SparkSession, sf: str) -> DataFrame:
    """Substring search over several columns."""
    return filters.text_search(M.meetings(spark, sf), ["title", "recorded_by", "type"], "1 priority 5").select("path", "title")


def insights_strong(spark: SparkSession, sf: str) -> DataFrame:
    """The last insights of a kind and of at least a confidence."""
    return filters.filter_insights(M.insights(spark, sf), "purchase", "strong", 40).select("seq", "user_id", "confidence", "content")


def events_after(spark: SparkSession, sf: str) -> DataFrame:
    """The first events after a cursor."""
    return filters.events_since(M.insights(spark, sf), 5000, 200).select("seq", "kind", "content")


def insight_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Insights with a key that no insight of the first half has, once each."""
    rows = M.insights(spark, sf).withColumn("k", F.lower(F.trim("content")))
    old = rows.where("seq < 2000").select("kind", "k")
    new = rows.where("seq >= 2000").groupBy("kind", "k").agg(F.min("seq").alias("seq"))
    return new.join(old, ["kind", "k"], "left_anti").select("seq", "kind", F.col("k").alias("content"))


def retention_preview(spark: SparkSession, sf: str) -> DataFrame:
    """what a retention rule would keep and delete."""
    return filters.retention(M.all_meetings(spark, sf), AS_OF, {"meeting": 1500, "memo": 700, "dictation": 365})


def owner_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """Owners resolved by a speaker map, matched on either name."""
    items = M.items(spark, sf).where("kind = 'action-item'")
    names = M.load(spark, sf, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("Supplier "), "s_suppkey").alias("who"), F.col("s_name").alias("name"))
    rows = items.join(names, "who", "left").withColumn("resolved", F.coalesce("name", "who"))
    hit = F.lower("resolved").contains("00000004") | F.lower("who").contains("r 4")
    rows = rows.where(F.trim(F.coalesce("who", F.lit(""))) != "").where(hit)
    return rows.groupBy("resolved", F.when(F.col("name").isNotNull(), F.col("who")).alias("who_original")).agg(F.count("*").alias("n"))


def open_actions(spark: SparkSession, sf: str) -> DataFrame:
    """Open action items of an owner, newest meeting first."""
    rows = M.all_items(spark, sf).where("kind = 'action-item' and status = 'open'").where(F.lower("who") == "supplier 3")
    rows = rows.join(M.meetings(spark, sf).select("meeting_id", "path", "date_text"), "meeting_id")
    order = [F.desc("date_text"), "path", "what", "due", "l_quantity"]
    return rows.orderBy(*order).limit(60).select("path", "date_text", "what", "due", "l_quantity")


def intent_search(spark: SparkSession, sf: str) -> DataFrame:
    """Items whose title, text, owner, status or due date hold the query, with their kinds counted."""
    rows = M.all_items(spark, sf).join(M.meetings(spark, sf).where(filters.unrestricted()).select("meeting_id", "title"), "meeting_id")
    hay = F.lower(F.concat_ws(" ", "title", "what", "who", "status", "due"))
    return rows.where(hay.contains("brand#12 supplier 1")).groupBy("kind", "status").agg(F.count("*").alias("n"))


def decisions_by_topic(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions of a topic by year."""
    rows = M.all_items(spark, sf).where("kind = 'decision'").where(F.lower("topic").contains("eco"))
    rows = rows.join(M.meetings(spark, sf).select("meeting_id", "date"), "meeting_id")
    return rows.groupBy("topic", F.year("date").alias("year")).agg(F.count("*").alias("n"))


def top_topics(spark: SparkSession, sf: str) -> DataFrame:
    """The two leading topics of each person."""
    rows = M.all_items(spark, sf).join(M.meetings(spark, sf).select("meeting_id", "person"), "meeting_id")
    counts = rows.groupBy("person", "topic").agg(F.count("*").alias("n"))
    return reports.top(counts, ["person"], [F.desc("n"), F.col("topic")], 2).withColumn("rank", F.col("rank").cast("long"))


def relationship_map(spark: SparkSession, sf: str) -> DataFrame:
    """The relationship map."""
    return reports.relationship_map(M.meetings(spark, sf), M.all_items(spark, sf), AS_OF, 200, M.parts(spark, sf))


def stale_commitments(spark: SparkSession, sf: str) -> DataFrame:
    """Open items with reasons to be stale."""
    return reports.stale_commitments(M.meetings(spark, sf), M.all_items(spark, sf), AS_OF)


def decision_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Topics with several decisions, and whether the last one supersedes the one before."""
    rows = M.all_items(spark, sf).where("kind = 'decision'").join(M.meetings(spark, sf), "meeting_id")
    key = F.concat_ws(" ", "person", "topic")
    return reports.decision_conflicts(rows.select(
        "path", "title", "date", "date_text", F.concat("what", F.lit(" due "), "due").alias("text"), key.alias("topic"),
        F.when(F.col("l_quantity") % 2 == 0, F.concat(F.lit("replaces the "), "what")).alias("supersedes"),
    ))


def research_topic(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions, open intents and topics of a query."""
    return reports.research(M.meetings(spark, sf), M.all_items(spark, sf), "blue")


def person_profile(spark: SparkSession, sf: str) -> DataFrame:
    """A profile by name."""
    return reports.person_profile(M.meetings(spark, sf), M.all_items(spark, sf), "#00000012")


def person_exact(spark: SparkSession, sf: str) -> DataFrame:
    """A profile by exact identity."""
    return reports.person_profile(M.meetings(spark, sf), M.all_items(spark, sf), "customer 000000012", exact=True)


def search_filters(spark: SparkSession, sf: str) -> DataFrame:
    """meetings with an attendee, an intent of a kind and an owner."""
    f = filters.SearchFilters(type="meeting", attendee="supplier 1", intent_kind="action-item", owner="supplier 2")
    rows = f.among(M.meetings(spark, sf), M.all_attendees(spark, sf), M.all_items(spark, sf))
    return filters.newest(rows, 500).select("path", "date_text")


def insights_of(spark: SparkSession, sf: str) -> DataFrame:
    """the last insights of a participant or owner since a moment."""
    rows = M.insights(spark, sf).withColumns({"participants": F.array(F.concat(F.lit("User "), "user_id"), "kind"), "owner": F.when(F.col("seq") % 3 == 0, F.concat(F.lit("Owner "), F.col("user_id") % 10))})
    return filters.filter_insights(rows, None, "inferred", 300, participant="R 1", since="2024-01-02 00:00:00").select("seq", "kind", "user_id", "confidence")


def last_events(spark: SparkSession, sf: str) -> DataFrame:
    """the last events since a moment."""
    return filters.last_events(M.insights(spark, sf), "2024-01-03 12:00:00", 150).select("seq", "kind", "content")


def owned_actions(spark: SparkSession, sf: str) -> DataFrame:
    """Intents of one owner by normalised equality or slug."""
    rows = M.items(spark, sf).where(filters.owner_matches(F.col("who"), "  supplier-8 "))
    return rows.groupBy("who", "kind", "status").agg(F.count("*").alias("n"))


def exact_meeting(spark: SparkSession, sf: str) -> DataFrame:
    """A meeting by its path."""
    return filters.exact_meeting(M.meetings(spark, sf), "order-7").select("path", "date_text", "title", "person", "duration_min")


def top_commitments(spark: SparkSession, sf: str) -> DataFrame:
    """Open commitments by date, text, person and kind."""
    return reports.top_commitments(M.meetings(spark, sf), M.all_items(spark, sf), 400).drop("date")


def commitment_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Commitment rows from intents, counted by person, status and due month."""
    rows = reports.commitment_rows(M.items(spark, sf))
    return rows.groupBy("person", "status", F.substring("due", 1, 7).alias("month")).agg(F.count("*").alias("n"), F.min("what").alias("first_what"))


def meeting_people(spark: SparkSession, sf: str) -> DataFrame:
    """People of each meeting once, with their strongest role; how many meetings each has in each role."""
    rows = reports.attendance(M.attendees(spark, sf))
    return rows.groupBy("slug", "person", "role").agg(F.count("*").alias("n"))


def decisions_by_role(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions of meetings in which a person spoke."""
    return reports.decisions_of(reports.attendance(M.all_attendees(spark, sf)), M.meetings(spark, sf), M.all_items(spark, sf), "speaker")


def graph_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Totals of the graph."""
    return reports.graph_stats(M.meetings(spark, sf), _spelt(spark, sf), M.items(spark, sf))


def commitment_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Commitments deduplicated within a meeting, by the first word of their topic; every tenth open one is stale by its own words."""
    items = M.items(spark, sf)
    marked = F.when((F.col("status") == "open") & (F.col("l_quantity") % 10 == 0), "stale").otherwise(F.col("status"))
    rows = items.withColumns({"what": F.substring_index("topic", " ", 1), "who": F.when(F.col("who").isNotNull(), "The  Team"), "due": F.concat(F.substring("due", 1, 4), F.lit("-07-01")), "status": marked})
    rows = reports.dedup_commitments(rows, "1998-06-15 00:00:00")
    return rows.groupBy("status", "n", "who").agg(F.count("*").alias("groups"), F.max("what").alias("last_what"))


def owned_commitments(spark: SparkSession, sf: str) -> DataFrame:
    """The live commitments of one owner, stale ones marked."""
    rows = reports.dedup_commitments(M.items(spark, sf), "1998-06-15 00:00:00", owner=" SUPPLIER 8")
    return rows.select("meeting_id", "what", "who", "due", "status", "n")


def _spelt(spark: SparkSession, sf: str) -> DataFrame:
    """Attendance where those who are only mentioned are written in capitals."""
    rows = M.attendees(spark, sf).withColumn("person", F.when(F.col("role") == "mentioned", F.upper("person")).otherwise(F.col("person")))
    return reports.attendance(rows)


def people_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Everybody with other spellings, meetings, first and last seen."""
    return reports.people_listing(_spelt(spark, sf), M.meetings(spark, sf)).withColumn("aliases", F.array_join("aliases", "|"))


def profile_sections(spark: SparkSession, sf: str) -> DataFrame:
    """A profile as lists: 5 meetings, 10 commitments, 5 decisions, 5 topics."""
    return reports.profile_sections(M.meetings(spark, sf), _spelt(spark, sf), M.items(spark, sf), "supplier-12", "1998-06-15 00:00:00")


def commitment_status(spark: SparkSession, sf: str) -> DataFrame:
    """Open and stale commitments of each person."""
    return reports.commitments_by_status(M.meetings(spark, sf), M.all_items(spark, sf), "1999-01-01 00:00:00")


def co_attendance(spark: SparkSession, sf: str) -> DataFrame:
    """How often two suppliers stand in one order."""
    rows = M.items(spark, sf).where("who is not null").select("meeting_id", F.col("who").alias("person"))
    return reports.shared_meetings(rows, M.parts(spark, sf)).where("n >= 2")


def dashboard(spark: SparkSession, sf: str) -> DataFrame:
    """Totals."""
    return reports.dashboard(M.all_meetings(spark, sf))


def tag_frequency(spark: SparkSession, sf: str) -> DataFrame:
    """Topics as tags, by how many meetings have them."""
    rows = M.items(spark, sf).groupBy("topic").agg(F.count_distinct("meeting_id").alias("n"))
    return rows.orderBy(F.desc("n"), "topic").limit(20)


def authorised_release(spark: SparkSession, sf: str) -> DataFrame:
    """Items of authorised meetings, and how many are withheld."""
    items, ok = M.all_items(spark, sf), M.all_meetings(spark, sf).where(filters.unrestricted()).select("meeting_id")
    kept = items.join(ok, "meeting_id", "left_semi").agg(F.count("*").alias("released"))
    return kept.join(items.join(ok, "meeting_id", "left_anti").agg(F.count("*").alias("withheld")))  # two rows of one


def expansion_union(spark: SparkSession, sf: str) -> DataFrame:
    """A search under several expansions; the first that finds a path owns it."""
    rows = M.meetings(spark, sf).select("path", "title").withColumn("low", F.lower("title"))
    parts = None
    for i, q in enumerate(("0012", "priority 2", "0003")):
        own = rows.where(F.col("low").contains(q)).select("path", F.lit(i).alias("place"), F.lit(q).alias("query"))
        parts = own if parts is None else parts.unionByName(own)
    best = parts.groupBy("path").agg(F.min(F.struct("place", "query")).alias("b"))
    return best.groupBy(F.col("b.query").alias("query")).agg(F.count("*").alias("n"), F.min("path").alias("first_path"))


def title_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Slugs, topics, decision values, keywords and keys of titles."""
    t = F.col("title")
    return M.meetings(spark, sf).select(t, T.slugify(t).alias("slug"), T.normalize_topic(t).alias("topic"), T.normalize_decision(t).alias("value"), F.array_join(T.title_keywords(t), " ").alias("keywords"), T.compact_key(t).alias("key")).distinct()


def duration_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Duration texts parsed, those of restricted meetings too: the reference's dashboard reads every meeting."""
    m = F.col("duration_min")
    text = F.when(m % 3 == 0, F.concat(F.floor(m / 60), F.lit("h "), m % 60, F.lit("m"))).when(m % 3 == 1, F.concat(m, F.lit("m 5s"))).otherwise(F.concat(F.floor(m / 60), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0"), F.lit(":07")))
    return M.all_meetings(spark, sf).select("path", text.alias("text"), T.clock_seconds(text).alias("seconds"), T.duration_seconds(text).alias("plain_seconds"))


def corpus_revision(spark: SparkSession, sf: str) -> DataFrame:
    """A revision of each type's meetings, independent of order: hashes of (path, content) added by halves."""
    h = F.sha2(F.concat_ws("|", "path", "title", "date_text"), 256)
    part = lambda i: F.sum(F.conv(F.substring(h, i, 8), 16, 10).cast("long"))
    return M.all_meetings(spark, sf).groupBy("type").agg(F.count("*").alias("n"), part(1).alias("first"), part(9).alias("second"))


def activity_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The kinds of events by number."""
    return M.insights(spark, sf).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.max("seq").alias("high_water"))


def newest_per_person(spark: SparkSession, sf: str) -> DataFrame:
    """The closest meetings to a moment, one for each person and type."""
    away = F.abs(F.timestamp_diff("SECOND", F.col("date"), F.lit("1998-06-15 00:00:00").cast("timestamp_ntz")) / 60)
    rows = M.meetings(spark, sf).withColumn("distance", F.round(away, 3))
    return reports.top(rows, ["person", "type"], [F.col("distance"), F.col("meeting_id")], 1).select("person", "type", "path", "distance")


QUERIES = {f.__name__: f for f in (
    list_meetings, list_since_instant, restricted_stubs, text_search, insights_strong, events_after, insight_dedup, retention_preview, owner_resolution, open_actions,
    intent_search, person_exact, search_filters, insights_of, last_events, owned_actions, exact_meeting, top_commitments, commitment_rows, meeting_people, decisions_by_role, graph_stats, decisions_by_topic, top_topics, relationship_map, stale_commitments, decision_conflicts, research_topic, person_profile, commitment_dedup, owned_commitments, people_listing, profile_sections,
    commitment_status, co_attendance, dashboard, tag_frequency, authorised_release, expansion_union, title_functions, duration_functions, corpus_revision, activity_summary, newest_per_person,
)}

_OPEN = "coalesce(sensitivity, 'normal') <> 'restricted'"
_TOPIC_STOP = ", ".join(f"'{w}'" for w in T.TOPIC_STOPWORDS)
_TITLE_STOP = ", ".join(f"'{w}'" for w in T.TITLE_STOPWORDS)
_NORM_TOPIC = """list_aggregate(list_transform(list_filter(list_transform(list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> ''),
    lambda w: regexp_replace(w, '^[^\\pL\\pN]+|[^\\pL\\pN]+$', '', 'g')), lambda w: w <> '' AND lower(w) NOT IN (""" + _TOPIC_STOP + """))[1:4], lambda w: lower(w)), 'string_agg', ' ')"""
_NORM_VALUE = "trim(regexp_replace(lower({0}), '[^\\pL\\pN]+', ' ', 'g'))"

ORACLE_SQL = {
    "list_meetings": SQL + f"SELECT path, date_text, title FROM meetings WHERE type = 'meeting' AND date_text >= '1998-01-01T00:00:00' AND lower(person) LIKE '%customer#0000001%' AND lower(recorded_by) LIKE '%high%' AND {_OPEN} ORDER BY date DESC, path LIMIT 50",
    "list_since_instant": SQL + f"SELECT path, date_text, type FROM meetings WHERE date >= TIMESTAMP '2000-06-01' AND {_OPEN} ORDER BY date DESC, path LIMIT 100",
    "restricted_stubs": SQL + f"SELECT path, date_text, CASE WHEN {_OPEN} THEN title ELSE 'restricted' END AS title, CASE WHEN {_OPEN} THEN person END AS person FROM all_meetings",
    "text_search": SQL + "SELECT path, title FROM meetings WHERE contains(lower(title), '1 priority 5') OR contains(lower(recorded_by), '1 priority 5') OR contains(type, '1 priority 5')",
    "insights_strong": SQL + "SELECT seq, user_id, confidence, content FROM insights WHERE kind = 'purchase' AND confidence IN ('strong', 'explicit') ORDER BY seq DESC LIMIT 40",
    "events_after": SQL + "SELECT seq, kind, content FROM insights WHERE seq > 5000 ORDER BY seq LIMIT 200",
    "insight_dedup": SQL + "SELECT min(seq) AS seq, kind, lower(trim(content)) AS content FROM insights n WHERE seq >= 2000 AND NOT EXISTS (SELECT 1 FROM insights o WHERE o.seq < 2000 AND o.kind = n.kind AND lower(trim(o.content)) = lower(trim(n.content))) GROUP BY kind, lower(trim(content))",
    "retention_preview": SQL + f"""SELECT type, CASE WHEN date_diff('day', date::DATE, TIMESTAMP '{AS_OF}'::DATE) > CASE type WHEN 'meeting' THEN 1500 WHEN 'memo' THEN 700 ELSE 365 END THEN 'delete' ELSE 'keep' END AS action,
        count(*) AS n, sum(duration_min)::BIGINT AS duration_min FROM all_meetings GROUP BY 1, 2""",
    "owner_resolution": SQL + """SELECT coalesce(s_name, who) AS resolved, CASE WHEN s_name IS NOT NULL THEN who END AS who_original, count(*) AS n
        FROM items LEFT JOIN supplier ON who = 'Supplier ' || s_suppkey AND s_suppkey % 2 = 0
        WHERE kind = 'action-item' AND who IS NOT NULL AND (contains(lower(coalesce(s_name, who)), '00000004') OR contains(lower(who), 'r 4')) GROUP BY 1, 2""",
    "open_actions": SQL + "SELECT path, date_text, what, due, l_quantity FROM items JOIN meetings USING (meeting_id) WHERE kind = 'action-item' AND status = 'open' AND lower(who) = 'supplier 3' ORDER BY date_text DESC, path, what, due, l_quantity LIMIT 60",
    "intent_search": SQL + f"SELECT kind, status, count(*) AS n FROM items JOIN meetings USING (meeting_id) WHERE {_OPEN} AND contains(lower(concat_ws(' ', title, what, who, status, due)), 'brand#12 supplier 1') GROUP BY 1, 2",
    "decisions_by_topic": SQL + "SELECT topic, year(date) AS year, count(*) AS n FROM items JOIN meetings USING (meeting_id) WHERE kind = 'decision' AND topic LIKE '%eco%' GROUP BY 1, 2",
    "top_topics": SQL + """, counts AS (SELECT person, topic, count(*) AS n FROM items JOIN meetings USING (meeting_id) GROUP BY 1, 2)
        SELECT *, row_number() OVER (PARTITION BY person ORDER BY n DESC, topic) AS rank FROM counts QUALIFY rank <= 2""",
    "relationship_map": SQL + f""", people AS (SELECT person_id, person, count(*) AS meeting_count, min(date) AS first_seen, max(date) AS last_seen FROM meetings GROUP BY 1, 2),
        counts AS (SELECT person_id, topic, count(*) AS n FROM meetings JOIN (SELECT DISTINCT meeting_id, topic FROM items) USING (meeting_id) GROUP BY 1, 2),
        best AS (SELECT person_id, string_agg(topic, ', ' ORDER BY n DESC, topic) AS top_topics FROM (SELECT * FROM counts QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY n DESC, topic) <= 3) GROUP BY 1),
        breadth AS (SELECT person_id, count(*) AS topic_count FROM counts GROUP BY 1),
        opened AS (SELECT person_id, count(*) AS open_commitments FROM items JOIN meetings USING (meeting_id) WHERE status = 'open' AND kind <> 'decision' GROUP BY 1),
        rows_ AS (SELECT person, meeting_count, first_seen, last_seen, coalesce(topic_count, 0) AS topic_count, top_topics, coalesce(open_commitments, 0) AS open_commitments,
            round(greatest(floor(date_diff('second', last_seen, TIMESTAMP '{AS_OF}') / 3600) / 24.0, 0.0), 6) AS days_since
            FROM people LEFT JOIN breadth USING (person_id) LEFT JOIN best USING (person_id) LEFT JOIN opened USING (person_id))
        SELECT *, meeting_count >= 3 AND days_since > 21 AS losing_touch, round(meeting_count / (1 + days_since / 30) * least(topic_count / 3, 1.0), 6) AS score
        FROM rows_ ORDER BY score DESC, meeting_count DESC, person LIMIT 200""",
    "stale_commitments": SQL + f""", newer AS (SELECT date, coalesce(sum(n) OVER (ORDER BY date DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS newer FROM (SELECT date, count(*) AS n FROM meetings GROUP BY 1)),
        rows_ AS (SELECT path, kind, what, who, due, newer, floor(date_diff('second', date, TIMESTAMP '{AS_OF}') / 86400)::BIGINT AS age_days
            FROM items JOIN meetings USING (meeting_id) JOIN newer USING (date) WHERE status = 'open' AND kind <> 'decision')
        SELECT *, concat_ws('; ', CASE WHEN age_days >= 14 THEN age_days || ' days old' END, CASE WHEN newer >= 3 THEN newer || ' newer meetings since' END,
            CASE WHEN due IS NOT NULL AND (newer >= 1 OR age_days >= 1) THEN 'still open with due date ' || due END, CASE WHEN who IS NULL THEN 'still open without an owner' END) AS reasons
        FROM rows_ WHERE reasons <> ''""",
    "decision_conflicts": SQL + f""", d AS (SELECT *, what || ' due ' || due AS text, {_NORM_TOPIC.format("concat_ws(' ', person, topic)")} AS key,
            CASE WHEN l_quantity % 2 = 0 THEN 'replaces the ' || what END AS supersedes FROM items JOIN meetings USING (meeting_id) WHERE kind = 'decision'),
        r AS (SELECT *, {_NORM_VALUE.format('text')} AS value, row_number() OVER (PARTITION BY key ORDER BY date_text DESC, date DESC, path DESC, text DESC, title DESC, supersedes DESC NULLS LAST) AS back,
            count(*) OVER (PARTITION BY key) AS n FROM d),
        g AS (SELECT key, n, count(DISTINCT value) AS n_values, max(text) FILTER (back = 1) AS latest, max(date_text) FILTER (back = 1) AS latest_date,
            coalesce(max({_NORM_VALUE.format('supersedes')}) FILTER (back = 1), '') AS s, max(supersedes) FILTER (back = 1) AS raw, max(text) FILTER (back = n) AS prev, max(title) FILTER (back = n) AS prev_title, max(date_text) FILTER (back = n) AS prev_date FROM r GROUP BY key, n)
        SELECT key AS topic, latest, latest_date, n - 1 AS n_previous, n_values, CASE WHEN n = 2 AND s <> '' AND (contains(s, {_NORM_VALUE.format("split_part(prev_date, 'T', 1)")})
            OR (strlen({_NORM_VALUE.format('prev_title')}) >= 4 AND contains(s, {_NORM_VALUE.format('prev_title')}))
            OR len(list_intersect(list_distinct(list_filter(string_split(s, ' '), lambda w: strlen(w) >= 4)), list_distinct(list_filter(string_split({_NORM_VALUE.format('prev')}, ' '), lambda w: strlen(w) >= 4)))) >= 2)
            THEN 'Resolved by explicit supersedes: ' || raw END AS resolution
        FROM g WHERE n_values > 1""",
    "research_topic": SQL + """, hits AS (SELECT * FROM items JOIN meetings USING (meeting_id) WHERE contains(lower(CASE WHEN kind = 'decision' THEN concat_ws(' ', topic, what) ELSE concat_ws(' ', what, who, status, due) END), 'blue')),
        a AS (SELECT 'decision' AS section, row_number() OVER (ORDER BY date DESC, path, what, due, l_quantity) AS rank, path, what AS text, 1::BIGINT AS n FROM hits WHERE kind = 'decision' QUALIFY rank <= 10),
        b AS (SELECT 'intent' AS section, row_number() OVER (ORDER BY date DESC, path, what, due, l_quantity) AS rank, path, what AS text, 1::BIGINT AS n FROM hits WHERE kind <> 'decision' AND status = 'open' QUALIFY rank <= 10),
        c AS (SELECT 'topic' AS section, row_number() OVER (ORDER BY count(*) DESC, topic) AS rank, NULL::VARCHAR AS path, topic AS text, count(*) AS n FROM hits GROUP BY topic QUALIFY rank <= 5),
        e AS (SELECT 'meeting' AS section, row_number() OVER (ORDER BY date DESC, path) AS rank, path, title AS text, sum(hit)::BIGINT AS n FROM (SELECT path, date, title, 0 AS hit FROM meetings WHERE contains(lower(title), 'blue') UNION ALL SELECT path, date, title, 1 FROM hits) GROUP BY path, date, title QUALIFY rank <= 10)
        SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM e""",
    "person_profile": SQL + """, own AS (SELECT * FROM meetings WHERE contains(lower(person), '#00000012')), i AS (SELECT items.* FROM items JOIN own USING (meeting_id))
        SELECT count(*) AS n_meetings, min(date) AS first_seen, max(date) AS last_seen, sum(duration_min)::BIGINT AS duration_min, (SELECT count(*) FROM i WHERE kind = 'decision') AS n_decisions,
            (SELECT count(*) FROM i WHERE kind <> 'decision' AND status = 'open') AS n_open_intents,
            (SELECT string_agg(topic, ', ' ORDER BY n DESC, topic) FROM (SELECT topic, count(*) AS n FROM i GROUP BY 1 ORDER BY n DESC, topic LIMIT 5)) AS topics FROM own""",
    "person_exact": SQL + """, own AS (SELECT * FROM meetings WHERE lower(person) = 'customer#000000012'), i AS (SELECT items.* FROM items JOIN own USING (meeting_id))
        SELECT count(*) AS n_meetings, min(date) AS first_seen, max(date) AS last_seen, sum(duration_min)::BIGINT AS duration_min, (SELECT count(*) FROM i WHERE kind = 'decision') AS n_decisions,
            (SELECT count(*) FROM i WHERE kind <> 'decision' AND status = 'open') AS n_open_intents,
            (SELECT string_agg(topic, ', ' ORDER BY n DESC, topic) FROM (SELECT topic, count(*) AS n FROM i GROUP BY 1 ORDER BY n DESC, topic LIMIT 5)) AS topics FROM own""",
    "search_filters": SQL + f"""SELECT path, date_text FROM meetings m WHERE type = 'meeting' AND {_OPEN} AND EXISTS (SELECT 1 FROM attendees a WHERE a.meeting_id = m.meeting_id AND contains(lower(a.person), 'supplier 1'))
        AND EXISTS (SELECT 1 FROM items i WHERE i.meeting_id = m.meeting_id AND kind = 'action-item' AND contains(lower(who), 'supplier 2')) ORDER BY date DESC, path LIMIT 500""",
    "insights_of": SQL + """SELECT seq, kind, user_id, confidence FROM insights WHERE confidence <> 'tentative' AND ts >= TIMESTAMP '2024-01-02' AND (contains(lower('User ' || user_id), 'r 1') OR contains(kind, 'r 1') OR (seq % 3 = 0 AND contains(lower('Owner ' || (user_id % 10)), 'r 1'))) ORDER BY seq DESC LIMIT 300""",
    "last_events": SQL + "SELECT seq, kind, content FROM insights WHERE ts >= TIMESTAMP '2024-01-03 12:00:00' ORDER BY seq DESC LIMIT 150",
    "owned_actions": SQL + "SELECT who, kind, status, count(*) AS n FROM items WHERE regexp_replace(lower(coalesce(who, '')), '[^a-z0-9]+', '-', 'g') = 'supplier-8' GROUP BY 1, 2, 3",
    "exact_meeting": SQL + f"SELECT path, date_text, title, person, duration_min FROM meetings WHERE path = 'order-7' AND {_OPEN}",
    "top_commitments": SQL + "SELECT path, what, person, kind FROM items JOIN meetings USING (meeting_id) WHERE status = 'open' AND kind IN ('commitment', 'action-item') ORDER BY date DESC, what, person, kind, path LIMIT 400",
    "commitment_rows": SQL + "SELECT coalesce(who, 'unassigned') AS person, status, due[1:7] AS month, count(*) AS n, min(what) AS first_what FROM items WHERE kind IN ('commitment', 'action-item') GROUP BY 1, 2, 3",
    "meeting_people": SQL + """, r AS (SELECT meeting_id, person, max(CASE role WHEN 'attendee' THEN 3 WHEN 'speaker' THEN 2 ELSE 1 END) AS r FROM attendees GROUP BY 1, 2)
        SELECT regexp_replace(regexp_replace(lower(person), '[^\\pL\\pN]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, person, CASE r WHEN 3 THEN 'attendee' WHEN 2 THEN 'speaker' ELSE 'mentioned' END AS role, count(*) AS n FROM r GROUP BY 1, 2, 3""",
    "decisions_by_role": SQL + """, s AS (SELECT meeting_id, person FROM attendees GROUP BY 1, 2 HAVING bool_or(role = 'speaker') AND NOT bool_or(role = 'attendee'))
        SELECT s.person, topic, count(*) AS n, max(date) AS last FROM s JOIN meetings m USING (meeting_id) JOIN items i USING (meeting_id) WHERE i.kind = 'decision' GROUP BY 1, 2""",
    "graph_stats": SQL + "SELECT (SELECT count(DISTINCT person) FROM attendees) AS people, (SELECT count(DISTINCT person) FROM (SELECT person, meeting_id FROM attendees GROUP BY 1, 2 HAVING bool_and(role = 'mentioned')) x SEMI JOIN (SELECT person FROM attendees WHERE role <> 'mentioned') y USING (person)) AS with_aliases, (SELECT count(*) FROM meetings) AS meetings, count(*) FILTER (kind IN ('commitment', 'action-item')) AS commitments, count(DISTINCT topic) AS topics FROM items",
    "commitment_dedup": SQL + """, r AS (SELECT meeting_id, split_part(topic, ' ', 1) AS what, CASE WHEN who IS NOT NULL THEN 'The  Team' END AS who, due[1:4] AS year,
            CASE WHEN l_quantity % 10 = 0 OR due[1:4]::INT < 1998 THEN 'stale' ELSE 'open' END AS status FROM items WHERE kind <> 'decision' AND status = 'open'),
        g AS (SELECT meeting_id, what, who, year, max(status) AS status, count(*) AS n FROM r GROUP BY 1, 2, 3, 4)
        SELECT status, n, who, count(*) AS groups, max(what) AS last_what FROM g GROUP BY 1, 2, 3""",
    "owned_commitments": SQL + """SELECT meeting_id, min(what) AS what, min(who) AS who, due, CASE WHEN due < '1998-06-15' THEN 'stale' ELSE 'open' END AS status, count(*) AS n
        FROM items WHERE kind <> 'decision' AND status = 'open' AND who = 'Supplier 8' GROUP BY meeting_id, lower(what), due""",
    "people_listing": SQL + """, a AS (SELECT meeting_id, CASE role WHEN 'mentioned' THEN upper(person) ELSE person END AS person FROM attendees),
        s AS (SELECT *, regexp_replace(regexp_replace(lower(person), '[^\\pL\\pN]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM a),
        o AS (SELECT *, min(person) OVER (PARTITION BY slug) AS best FROM s)
        SELECT slug, best AS person, coalesce(string_agg(DISTINCT CASE WHEN o.person <> best THEN o.person END, '|'), '') AS aliases, count(DISTINCT meeting_id) AS meeting_count, min(date) AS first_seen, max(date) AS last_seen FROM o JOIN meetings USING (meeting_id) GROUP BY 1, 2""",
    "profile_sections": SQL + """, own AS (SELECT * FROM meetings WHERE meeting_id IN (SELECT meeting_id FROM attendees WHERE person = 'Supplier 12' AND role <> 'mentioned')),
        a AS (SELECT 'meeting' AS section, row_number() OVER (ORDER BY date DESC, path) AS rank, path, title AS text, NULL::VARCHAR AS status, 1::BIGINT AS n FROM own QUALIFY rank <= 5),
        l AS (SELECT meeting_id, min(what) AS what, due FROM items WHERE kind <> 'decision' AND status = 'open' AND who = 'Supplier 12' GROUP BY meeting_id, lower(what), due),
        b AS (SELECT 'intent' AS section, row_number() OVER (ORDER BY date DESC, what, path) AS rank, path, what AS text, CASE WHEN due < '1998-06-15' THEN 'stale' ELSE 'open' END AS status, 1::BIGINT AS n FROM l JOIN meetings USING (meeting_id) QUALIFY rank <= 10),
        c AS (SELECT 'decision' AS section, row_number() OVER (ORDER BY date DESC, what, path) AS rank, path, what AS text, NULL::VARCHAR AS status, 1::BIGINT AS n FROM (SELECT DISTINCT path, date, what FROM items JOIN own USING (meeting_id) WHERE kind = 'decision') QUALIFY rank <= 5),
        d AS (SELECT 'topic' AS section, row_number() OVER (ORDER BY count(DISTINCT meeting_id) DESC, topic) AS rank, NULL::VARCHAR AS path, topic AS text, NULL::VARCHAR AS status, count(DISTINCT meeting_id) AS n FROM items JOIN own USING (meeting_id) GROUP BY topic QUALIFY rank <= 5)
        SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM d""",
    "commitment_status": SQL + "SELECT person, CASE WHEN due::DATE < DATE '1999-01-01' THEN 'stale' ELSE 'open' END AS status, count(*) AS n FROM items JOIN meetings USING (meeting_id) WHERE kind <> 'decision' AND status = 'open' GROUP BY 1, 2",
    "co_attendance": SQL + """, one AS (SELECT DISTINCT meeting_id, who FROM items WHERE who IS NOT NULL)
        SELECT x.who AS a, y.who AS b, count(*) AS n FROM one x JOIN one y ON x.meeting_id = y.meeting_id AND x.who < y.who GROUP BY 1, 2 HAVING count(*) >= 2""",
    "dashboard": SQL + "SELECT count(*) AS meetings, round(sum(duration_min) / 60, 2) AS hours, count(DISTINCT person_id) AS people, count(*) FILTER (duration_min = 0) AS duration_skipped, count(*) FILTER (sensitivity = 'restricted') AS restricted FROM all_meetings",
    "tag_frequency": SQL + "SELECT topic, count(DISTINCT meeting_id) AS n FROM items GROUP BY 1 ORDER BY n DESC, topic LIMIT 20",
    "authorised_release": SQL + f"SELECT count(*) FILTER (ok) AS released, count(*) FILTER (NOT ok) AS withheld FROM (SELECT EXISTS (SELECT 1 FROM all_meetings m WHERE m.meeting_id = i.meeting_id AND {_OPEN}) AS ok FROM all_items i)",
    "expansion_union": SQL + "SELECT query, count(*) AS n, min(path) AS first_path FROM (SELECT path, CASE WHEN contains(lower(title), '0012') THEN '0012' WHEN contains(lower(title), 'priority 2') THEN 'priority 2' WHEN contains(lower(title), '0003') THEN '0003' END AS query FROM meetings) WHERE query IS NOT NULL GROUP BY 1",
    "title_functions": SQL + f"""SELECT DISTINCT title, regexp_replace(regexp_replace(lower(title), '[^\\pL\\pN]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, {_NORM_TOPIC.format('title')} AS topic, {_NORM_VALUE.format('title')} AS value,
        coalesce(array_to_string(list_filter(regexp_split_to_array(lower(title), '[^\\pL\\pN]+'), lambda w: strlen(w) > 3 AND w NOT IN ({_TITLE_STOP})), ' '), '') AS keywords, regexp_replace(lower(title), '[^\\pL\\pN]', '', 'g') AS key FROM meetings""",
    "duration_functions": SQL + """SELECT path, CASE duration_min % 3 WHEN 0 THEN (duration_min // 60) || 'h ' || (duration_min % 60) || 'm' WHEN 1 THEN duration_min || 'm 5s' ELSE (duration_min // 60) || ':' || lpad((duration_min % 60)::VARCHAR, 2, '0') || ':07' END AS text,
        CASE duration_min % 3 WHEN 0 THEN nullif(duration_min * 60, 0) WHEN 1 THEN duration_min * 60 + 5 ELSE duration_min * 60 + 7 END AS seconds, CASE duration_min % 3 WHEN 0 THEN nullif(duration_min * 60, 0) WHEN 1 THEN duration_min * 60 + 5 END AS plain_seconds FROM all_meetings""",
    "corpus_revision": SQL + """, h AS (SELECT type, sha256(concat_ws('|', path, title, date_text)) AS h FROM all_meetings)
        SELECT type, count(*) AS n, sum(('0x' || h[1:8])::BIGINT)::BIGINT AS first, sum(('0x' || h[9:16])::BIGINT)::BIGINT AS second FROM h GROUP BY 1""",
    "activity_summary": SQL + "SELECT kind, count(*) AS n, count(DISTINCT user_id) AS users, max(seq) AS high_water FROM insights GROUP BY 1",
    "newest_per_person": SQL + """SELECT person, type, path, round(abs(date_diff('second', date, TIMESTAMP '1998-06-15') / 60), 3) AS distance FROM meetings
        QUALIFY row_number() OVER (PARTITION BY person, type ORDER BY distance, meeting_id) = 1""",
}
