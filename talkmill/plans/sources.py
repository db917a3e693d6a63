"""Named queries that write the supplied tables as logs and read them again, with SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.operators import records
from talkmill.plans import mapping as M
from talkmill.plans.mapping import SQL
from talkmill.session import shared_folder
from talkmill.sources import census, events, logs, markdown
from talkmill.tables import load


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _log(spark: SparkSession, sf: str) -> str:
    """events as a log of JSON lines, some malformed, in several files."""
    path = _folder(spark, "log")
    e = load(spark, sf, "events").select((F.col("event_id") + 1).alias("seq"), F.to_timestamp(F.col("ts").cast("timestamp")).alias("timestamp"), "event_type", "user_id", "value")
    good = F.to_json(F.struct(F.lit(1).alias("v"), "seq", "timestamp", "event_type", "user_id", "value"))
    lines = e.select(F.explode(F.when(F.col("seq") % 10 == 0, F.array(good, F.lit("{broken"))).otherwise(F.array(good))).alias("value"))
    lines.repartition(4).write.text(path)
    return path


def event_log(spark: SparkSession, sf: str) -> DataFrame:
    """A log of events read back; malformed lines are skipped."""
    rows = logs.read_events(spark, _log(spark, sf))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"), F.sum("seq").alias("total"))


def appended_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events appended to a log get the next numbers in order of time."""
    path = _log(spark, sf)
    log = logs.read_events(spark, path)
    new = load(spark, sf, "events").where("event_id < 500").select(F.col("ts").cast("timestamp").alias("ts"), F.lit("note").alias("event_type"), F.lpad(F.col("event_id").cast("string"), 8, "0").alias("payload"))
    logs.append_events(new, log, path)
    rows = spark.read.json(path).where("event_type = 'note'")
    return rows.select("seq", "payload")


def annotations(spark: SparkSession, sf: str) -> DataFrame:
    """Annotations of agents on the list."""
    notes = load(spark, sf, "events").select("event_id", F.concat(F.lit("agent-"), F.col("user_id") % 20).alias("agent"), "event_type")
    agents = load(spark, sf, "nation").select(F.concat(F.lit("agent-"), F.col("n_nationkey") * 3).alias("agent"))
    return logs.allowed_annotations(notes, agents).groupBy("agent").agg(F.count("*").alias("n"))


def upserted(spark: SparkSession, sf: str) -> DataFrame:
    """The last change of each key in its place."""
    base = load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    changes = load(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.concat(F.lit("order "), "o_orderkey").alias("name"), F.col("o_orderpriority").alias("segment"), F.col("o_orderkey").alias("at"))
    return logs.upsert(base, changes, ["id"], "at")


def removed_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of removed documents go with them."""
    v = load(spark, sf, "embeddings").select("vec_id", "label")
    return logs.removed(v, v.where("label % 3 = 0").select("label"), ["label"]).groupBy("label").agg(F.count("*").alias("n"))


def live_tail(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of a live transcript after a cursor, and those of the last hour."""
    path = _folder(spark, "live")
    e = load(spark, sf, "events").select((F.col("event_id") + 1).alias("line"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("text"), F.concat(F.lit("S"), F.col("user_id") % 3).alias("speaker"))
    e.select(F.to_json(F.struct("line", "ts", "text", "speaker")).alias("value")).repartition(3).write.text(path)
    rows = logs.read_live(spark, path, after=100)
    last = logs.recent_lines(rows, "2024-01-04 00:00:00", 3_600_000).select("line", "text", "speaker")
    return last


def typed_events(spark: SparkSession, sf: str) -> DataFrame:
    """A log of nine kinds of events read through typed views; unknown kinds and events that lack a field are kept apart."""
    n, text = F.col("event_id"), F.col("event_type")
    stamp, name = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("timestamp"), F.concat(F.lit("m-"), n)
    line = lambda kind, *own: F.to_json(F.struct(n.alias("seq"), stamp, F.lit(kind).alias("event_type"), *own))
    path, title, count = name.alias("path"), text.alias("title"), (n % 1_000).alias("word_count")
    kinds = (
        line("RecordingCompleted", path, title, count, F.lit("meeting").alias("content_type"), F.lit("1h").alias("duration")),
        line("NoteAdded", name.alias("meeting_path"), text.alias("text")),
        line("meeting.insight.detected", F.struct(text.alias("kind"), F.floor("value").cast("long").alias("score")).alias("insight"), text.alias("meeting_title")),
        line("KnowledgeUpdated", name.alias("meeting_path"), (n % 7).alias("facts_written"), (n % 3).alias("facts_skipped"), F.array(text, F.lit("Ann")).alias("people_updated")),
        line("live.utterance.final", F.lit("mic").alias("source"), name.alias("transcript_path"), n.alias("line"), text.alias("text"), (n * 10).alias("offset_ms"), (n % 50).alias("duration_ms")),
        line("agent.annotation", F.struct(text.alias("id")).alias("agent"), F.lit("note").alias("subkind"), F.struct(path).alias("target"), text.alias("body"), F.lit("high").alias("confidence")),
        line("WatchProcessed", path, title, count),  # lacks its source_path
        line("something.new", text.alias("text")),
        F.lit('{"event_type": "NoteAdded", '),
    )
    folder = _folder(spark, "typed")
    which, value = n % len(kinds), F.lit(None).cast("string")
    for k, kind in enumerate(kinds):
        value = F.when(which == k, kind).otherwise(value)
    load(spark, sf, "events").select(value.alias("value")).write.text(folder)
    at, name = lambda c: lambda own: own[c], lambda c, path: lambda own: events.field(own[c], path, "string")
    views = {
        "recording.completed": (at("word_count"), at("title")), "NoteAdded": (at("seq"), at("text")),
        "meeting.insight.detected": (lambda own: events.field(own["insight"], "$.score", "long"), name("insight", "$.kind")),
        "KnowledgeUpdated": (lambda own: own["facts_written"] + own["facts_skipped"], lambda own: F.array_join(own["people_updated"], "+")),
        "live.utterance.final": (lambda own: own["offset_ms"] + own["duration_ms"], lambda own: F.coalesce(own["speaker"], F.lit("nobody"))),
        "agent.annotation": (lambda own: own["seq"] + F.size(own["citations"]), name("agent", "$.id")),
    }
    return events.totals(events.envelopes(spark.read.text(folder)), views, (F.col("seq"), events.field(F.col("body"), "$.text", "string")))


def revision_states(spark: SparkSession, sf: str) -> DataFrame:
    """Indexed revisions that are current, changed or gone."""
    d = load(spark, sf, "documents").select("doc_id", F.md5("text").alias("sha256"))
    old = d.withColumn("sha256", F.when(F.col("doc_id") % 7 == 0, "x").otherwise(F.col("sha256")))
    return logs.stale_revisions(old, d.where("doc_id % 11 > 0")).groupBy("state").agg(F.count("*").alias("n"))


def settled_files(spark: SparkSession, sf: str) -> DataFrame:
    """Dropped files whose size is the same in two looks at the folder."""
    first = load(spark, sf, "pages").select(F.col("url").alias("path"), F.length("html").cast("long").alias("size")).groupBy("path").agg(F.max("size").alias("size"))
    later = first.withColumn("size", F.col("size") + F.when(F.col("size") % 5 == 0, 1).otherwise(0))
    return census.settled(first, later)


def speaker_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """Names of speaker labels from the lines of an answer."""
    answer = F.concat(F.lit("Mapping:\nSPEAKER_0 = "), "c_name", F.lit("\n- SPEAKER_1: unknown\nSPEAKER_2: Person "), "c_nationkey")
    rows = load(spark, sf, "customer").select("c_custkey", F.explode(records.mapping_lines(answer)).alias("m"))
    return rows.select("c_custkey", "m.label", "m.name")


def folder_census(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as files by category, size and age."""
    p = load(spark, sf, "pages").select("page_id", F.length("html").alias("size"), F.concat(F.lit("/d/f"), "page_id", F.element_at(F.array(*map(F.lit, (".pdf", ".tar.gz", ".HTML", ".docx", ""))), (F.col("page_id") % 5 + 1).cast("int"))).alias("path"))
    rows = p.select(census.extension(F.col("path")).alias("ext"), census.size_bucket(F.col("size")).alias("bucket"))
    return rows.groupBy("ext", census.category(F.col("ext")).alias("category"), "bucket").agg(F.count("*").alias("n"))


def frontmatter_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Meetings as Markdown text with frontmatter; fields without a YAML parser. Restricted ones are read too: the reference parses before any gate."""
    m = M.all_meetings(spark, sf)
    content = F.concat(F.lit("---\ntitle: \""), "title", F.lit("\"\ntype: "), "type", F.lit("\ndate: "), "date_text", F.lit("\npeople: [[a-"), "person_id", F.lit("]]\n---\n## Notes\nbody "), "path", F.lit("\n"))
    front = markdown.repaired(markdown.frontmatter(content))
    rows = m.select("path", markdown.scalar(front, "title").alias("title"), markdown.scalar(front, "date").alias("date"), markdown.scalar(front, "people").alias("people"), F.trim(markdown.body(content)).alias("body"))
    return rows.select("path", "title", "date", "people", F.translate("body", "\n", "|").alias("body"))


QUERIES = {f.__name__: f for f in (event_log, appended_events, annotations, upserted, removed_documents, live_tail, typed_events, revision_states, settled_files, speaker_mapping, folder_census, frontmatter_fields)}

ORACLE_SQL = {
    "event_log": "SELECT event_type, count(*) AS n, min(event_id) + 1 AS first, max(event_id) + 1 AS last, sum(event_id + 1)::BIGINT AS total FROM events GROUP BY 1",
    "appended_events": "SELECT (SELECT max(event_id) + 1 FROM events) + row_number() OVER (ORDER BY ts, event_id) AS seq, lpad(event_id::VARCHAR, 8, '0') AS payload FROM events WHERE event_id < 500",
    "annotations": "SELECT 'agent-' || (user_id % 20) AS agent, count(*) AS n FROM events WHERE user_id % 20 IN (SELECT n_nationkey * 3 FROM nation) GROUP BY 1",
    "upserted": "SELECT c_custkey AS id, coalesce(n, c_name) AS name, coalesce(s, c_mktsegment) AS segment FROM customer LEFT JOIN (SELECT o_custkey, 'order ' || max(o_orderkey) AS n, arg_max(o_orderpriority, o_orderkey) AS s FROM orders GROUP BY 1) ON c_custkey = o_custkey",
    "removed_documents": "SELECT label, count(*) AS n FROM embeddings WHERE label % 3 > 0 GROUP BY 1",
    "live_tail": "SELECT event_id + 1 AS line, event_type AS text, 'S' || (user_id % 3) AS speaker FROM events WHERE event_id + 1 > 100 AND ts <= TIMESTAMP '2024-01-04' AND ts >= TIMESTAMP '2024-01-03 23:00:00'",
    "typed_events": """SELECT CASE event_id % 9 WHEN 0 THEN 'recording.completed' WHEN 1 THEN 'NoteAdded' WHEN 2 THEN 'meeting.insight.detected' WHEN 3 THEN 'KnowledgeUpdated' WHEN 4 THEN 'live.utterance.final'
            WHEN 5 THEN 'agent.annotation' WHEN 6 THEN 'WatchProcessed' ELSE 'something.new' END AS kind, count(*) AS n,
        sum(CASE event_id % 9 WHEN 0 THEN event_id % 1000 WHEN 2 THEN floor(value)::BIGINT WHEN 3 THEN event_id % 7 + event_id % 3 WHEN 4 THEN event_id * 10 + event_id % 50 ELSE event_id END)::BIGINT AS total,
        max(CASE event_id % 9 WHEN 3 THEN event_type || '+Ann' WHEN 4 THEN 'nobody' WHEN 6 THEN NULL ELSE event_type END) AS last FROM events WHERE event_id % 9 < 8 GROUP BY 1""",
    "revision_states": "SELECT CASE WHEN doc_id % 11 = 0 THEN 'gone' WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'current' END AS state, count(*) AS n FROM documents GROUP BY 1",
    "settled_files": "SELECT url AS path, max(length(html)) AS size FROM pages GROUP BY 1 HAVING max(length(html)) % 5 > 0",
    "speaker_mapping": "SELECT c_custkey, 'SPEAKER_0' AS label, c_name AS name FROM customer UNION ALL SELECT c_custkey, 'SPEAKER_2', 'Person ' || c_nationkey FROM customer",
    "folder_census": """WITH p AS (SELECT page_id % 5 AS k, length(html) AS s FROM pages) SELECT CASE k WHEN 0 THEN 'pdf' WHEN 1 THEN 'tar.gz' WHEN 2 THEN 'html' WHEN 3 THEN 'docx' ELSE '' END AS ext,
        CASE k WHEN 0 THEN 'pdf' WHEN 1 THEN 'archive' WHEN 2 THEN 'markup' WHEN 3 THEN 'word_processing' ELSE 'other' END AS category,
        CASE WHEN s = 0 THEN 'zero' WHEN s < 102400 THEN 'under_100_kib' WHEN s < 1048576 THEN '100_kib_to_1_mib' ELSE '1_mib_to_10_mib' END AS bucket, count(*) AS n FROM p GROUP BY 1, 2, 3""",
    "frontmatter_fields": SQL + "SELECT path, title, date_text || '+00:00' AS date, '[a-' || person_id || ']' AS people, '## Notes|body ' || path || '|' AS body FROM all_meetings",
}
