"""The supplied tables as a corpus: what the queries read, as DataFrames and as SQL with the same names.

A meeting is an order, its person the customer; commitments and decisions are its line items, topics the
types of their parts; a transcript is a conversation. `meetings`, `attendees` and `items` hold nothing of
restricted meetings. A query that shows or counts these asks for the `all_` twins, and so does one that joins
the twin of a table with `meetings`, which is the same gate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.operators.filters import unrestricted
from talkmill.tables import dealt, load, tasks

#: Line items a task. A task's hashes and sorts hold what comes of them.
EACH = 250_000

AS_OF = "2001-12-01 12:30:00"


def all_meetings(spark: SparkSession, sf: str) -> DataFrame:
    """(meeting_id, path, date, date_text, type, title, person_id, person, sensitivity, recorded_by, duration_min)."""
    orders = dealt(load(spark, sf, "orders"), tasks(spark, sf, "orders", EACH), "o_custkey")
    people = load(spark, sf, "customer").select(F.col("c_custkey").alias("person_id"), F.col("c_name").alias("person"))
    return orders.join(people, orders["o_custkey"] == people["person_id"]).select(
        F.col("o_orderkey").alias("meeting_id"), F.concat(F.lit("order-"), "o_orderkey").alias("path"), F.col("o_orderdate").alias("date"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("date_text"),
        F.when(F.col("o_orderstatus") == "F", "meeting").when(F.col("o_orderstatus") == "O", "memo").otherwise("dictation").alias("type"),
        F.concat(F.lit("Review of "), "person", F.lit(" priority "), F.lower("o_orderpriority")).alias("title"), "person_id", "person",
        F.when(F.col("o_orderpriority") == "1-URGENT", "restricted").alias("sensitivity"), F.col("o_orderpriority").alias("recorded_by"),
        F.floor(F.col("o_totalprice") / 5000).cast("long").alias("duration_min"),
    )


def parts(spark: SparkSession, sf: str) -> int | None:
    """How many tasks share the items; None: the session's."""
    return tasks(spark, sf, "lineitem", EACH)


def meetings(spark: SparkSession, sf: str) -> DataFrame:
    """The meetings that are not restricted."""
    return all_meetings(spark, sf).where(unrestricted())


def _released(spark: SparkSession, sf: str, rows: DataFrame) -> DataFrame:
    """The rows of meetings that are not restricted, dealt by meeting; of these it reads the numbers alone, with the filter at the scan."""
    ids = load(spark, sf, "orders").where(F.coalesce("o_orderpriority", F.lit("")) != "1-URGENT").select(F.col("o_orderkey").alias("meeting_id"))
    return dealt(rows, parts(spark, sf), "meeting_id").join(ids, "meeting_id", "left_semi")


def attendees(spark: SparkSession, sf: str) -> DataFrame:
    """`all_attendees` of the meetings that are not restricted."""
    return _released(spark, sf, all_attendees(spark, sf))


def items(spark: SparkSession, sf: str) -> DataFrame:
    """`all_items` of the meetings that are not restricted."""
    return _released(spark, sf, all_items(spark, sf))


def all_attendees(spark: SparkSession, sf: str) -> DataFrame:
    """(meeting_id, person, role): the customer as attendee, each supplier of a line item as speaker or as mentioned."""
    lines = load(spark, sf, "lineitem")
    role = F.when(F.col("l_linestatus") == "O", "speaker").otherwise("mentioned")
    rows = lines.select(F.col("l_orderkey").alias("meeting_id"), F.concat(F.lit("Supplier "), "l_suppkey").alias("person"), role.alias("role"))
    return rows.unionByName(all_meetings(spark, sf).select("meeting_id", "person", F.lit("attendee").alias("role")))


def all_items(spark: SparkSession, sf: str) -> DataFrame:
    """(meeting_id, kind, what, topic, who, due, status, returned, quantity): line items as intents."""
    lines = dealt(load(spark, sf, "lineitem"), parts(spark, sf), "l_partkey")
    own = load(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    return lines.join(own, lines["l_partkey"] == own["p_partkey"]).select(
        F.col("l_orderkey").alias("meeting_id"),
        F.when(F.col("l_returnflag") == "R", "decision").when(F.col("l_returnflag") == "A", "action-item").otherwise("commitment").alias("kind"),
        F.concat("p_name", F.lit(" from "), "p_brand").alias("what"), F.lower("p_type").alias("topic"),
        F.when(F.col("l_suppkey") % 7 > 0, F.concat(F.lit("Supplier "), "l_suppkey")).alias("who"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("due"), F.when(F.col("l_linestatus") == "O", "open").otherwise("done").alias("status"),
        F.col("l_returnflag").alias("returned"), "l_quantity",
    )


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """(conv_id, turn, role, text)."""
    return load(spark, sf, "conversations")


def insights(spark: SparkSession, sf: str) -> DataFrame:
    """(seq, ts, kind, user_id, confidence, content): events as insights."""
    value = F.col("value")
    level = F.when(value < 10, "tentative").when(value < 40, "inferred").when(value < 120, "strong").otherwise("explicit")
    return load(spark, sf, "events").select(
        F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("kind"), "user_id", level.alias("confidence"),
        F.concat("event_type", F.lit(" "), F.get_json_object("props", "$.k")).alias("content"),
    )


SQL = """
    WITH all_meetings AS (
        SELECT o_orderkey AS meeting_id, 'order-' || o_orderkey AS path, o_orderdate AS date, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS date_text,
               CASE o_orderstatus WHEN 'F' THEN 'meeting' WHEN 'O' THEN 'memo' ELSE 'dictation' END AS type,
               'Review of ' || c_name || ' priority ' || lower(o_orderpriority) AS title, c_custkey AS person_id, c_name AS person,
               CASE WHEN o_orderpriority = '1-URGENT' THEN 'restricted' END AS sensitivity, o_orderpriority AS recorded_by,
               floor(o_totalprice / 5000)::BIGINT AS duration_min
        FROM orders JOIN customer ON o_custkey = c_custkey
    ), all_items AS (
        SELECT l_orderkey AS meeting_id, CASE l_returnflag WHEN 'R' THEN 'decision' WHEN 'A' THEN 'action-item' ELSE 'commitment' END AS kind,
               p_name || ' from ' || p_brand AS what, lower(p_type) AS topic, CASE WHEN l_suppkey % 7 > 0 THEN 'Supplier ' || l_suppkey END AS who,
               strftime(l_shipdate, '%Y-%m-%d') AS due, CASE l_linestatus WHEN 'O' THEN 'open' ELSE 'done' END AS status,
               l_returnflag AS returned, l_quantity
        FROM lineitem JOIN part ON l_partkey = p_partkey
    ), insights AS (
        SELECT event_id AS seq, ts, event_type AS kind, user_id,
               CASE WHEN value < 10 THEN 'tentative' WHEN value < 40 THEN 'inferred' WHEN value < 120 THEN 'strong' ELSE 'explicit' END AS confidence,
               event_type || ' ' || (props::JSON ->> '$.k') AS content
        FROM events
    ), meetings AS (SELECT * FROM all_meetings WHERE coalesce(sensitivity, 'normal') <> 'restricted'), items AS (SELECT * FROM all_items SEMI JOIN meetings USING (meeting_id)),
    attendees AS (
        SELECT l_orderkey AS meeting_id, 'Supplier ' || l_suppkey AS person, CASE l_linestatus WHEN 'O' THEN 'speaker' ELSE 'mentioned' END AS role FROM lineitem
        WHERE l_orderkey IN (SELECT meeting_id FROM meetings) UNION ALL SELECT meeting_id, person, 'attendee' FROM meetings
    )
"""
