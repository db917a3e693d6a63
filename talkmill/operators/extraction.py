"""Structured records from text: action items, decisions, intents, facts, entities, tags, insights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkmill.functions import text as T

# Fixed values.
TOPIC_FILLERS = ("the", "a", "an", "to", "for", "of", "in", "on", "at", "is", "was", "will", "should", "we", "they", "it")


def sections(documents: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, section, pos, item): the items (`- text`) under `## name` headings; lines inside ``` fences count as neither."""
    lines = documents.select(key, F.posexplode(F.split(F.coalesce(F.col(column), F.lit("")), "\n")).alias("pos", "line"))
    order = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    fences = F.count_if(F.col("line").rlike(r"^\s*```")).over(order)
    lines = lines.withColumn("open", fences % 2 == 0)
    name = F.when(F.col("open") & F.col("line").rlike(r"^##\s+\S"), F.lower(F.trim(F.regexp_extract("line", r"^##\s+(.*)$", 1))))
    lines = lines.withColumn("section", F.last(name, ignorenulls=True).over(order))
    items = lines.where(F.col("open") & F.col("line").rlike(r"^\s*[-*]\s+\S") & F.col("section").isNotNull())
    return items.select(key, "section", "pos", F.trim(F.regexp_extract("line", r"^\s*[-*]\s+(.*)$", 1)).alias("item"))


def _bare(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\)+$", ""))


def action_items(items: DataFrame) -> DataFrame:
    """assignee (or `unassigned`), task, due and status of `@who: task` items."""
    parsed = T.owner_prefix(F.col("item"))
    who = F.coalesce(parsed["owner"], F.lit("unassigned"))
    return items.withColumns({"assignee": who, "task": _bare(parsed["content"]), "due": T.due_phrase(parsed["content"]), "status": F.lit("open")})


def inferred_topic(text: Column) -> Column:
    """The first four words that are no fillers, in lower case; null without any."""
    own = F.filter(T.words(text), lambda w: ~F.lower(w).isin(*TOPIC_FILLERS))
    return F.nullif(F.lower(F.array_join(F.slice(own, 1, 4), " ")), F.lit(""))


def intents(items: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, place, kind, what, who, status, by_date): action items, decisions, open questions and commitments, in that order."""
    kinds = {"action items": ("action-item", 0, "open"), "decisions": ("decision", 1, "decided"), "open questions": ("open-question", 2, "open"), "commitments": ("commitment", 3, "open")}
    table = F.create_map(*(F.lit(x) for name, v in kinds.items() for x in (name, v[0])))
    rows = items.withColumn("kind", table[F.col("section")]).where("kind is not null")
    parsed, kind = T.owner_prefix(F.col("item")), F.col("kind")
    place = F.array_position(F.array(*(F.lit(v[0]) for v in kinds.values())), kind) - 1
    return rows.select(
        key, place.cast("long").alias("place"), "pos", "kind",
        F.when(kind == "decision", F.col("item")).when(kind == "open-question", parsed["content"]).otherwise(_bare(parsed["content"])).alias("what"),
        F.when(kind != "decision", parsed["owner"]).alias("who"),
        F.when(kind == "decision", "decided").otherwise("open").alias("status"),
        F.when(kind.isin("action-item", "commitment"), T.due_phrase(F.col("item"))).alias("by_date"),
    )


def insights(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Intents as insights, once each: (key, kind, content, owner, deadline, topic, confidence).

    A commitment whose content an action item of the same document has is left out.
    """
    rows = found.select(
        key, "kind", F.lower(F.trim("what")).alias("content"), F.lower(F.trim("who")).alias("owner"),
        F.coalesce(F.lower("by_date"), T.inline_deadline(F.col("what"))).alias("deadline"), T.topic_prefix(F.col("what")).alias("topic"),
        F.when(F.col("kind") == "decision", T.decision_confidence(F.col("what"))).otherwise("explicit").alias("confidence"),
    ).distinct()
    acted = rows.where("kind = 'action-item'").select(key, "content").distinct()
    return rows.where("kind <> 'commitment'").unionByName(rows.where("kind = 'commitment'").join(acted, [key, "content"], "left_anti").select(rows.columns))


def entities(mentions: DataFrame) -> DataFrame:
    """(slug, label, aliases, n): mentions (name) by slug, the preferred name as label, the other spellings as aliases."""
    rows = mentions.withColumn("slug", T.slugify(F.col("name"))).where("slug <> ''")
    return rows.groupBy("slug").agg(
        F.min(T.name_rank(F.col("slug"), F.col("name")))["name"].alias("label"), F.array_sort(F.collect_set(F.lower("name"))).alias("aliases"), F.count("*").alias("n")
    )


def derived_tags(people: Column, topics: Column, projects: Column, source: Column, has_actions: Column) -> Column:
    """At most eight distinct tags: source, has-actions, three people, three topics, four projects."""
    tag = lambda kind, xs, k: F.transform(F.slice(F.coalesce(xs, F.array().cast("array<string>")), 1, k), lambda x: F.concat(F.lit(kind), T.slugify(x)))
    first = F.array_compact(F.array(F.concat(F.lit("source-"), T.slugify(source)), F.when(has_actions, F.lit("has-actions"))))
    return F.slice(F.array_distinct(F.concat(first, tag("person-", people, 3), tag("topic-", topics, 3), tag("project-", projects, 4))), 1, 8)


def merged_attendees(listed: Column, raw: Column) -> Column:
    """Listed names, then those of a comma-separated text, the first spelling of each; blanks go."""
    names = F.transform(F.concat(F.coalesce(listed, F.array().cast("array<string>")), F.split(F.coalesce(raw, F.lit("")), "[,;]")), lambda n: F.trim(n))
    names = F.filter(names, lambda n: n != "")
    return F.aggregate(names, F.array().cast("array<string>"), lambda a, n: F.when(F.exists(a, lambda x: F.lower(x) == F.lower(n)), a).otherwise(F.concat(a, F.array(n))))


def humanised(lines: DataFrame, speakers: DataFrame) -> DataFrame:
    """lines (doc_id, pos, speaker, text) with `[speaker]` as the confirmed name, if there is one of high confidence."""
    known = speakers.where("confidence = 'high'").select("doc_id", F.col("label").alias("speaker"), "name")
    rows = lines.join(known, ["doc_id", "speaker"], "left")
    return rows.select("doc_id", "pos", F.concat(F.lit("["), F.coalesce("name", "speaker"), F.lit("] "), "text").alias("line"))


def overlay(base: DataFrame, confirmed: DataFrame, keys: list[str]) -> DataFrame:
    """base (keys, value, at) with the latest confirmed value of each key in its place; keys of either side stay."""
    last = confirmed.groupBy(*keys).agg(F.max_by("value", F.struct("at", "value")).alias("confirmed"))
    return base.join(last, keys, "full").select(*keys, F.coalesce("confirmed", "value").alias("value"), F.col("confirmed").isNotNull().alias("overridden"))


def merged_items(fresh: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """Regenerated items joined with previous ones on keys that are unique on both sides; the user's status stays, edited rows are never lost.

    Both: (keys, status, edited). Rows of keys that repeat stay as they are on the fresh side.
    """
    once = lambda df: df.join(df.groupBy(*keys).agg(F.count("*").alias("c")).where("c = 1").drop("c"), keys, "left_semi")
    unique = once(before).join(once(fresh).select(*keys), keys, "left_semi").select(*keys, F.col("status").alias("old_status"), F.col("edited").alias("old_edited"))
    rows = fresh.join(unique, keys, "left").select(*keys, F.when(F.col("old_edited"), F.col("old_status")).otherwise(F.col("status")).alias("status"), F.coalesce("old_edited", F.lit(False)).alias("edited"))
    lost = before.where("edited").join(fresh.select(*keys).distinct(), keys, "left_anti").select(*keys, "status", "edited")
    return rows.unionByName(lost)
