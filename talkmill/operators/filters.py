"""Filters and listings over meetings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.functions.text import confidence_rank, folded


@dataclass(frozen=True)
class SearchFilters:
    """Conditions on meetings; all that are set must hold. `since` compares RFC 3339 texts, as texts.

    `attendee` asks for an attendee whose name holds the text, `intent_kind` and `owner` for an item of that kind and of an owner
    that holds the text: `among` looks these up in their own tables.
    """

    type: str | None = None
    since: str | None = None
    person: str | None = None
    recorded_by: str | None = None
    include_restricted: bool = False
    attendee: str | None = None
    intent_kind: str | None = None
    owner: str | None = None

    def among(self, meetings: DataFrame, attendees: DataFrame, items: DataFrame) -> DataFrame:
        """The meetings that fulfil all conditions. attendees: (meeting_id, person); items: (meeting_id, kind, who)."""
        rows = meetings.where(self.condition())
        if self.attendee:
            rows = rows.join(attendees.where(F.lower("person").contains(self.attendee.lower())), "meeting_id", "left_semi")
        if self.intent_kind or self.owner:
            own = items.where(F.col("kind") == self.intent_kind) if self.intent_kind else items
            own = own.where(F.lower("who").contains(self.owner.lower())) if self.owner else own
            rows = rows.join(own, "meeting_id", "left_semi")
        return rows

    def condition(self) -> Column:
        held = F.lit(True)
        if self.type:
            held = held & (F.col("type") == self.type)
        if self.since:
            held = held & (F.col("date_text") >= self.since)
        if self.person:
            held = held & F.lower("person").contains(self.person.lower())
        if self.recorded_by:
            held = held & F.lower("recorded_by").contains(self.recorded_by.lower())
        return held if self.include_restricted else held & unrestricted()


def unrestricted() -> Column:
    return F.coalesce(F.col("sensitivity"), F.lit("normal")) != "restricted"


def newest(meetings: DataFrame, limit: int) -> DataFrame:
    """The newest rows, of one date by path."""
    return meetings.orderBy(F.desc_nulls_last("date"), "path").limit(limit)


def list_meetings(meetings: DataFrame, filters: SearchFilters, limit: int) -> DataFrame:
    return newest(meetings.where(filters.condition()), limit)


def with_stubs(meetings: DataFrame, note: str = "restricted") -> DataFrame:
    """Restricted rows keep path, date and type; title and person give way to a note."""
    open_ = unrestricted()
    return meetings.withColumns({"title": F.when(open_, F.col("title")).otherwise(F.lit(note)), "person": F.when(open_, F.col("person"))})


def since_instant(meetings: DataFrame, since: str) -> DataFrame:
    """Rows since an instant, compared as instants; rows without a date go."""
    return meetings.where(F.col("date") >= F.lit(since).cast("timestamp_ntz"))


def filter_insights(insights: DataFrame, kind: str | None, least: str | None, limit: int, participant: str | None = None, since: str | None = None) -> DataFrame:
    """The last `limit` insights of a kind, of at least a confidence, of a participant or owner that holds a text, and since a moment, in order of seq.

    insights: (seq, ts, kind, confidence), and (participants array, owner) where a participant is asked for. Unknown confidences go.
    """
    rows = insights
    if participant:
        low = participant.lower()
        rows = rows.where(F.coalesce(F.exists("participants", lambda p: F.lower(p).contains(low)), F.lit(False)) | F.coalesce(F.lower("owner").contains(low), F.lit(False)))
    if since:
        rows = rows.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    if kind:
        rows = rows.where(F.col("kind") == kind)
    if least:
        rows = rows.where(confidence_rank(F.col("confidence")) >= confidence_rank(F.lit(least)))
    return rows.orderBy(F.desc("seq")).limit(limit).orderBy("seq")


def last_events(events: DataFrame, since: str, limit: int) -> DataFrame:
    """The last events since a moment, in order of seq."""
    return events.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz")).orderBy(F.desc("seq")).limit(limit).orderBy("seq")


def owner_matches(owner: Column, selector: str) -> Column:
    """Whether an owner is the selector, blanks and case aside, or has the same slug without accents; an empty selector matches all."""
    bare = lambda c: F.lower(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"\s+", " "))
    slug = lambda c: F.regexp_replace(F.regexp_replace(folded(bare(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    if not selector.strip():
        return F.lit(True)
    return (bare(owner) == bare(F.lit(selector))) | (slug(owner) == slug(F.lit(selector)))


def exact_meeting(meetings: DataFrame, path: str, include_restricted: bool = False) -> DataFrame:
    """The meeting of that path, if it may be shown."""
    rows = meetings.where(F.col("path") == path)
    return rows if include_restricted else rows.where(unrestricted())


def events_since(events: DataFrame, seq: int, limit: int) -> DataFrame:
    """The first events after a sequence number."""
    return events.where(F.col("seq") > seq).orderBy("seq").limit(limit)


def text_search(rows: DataFrame, columns: list[str], query: str) -> DataFrame:
    """Rows of which a column contains the query, case aside; an empty query finds none."""
    if not query.strip():
        return rows.limit(0)
    found = F.lit(False)
    for c in columns:
        found = found | F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(query.lower())
    return rows.where(found)


def retention(meetings: DataFrame, as_of: str, keep_days: dict[str, int]) -> DataFrame:
    """type, action (`keep` or `delete`), rows and their length: what a retention rule by type and age would do."""
    age = F.datediff(F.lit(as_of).cast("date"), F.col("date").cast("date"))
    limit = F.create_map(*(F.lit(x) for kv in keep_days.items() for x in kv))
    action = F.when(age > F.get(F.map_values(F.map_filter(limit, lambda k, _: k == F.col("type"))), F.lit(0)), "delete").otherwise("keep")
    return meetings.groupBy("type", action.alias("action")).agg(F.count("*").alias("n"), F.sum("duration_min").alias("duration_min"))
