"""Reports on hand-made rows, and nothing of restricted meetings in any query that does not ask for them."""

import datetime

import pytest
from pyspark.sql import functions as F

from talkmill.operators import reports
from talkmill.plans import mapping as M
from talkmill.queries import QUERIES

SF = "/root/testdata/sf0.001"
#: Queries whose feature is to show stubs of restricted meetings.
SHOWING = {"restricted_stubs"}
DAY = datetime.datetime(2026, 1, 1)
ITEMS = "meeting_id long, kind string, what string, who string, due string, status string, topic string"


def meetings(spark, *rows):
    return spark.createDataFrame([(i, f"m-{i}", DAY + datetime.timedelta(days=d), t) for i, d, t in rows], "meeting_id long, path string, date timestamp_ntz, title string")


def test_one_stale_duplicate_makes_the_row_stale(spark):
    rows = [
        (1, "commitment", "Send  the plan", "Ann", None, "open", "t"), (1, "action-item", "send the PLAN ", "ann", None, "stale", "t"),
        (1, "commitment", "send the plan", "Bob", None, "open", "t"), (2, "commitment", "send the plan", "Ann", None, "open", "t"), (2, "commitment", "send the plan", "Ann", None, "done", "t"),
        (3, "commitment", "late", None, "2025-12-31", "open", "t"), (3, "commitment", "today", None, "2026-01-01", "open", "t"), (3, "decision", "late", None, "2025-12-31", "open", "t"), (None, None, None, None, None, None, None),
    ]
    items = spark.createDataFrame(rows, ITEMS)
    got = {(r.meeting_id, r.what, r.who): (r.status, r.n) for r in reports.dedup_commitments(items, "2026-01-01 12:00:00").collect()}
    assert got == {(1, "Send  the plan", "Ann"): ("stale", 2), (1, "send the plan", "Bob"): ("open", 1), (2, "send the plan", "Ann"): ("open", 1), (3, "late", None): ("stale", 1), (3, "today", None): ("open", 1)}
    assert {r.who for r in reports.dedup_commitments(items, "2026-01-01 12:00:00", owner=" ANN").collect()} == {"Ann"}
    assert reports.dedup_commitments(items.limit(0), "2026-01-01 12:00:00").count() == 0


def test_profiles_are_lists_and_selectors_fit_one_person(spark):
    own = meetings(spark, *((i, i, f"Meeting {i}") for i in range(1, 9)))
    raw = [(i, "Ann Lee", "speaker") for i in range(1, 8)] + [(8, "ann  lee", "mentioned"), (8, "Bob", "attendee"), (1, "Bob", "mentioned")]
    people = reports.attendance(spark.createDataFrame(raw, "meeting_id long, person string, role string"))
    items = spark.createDataFrame(
        [(i, "commitment", f"do {i:02}", "Ann Lee", "2025-01-01" if i % 2 else None, "open", "plans") for i in range(1, 9)] + [(i, "decision", f"agree {i}", None, None, "done", f"t{i}") for i in range(1, 9)], ITEMS
    )
    rows = reports.profile_sections(own, people, items, "ann lee", "2026-01-01 00:00:00").collect()
    by = {s: [r for r in sorted(rows, key=lambda r: r["rank"]) if r.section == s] for s in ("meeting", "intent", "decision", "topic")}
    assert [r.path for r in by["meeting"]] == ["m-7", "m-6", "m-5", "m-4", "m-3"]
    assert [(r.text, r.status) for r in by["intent"]][:2] == [("do 08", "open"), ("do 07", "stale")] and len(by["intent"]) == 8
    assert [r.text for r in by["decision"]] == [f"agree {i}" for i in (7, 6, 5, 4, 3)]
    assert [(r.text, r.n) for r in by["topic"]] == [("plans", 7), ("t1", 1), ("t2", 1), ("t3", 1), ("t4", 1)]
    assert reports.profile_sections(own, people, items, "nobody", "2026-01-01 00:00:00").count() == 0
    # an alias that two people share
    both = people.withColumn("aliases", F.array_union("aliases", F.array(F.lit("The Lead"))))
    with pytest.raises(Exception, match="fits several people: ann-lee, bob"):
        reports.profile_sections(own, both, items, "the lead", "2026-01-01 00:00:00").collect()


def test_aliases(spark):
    raw = [(1, "Ann Lee", "speaker"), (2, "ann lee", "mentioned"), (2, "ANN LEE", "speaker"), (3, "Bob", "attendee"), (3, None, "attendee"), (3, "--", "attendee")]
    people = reports.attendance(spark.createDataFrame(raw, "meeting_id long, person string, role string"))
    got = {r.slug: (r.person, r.aliases, r.meeting_count) for r in reports.people_listing(people, meetings(spark, (1, 1, ""), (2, 2, ""), (3, 3, ""))).collect()}
    assert got == {"ann-lee": ("ANN LEE", ["Ann Lee", "ann lee"], 2), "bob": ("Bob", [], 1)}


def test_research_names_meetings(spark):
    own = meetings(spark, (1, 1, "Blue week"), (2, 2, "Review"), (3, 3, "Review"))
    items = spark.createDataFrame([(2, "commitment", "paint it blue", None, None, "done", "t"), (3, "commitment", "red", None, None, "open", "t"), (1, "decision", "blue it is", None, None, "done", "t")], ITEMS).withColumn("l_quantity", F.lit(1))
    rows = [r for r in reports.research(own, items, "BLUE").collect() if r.section == "meeting"]
    assert [(r.rank, r.path, r.n) for r in sorted(rows, key=lambda r: r["rank"])] == [(1, "m-2", 1), (2, "m-1", 1)]


def test_gate(spark):
    """The gated tables hold nothing of restricted meetings and everything else."""
    hidden = M.all_meetings(spark, SF).where("sensitivity = 'restricted'").select("meeting_id")
    for gated, every in ((M.meetings, M.all_meetings), (M.items, M.all_items), (M.attendees, M.all_attendees)):
        rows, left = gated(spark, SF), every(spark, SF).join(hidden, "meeting_id", "left_anti")
        assert rows.join(hidden, "meeting_id").count() == 0 and rows.count() == left.count() > 0


@pytest.mark.parametrize("name", sorted(n for m in ("corpus", "records", "answers", "sources") for n in __import__(f"talkmill.plans.{m}", fromlist=["QUERIES"]).QUERIES))
def test_no_restricted_meeting_leaves(spark, hidden, name):
    """No path and no title of a restricted meeting stands in any column of any query."""
    paths, titles = hidden
    for row in QUERIES[name](spark, SF).collect():
        found = {str(x) for x in row}
        assert not found & (titles if name in SHOWING else paths | titles)


@pytest.fixture(scope="module")
def hidden(spark):
    rows = M.all_meetings(spark, SF).select("path", "title", "sensitivity").collect()
    shown = {r.title for r in rows if r.sensitivity is None}
    secret = [r for r in rows if r.sensitivity is not None]
    return {r.path for r in secret}, {r.title for r in secret} - shown
