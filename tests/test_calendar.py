"""Calendar entries of meetings: the nearest by time without pairs of a day's meetings and entries."""

import re

from talkmill.operators.records import calendar_match

ROWS = "meeting_id long, day string, title string, at int"


def test_nearest_entry_equals_pairs(spark):
    titles = ["alpha budget", "budget plans", "gamma", "alpha gamma", "the of"]
    meetings = [(i, f"d{i % 3}", titles[i % 5], None if i % 11 == 0 else i * 7 % 24) for i in range(60)]
    entries = [(100 + i, f"d{i % 4}", titles[i * 3 % 5], None if i % 9 == 0 else i * 5 % 31) for i in range(40)]
    meetings += [(200, "d9", "alpha", 3), (201, None, "alpha", 3), (202, "d0", "none such", 3)]
    m, e = spark.createDataFrame(meetings, ROWS), spark.createDataFrame(entries, ROWS.replace("meeting_id", "entry"))
    words = lambda t: {w for w in re.split("[^a-z]+", t) if len(w) > 3}
    want = {}
    for k, day, title, at in meetings:
        found = [(at is None or b is None, 0 if at is None or b is None else abs(b - at), n) for n, d, t, b in entries if d == day and words(t) & words(title)]
        if found:
            want[k] = min(found)[2]
    assert {r.meeting_id: r.entry for r in calendar_match(m, e).collect()} == want and len(want) > 30


def test_a_day_is_no_square(spark):
    """No join by day and word alone: ten thousand meetings of one day and word meet a row for each moment."""
    m = spark.range(10_000).selectExpr("id as meeting_id", "'d' as day", "'budget' as title", "cast(id % 24 as int) as at")
    out = calendar_match(m, m.withColumnRenamed("meeting_id", "entry"))
    assert out.count() == 10_000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert joins and all("<=>" in line for line in joins)
