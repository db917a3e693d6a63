"""Interval joins against brute force, with intervals of seconds and of years together, and the number of rows they make."""

import random

import pytest
from pyspark.sql import functions as F

from talkmill.operators import intervals

YEAR = 365 * 86_400.0


def lengths(rng):
    return rng.choice([0.0, 0.4, 3.0, 20.0, 700.0, 86_400.0, YEAR])


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(3)
    points = [(i, i % 2, rng.uniform(-100, 2 * YEAR) if i % 3 else rng.uniform(0, 900)) for i in range(300)]
    spans = [(i, i % 2, s := rng.uniform(-200, 900) if i % 2 else rng.uniform(0, YEAR), s + lengths(rng), i % 5) for i in range(300)]
    lines = [(i, i % 2, s := rng.uniform(-200, 900) if i % 3 else rng.uniform(0, YEAR), s + lengths(rng)) for i in range(250)]
    frames = [spark.createDataFrame(r, c) for r, c in ((points, "p long, k int, at double"), (spans, "interval long, k int, start double, end double, speaker int"), (lines, "line long, k int, l_start double, l_end double"))]
    return points, spans, lines, frames


def test_containing(data):
    points, spans, _, (p, s, _) = data
    got = sorted((r["p"], r["interval"]) for r in intervals.containing(p, s, "at", ["k"], 20.0).collect())
    assert got == sorted((i, j) for i, k, at in points for j, m, a, b, _ in spans if k == m and a <= at <= b) and len(got) > 1000


@pytest.mark.parametrize("slack", [0.0, 1.0])
def test_overlapping(data, slack):
    _, spans, lines, (_, s, lines_df) = data
    got = sorted((r["line"], r["interval"]) for r in intervals.overlapping(lines_df, s, ["k"], 20.0, slack).collect())
    assert got == sorted((i, j) for i, k, a, b in lines for j, m, c, d, _ in spans if k == m and c < b + slack and d > a - slack) and len(got) > 1000


def test_latest(data):
    points, spans, _, (p, s, _) = data
    got = {r["p"]: r["interval"] for r in intervals.latest_containing(p, s, "p", "at", ["k"], 20.0).collect()}
    want = {i: max(((a, j) for j, m, a, b, _ in spans if k == m and a <= at <= b), default=(None, None))[1] for i, k, at in points}
    assert got == want


def test_rows_are_bounded(data):
    """Two rows an interval; a point is a row for each level, about log2 of the range over the width."""
    *_, (p, s, _) = data
    rows = intervals.leveled(s, "start", "end", 1.0, 0.5)
    assert intervals.at_nodes(rows, F.col("_level")).count() <= 2 * s.count()
    assert len(intervals.levels_of(rows)) <= 26 and max(intervals.levels_of(rows)) <= 25


def test_nothing(data):
    *_, (p, s, lines) = data
    assert intervals.containing(p, s.limit(0), "at", ["k"], 20.0).count() == 0
    assert intervals.overlapping(lines.limit(0), s, ["k"], 20.0).count() == 0
