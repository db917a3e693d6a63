"""Interval and as-of joins, interval merging.

Ranges of any length are equi-joined, never crossed. Time is cut into units of `width`, and a node of level k is 2 ** k units. An interval lies
at the lowest level where it touches two nodes at most, so it is two rows however long it is; a point looks into its node of each level
that some interval has. A year at a width of a second has 25 levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def leveled(intervals: DataFrame, start: str, end: str, width: float, slack: float = 0.0) -> DataFrame:
    """The intervals with the first and last unit that [start - slack, end + slack] touches, and their level."""
    first, last = (F.floor((F.col(c) + s) / width).cast("long") for c, s in ((start, -slack), (end, slack)))
    rows = intervals.withColumn("_first", first).withColumn("_last", F.greatest(first, last))
    span = F.col("_last") - F.col("_first")
    return rows.withColumn("_level", F.when(span > 1, F.length(F.bin(span - 1))).otherwise(0))


def levels_of(rows: DataFrame) -> list[int]:
    """The levels that intervals have: 64 at most."""
    return sorted(r["_level"] for r in rows.select("_level").distinct().collect() if r["_level"] is not None)


def up(unit: str, level: Column) -> Column:
    return F.call_function("shiftright", F.col(unit), level)


def at_nodes(rows: DataFrame, level: Column) -> DataFrame:
    """A row for each node of the level, not under the interval's own, that an interval touches: two at most."""
    rows = rows.withColumn("level", level)
    return rows.withColumn("node", F.explode(F.sequence(up("_first", F.col("level")), up("_last", F.col("level")))))


def of_points(points: DataFrame, at: str, width: float, levels: list[int]) -> DataFrame:
    """A row for each point and level, with the node that holds the point."""
    rows = points.withColumn("_unit", F.floor(F.col(at) / width).cast("long")).withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    return rows.withColumn("node", up("_unit", F.col("level"))).drop("_unit")


def near_points(points: DataFrame, intervals: DataFrame, at: str, keys: list[str], width: float, slack: float = 0.0) -> DataFrame:
    """Each point with each interval of its keys that holds it, slack included, and with some of those that nearly do; no pair twice."""
    rows = leveled(intervals, "start", "end", width, slack)
    own = at_nodes(rows, F.col("_level")).drop("_first", "_last", "_level")
    return of_points(points, at, width, levels_of(rows)).join(own, [*keys, "level", "node"]).drop("level", "node")


def containing(points: DataFrame, intervals: DataFrame, at: str, keys: list[str], width: float) -> DataFrame:
    """Points joined with the intervals [start, end] of their keys that hold them."""
    return near_points(points, intervals, at, keys, width).where((F.col(at) >= F.col("start")) & (F.col(at) <= F.col("end")))


def latest_containing(points: DataFrame, intervals: DataFrame, point_id: str, at: str, keys: list[str], width: float) -> DataFrame:
    """(point_id, interval): for each point the interval that holds it and starts last, of equals the greatest id; else null."""
    best = containing(points, intervals, at, keys, width).groupBy(point_id).agg(F.max(F.struct("start", "interval"))["interval"].alias("interval"))
    return points.select(point_id).join(best, point_id, "left")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], width: float, slack: float = 0.0) -> DataFrame:
    """Pairs of left (l_start, l_end) and right (start, end) intervals of the same keys that overlap or lie within the slack.

    Of two intervals, the one of the lower level looks into the nodes that it touches at the level of the other. A pair is kept in the first
    node that both touch.
    """
    a = leveled(left, "l_start", "l_end", width, slack).withColumnsRenamed({"_first": "l_first", "_last": "l_last", "_level": "l_level"})
    b = leveled(right, "start", "end", width)
    as_left = {"l_first": "_first", "l_last": "_last"}
    back = {v: k for k, v in as_left.items()}

    def upward(rows: DataFrame, own: str, levels: list[int], least: int) -> Column:
        """The levels of the other side from `least` above an interval's own on."""
        return F.explode(F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda k: k >= F.col(own) + least))

    own_left, own_right = levels_of(a.select(F.col("l_level").alias("_level"))), levels_of(b)
    lower = a.withColumn("level", upward(a, "l_level", own_right, 0)).withColumnsRenamed(as_left)
    lower = at_nodes(lower, F.col("level")).withColumnsRenamed(back)
    pairs = lower.join(at_nodes(b, F.col("_level")), [*keys, "level", "node"])
    higher = at_nodes(a.withColumnsRenamed(as_left), F.col("l_level")).withColumnsRenamed(back)
    small = at_nodes(b.withColumn("level", upward(b, "_level", own_left, 1)), F.col("level"))
    pairs = pairs.unionByName(higher.join(small, [*keys, "level", "node"]))
    pairs = pairs.where((F.col("start") < F.col("l_end") + slack) & (F.col("end") > F.col("l_start") - slack))
    first = up("_shared", F.col("level"))
    pairs = pairs.withColumn("_shared", F.greatest("l_first", "_first")).where(F.col("node") == first)
    return pairs.drop("level", "node", "l_first", "l_last", "l_level", "_first", "_last", "_level", "_shared")


def by_overlap(lines: DataFrame, segments: DataFrame, line_id: str, keys: list[str], width: float) -> DataFrame:
    """(line_id, speaker, overlap): the speaker of the greatest total overlap, of equals the least; lines without overlap go."""
    pairs = overlapping(lines, segments, keys, width)
    total = pairs.groupBy(line_id, "speaker").agg(F.sum(F.least("l_end", "end") - F.greatest("l_start", "start")).alias("overlap"))
    best = total.groupBy(line_id).agg(F.max(F.struct("overlap", (-F.col("speaker")).alias("speaker"))).alias("b"))
    return best.select(line_id, (-F.col("b.speaker")).alias("speaker"), F.col("b.overlap").alias("overlap"))


def speaker_at(points: DataFrame, segments: DataFrame, point_id: str, at: str, keys: list[str], reach: float = 0.5, forward: float | None = None, width: float = 30.0) -> DataFrame:
    """(point_id, speaker): of the segment [start, end) that holds the point, else of the next one that starts within `forward`,
    else of the last one that ended within `reach`, else null. The earliest start wins inside a class, then the least speaker."""
    ahead = reach if forward is None else forward
    pairs = near_points(points, segments, at, keys, width, max(reach, ahead))
    held = (F.col("start") <= F.col(at)) & (F.col(at) < F.col("end"))
    gap = F.when(held, F.struct(F.lit(0).alias("c"), F.col("start").cast("double").alias("g")))
    gap = gap.when((F.col("start") > F.col(at)) & (F.col("start") - F.col(at) <= ahead), F.struct(F.lit(1).alias("c"), (F.col("start") - F.col(at)).cast("double").alias("g")))
    gap = gap.when((F.col("end") <= F.col(at)) & (F.col(at) - F.col("end") <= reach), F.struct(F.lit(2).alias("c"), (F.col(at) - F.col("end")).cast("double").alias("g")))
    ranked = pairs.withColumn("gap", gap).where("gap is not null")
    best = ranked.groupBy(point_id).agg(F.min(F.struct("gap", "speaker"))["speaker"].alias("speaker"))
    return points.select(point_id).join(best, point_id, "left")


def merged(intervals: DataFrame, keys: list[str], bridge: float) -> DataFrame:
    """(keys, start, end, n): runs of intervals whose gaps, after all that came before, are at most `bridge`."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = intervals.withColumn("fresh", (before.isNull() | (F.col("start") > before + bridge)).cast("int"))
    rows = rows.withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("run")


def dominant_speaker(segments: DataFrame, keys: list[str], share: float = 0.6) -> DataFrame:
    """(keys, speaker): whose segments last at least that share of all; null if nobody's do. Equals: the least speaker."""
    own = segments.groupBy(*keys, "speaker").agg(F.sum(F.col("end") - F.col("start")).alias("spoken"))
    whole = own.groupBy(*keys).agg(F.sum("spoken").alias("all"), F.max(F.struct("spoken", (-F.col("speaker")).alias("speaker"))).alias("b"))
    return whole.select(*keys, F.when((F.col("all") > 0) & (F.col("b.spoken") >= share * F.col("all")), -F.col("b.speaker")).alias("speaker"))


def speaker_count(segments: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """(keys, n): the speakers that speak for at least so long in all."""
    own = segments.groupBy(*keys, "speaker").agg(F.sum(F.col("end") - F.col("start")).alias("spoken"))
    return own.groupBy(*keys).agg(F.count_if(F.col("spoken") >= least).alias("n"))


def windows_of(turns: DataFrame, key: str, start: str, longest: float = 8.0) -> DataFrame:
    """Each row with `end`: the next start, or start + longest if that is sooner; windows without length go."""
    following = F.lead(start).over(Window.partitionBy(key).orderBy(start))
    rows = turns.withColumn("end", F.least(F.coalesce(following, F.col(start) + longest), F.col(start) + longest))
    return rows.where(F.col("end") > F.col(start))
