"""Event logs, live transcripts and context stores as JSON lines; appends and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: States that a job does not leave by itself. Fixed values.
FINISHED = ("complete", "needs_review", "failed")
EVENT = "v int, seq long, timestamp timestamp, event_type string"
LINE = "line long, ts timestamp, offset_ms long, duration_ms long, text string, speaker string"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """(seq, ts, event_type, value): events of all rotated files; malformed lines are skipped, a seq of 0 becomes the place in the log.

    The place is the file's name and the line's order in it.
    """
    raw = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    rows = raw.withColumn("e", F.from_json("value", EVENT)).where("e.event_type is not null")
    synthetic = rows.where("coalesce(e.seq, 0) = 0")  # only lines of logs from before seq
    counts = synthetic.groupBy("file").agg(F.count("*").alias("n"))
    before = counts.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each file
    place = F.row_number().over(Window.partitionBy("file").orderBy("at"))
    numbered = synthetic.join(before, "file").withColumn("seq", (F.col("before") + place).cast("long")).drop("before")
    own = rows.where("coalesce(e.seq, 0) <> 0").withColumn("seq", F.col("e.seq"))
    return own.unionByName(numbered).select("seq", F.col("e.timestamp").alias("ts"), "e.event_type", "value")


def append_events(events: DataFrame, log: DataFrame, path: str, rotate: int = 50_000) -> None:
    """Appends (ts, event_type, payload) with the next sequence numbers, in order of time.

    Numbers are given by time ranges: the ranges are counted first, then each numbers its own rows. A file gets `rotate` events at most. One writer
    at a time: the number is checked again before the rows are written, and a ValueError says that another one has been there.
    """
    high = log.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    dealt = events.repartitionByRange("ts", "payload").sortWithinPartitions("ts", "payload").withColumn("part", F.spark_partition_id())
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rows = dealt.join(before, "part").withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("ts", "payload")))
    out = rows.select(F.lit(1).alias("v"), (F.lit(high) + F.col("before") + F.col("place")).alias("seq"), F.col("ts").alias("timestamp"), "event_type", "payload")
    if log.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0] != high:
        raise ValueError("another writer has appended to the log")
    out.write.mode("append").option("maxRecordsPerFile", rotate).json(path)


def allowed_annotations(annotations: DataFrame, agents: DataFrame) -> DataFrame:
    """Annotations of the agents on the list."""
    return annotations.join(agents.select("agent").distinct(), "agent", "left_semi")


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """base with the last change of each key in its place, and the new keys; columns as base has them."""
    rest = [c for c in base.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("last"))
    rows = base.withColumn("row", F.struct(*rest)).select(*keys, "row").join(last, keys, "full")
    kept = F.coalesce("last", "row")
    return rows.select(*keys, *(kept[c].alias(c) for c in rest)).select(base.columns)


def removed(base: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return base.join(gone.select(*keys).distinct(), keys, "left_anti")


def read_live(spark: SparkSession, path: str, after: int = 0) -> DataFrame:
    """Transcript lines after a cursor; malformed lines are skipped."""
    rows = spark.read.text(path).select(F.from_json("value", LINE).alias("l")).select("l.*")
    return rows.where(F.col("line") > after)


def recent_lines(lines: DataFrame, as_of: str, ms: int) -> DataFrame:
    """Lines of the last ms milliseconds before as_of."""
    return lines.where((F.col("ts") <= F.lit(as_of).cast("timestamp")) & (F.col("ts") >= F.lit(as_of).cast("timestamp") - F.expr(f"interval {ms / 1000} seconds")))


def stale_revisions(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """(doc_id, state): indexed revisions that are current, changed or gone. Both: (doc_id, sha256)."""
    rows = indexed.select("doc_id", F.col("sha256").alias("a")).join(current.select("doc_id", F.col("sha256").alias("b")), "doc_id", "left")
    return rows.select("doc_id", F.when(F.col("b").isNull(), "gone").when(F.col("a") == F.col("b"), "current").otherwise("changed").alias("state"))


def recovered_jobs(jobs: DataFrame, alive: DataFrame, most: int = 2) -> DataFrame:
    """Unfinished jobs whose owners are gone lose them and go back to the queue, or fail after more than `most` retries. jobs: (job, state, owner, retries)."""
    rows = jobs.join(alive.select("owner", F.lit(True).alias("up")).distinct(), "owner", "left")
    lost = ~F.col("state").isin(*FINISHED) & F.col("owner").isNotNull() & F.col("up").isNull()
    retries = F.when(lost, F.col("retries") + 1).otherwise(F.col("retries"))
    state = F.when(lost & (retries > most), "failed").when(lost, "queued").otherwise(F.col("state"))
    return rows.select("job", state.alias("state"), F.when(~lost, F.col("owner")).alias("owner"), retries.alias("retries"))
