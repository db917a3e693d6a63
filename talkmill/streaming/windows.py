"""Windowed aggregates over event streams with watermarks. The windows are extensions: earlier systems order by sequence alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "600 seconds") -> DataFrame:
    """(start, event_type, n, value) of fixed windows over (ts, event_type, value); events later than the watermark are left out."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n", "value")


def by_session(events: DataFrame, gap: str = "1800 seconds", late: str = "600 seconds") -> DataFrame:
    """(user_id, start, end, n) of runs of a user's events without a longer gap."""
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def debounced(partials: DataFrame, every: str = "250 milliseconds", late: str = "1 second") -> DataFrame:
    """(session, text): of each short window the newest partial. partials: (ts, session, sequence, revision, text)."""
    rows = partials.withWatermark("ts", late).groupBy(F.window("ts", every), "session")
    return rows.agg(F.max_by("text", F.struct("sequence", "revision")).alias("text")).select("session", F.col("window.start").alias("start"), "text")


def attributed(lines: DataFrame, segments: DataFrame, late: str = "600 seconds") -> DataFrame:
    """Stream-stream join of lines (line, session, l_start, l_end) with overlapping speaker segments (session, speaker, start, end); times are timestamps."""
    a = lines.withWatermark("l_start", late)
    b = segments.withWatermark("start", late)
    held = (a["session"] == b["session"]) & (b["start"] < a["l_end"]) & (b["end"] > a["l_start"]) & (b["start"] >= a["l_start"] - F.expr("interval 600 seconds"))
    overlap = F.least(a["l_end"], b["end"]).cast("double") - F.greatest(a["l_start"], b["start"]).cast("double")
    return a.join(b, held).select(a["session"], "line", "speaker", overlap.alias("overlap"))


def newest_percentiles(rows: DataFrame, key: str, order: str, value: str, newest: int = 64) -> DataFrame:
    """rows with n, p50 and p95: nearest-rank percentiles of a key's newest values so far."""
    ring = F.collect_list(value).over(Window.partitionBy(key).orderBy(order).rowsBetween(1 - newest, 0))
    rank = lambda p: F.element_at("ring", F.greatest(F.lit(1), F.ceil(F.size("ring") * p / 100)).cast("int")).alias(f"p{p}")
    return rows.withColumn("ring", F.sort_array(ring)).select(*rows.columns, F.size("ring").cast("long").alias("n"), rank(50), rank(95))


def to_memory_sink(stream: DataFrame, checkpoint: str, seen: str, write: Callable[[DataFrame], None]) -> StreamingQuery:
    """Starts a query that hands each batch to `write`; the numbers of written batches are kept as files in the folder `seen`.

    A batch that is delivered again after a restart is skipped if its number is there. Only a batch whose writing was cut short comes twice.
    """
    spark = stream.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{seen}/{number}")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            write(batch)
            files.mkdirs(path.getParent())
            files.createNewFile(path)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
