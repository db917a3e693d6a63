"""Line dedup over levelled sorted runs of line hashes.

A run holds one row for each line key of a batch of documents: the key's hash, the number of documents
that hold it, and the largest of their ids. Runs are bucketed and sorted by hash, all alike, so that they are merged with each
other and with a batch bucket by bucket, without a new exchange. When two runs
stand on a level they are compacted into one of the next level. Batches come in falling order of doc_id.
Each new batch merge-anti-joins the runs: keys that a run knows in `min_docs` documents of higher ids are known to go
and to stay in a document already seen, so only the other keys are added, as the batch's own run.

All steps are DataFrame functions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.llm.shared import discard, scratch_dir, written

BLANK = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z alone in lower case; lower() does that where all characters are ASCII, and faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    """The lines of a text; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def postings(documents: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, row, h1, h2, at): the places of the keys of at least min_chars code points."""
    lines = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("row"),
        F.posexplode(lines_of(F.col("text"))).alias("at", "line"),
    ).where("doc_id is not null")
    lines = lines.where(F.char_length("line") >= min_chars).withColumn("key", F.btrim("line", F.lit(BLANK)))
    lines = lines.where(F.char_length("key") >= min_chars).withColumn("key", ascii_lower(F.col("key")))
    return lines.select("doc_id", "row", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), "at")


class LineRuns:
    """Levelled sorted runs of (h1, h2, docs, last), as bucketed tables in the shared folder; a level holds one run at most."""

    def __init__(self, spark: SparkSession, min_docs: int):
        self.spark, self.min_docs, self.levels = spark, min_docs, []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def runs(self) -> list[str]:
        return [r for r in self.levels if r]

    def merged(self, one: str, other: str) -> DataFrame:
        """Two runs as one: a merge join, bucket by bucket. (A union of bucketed tables does not keep buckets together in all releases.)"""
        a, b = (self.spark.table(r).withColumnsRenamed({"docs": f"docs_{i}", "last": f"last_{i}"}) for i, r in enumerate((one, other)))
        docs = F.coalesce("docs_0", F.lit(0)) + F.coalesce("docs_1", F.lit(0))
        return a.join(b, ["h1", "h2"], "full").select("h1", "h2", docs.alias("docs"), F.greatest("last_0", "last_1").alias("last"))

    def add(self, batch: DataFrame) -> None:
        """Adds a batch (doc_id, h1, h2) whose ids lie below those of all batches before."""
        own = batch.select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2")
        own = own.agg(F.count("*").alias("docs"), F.max("doc_id").alias("last"))
        for run in self.runs():
            own = own.join(self.spark.table(run).where(F.col("docs") >= self.min_docs).select("h1", "h2"), ["h1", "h2"], "left_anti")
        run, level = self._put(own), 0
        while level < len(self.levels) and self.levels[level]:
            # Two runs of a level are compacted into one of the next.
            full = (self.levels[level], run)
            self.levels[level], run = None, self._put(self.merged(*full))
            self._drop(*full)
            level += 1
        self.levels += [None] * (level + 1 - len(self.levels))
        self.levels[level] = run

    def settled(self) -> DataFrame:
        """(h1, h2, docs, last) of the keys that min_docs documents hold; ends the runs."""
        rest = self.runs()
        while len(rest) > 1:
            full = rest[:2]
            rest = [self._put(self.merged(*full)), *rest[2:]]
            self._drop(*full)
        found = written(self.spark.table(rest[0]).where(F.col("docs") >= self.min_docs), "settled")
        self._drop(*rest)
        self.levels = []
        return found

    def _put(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        writer = rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("compression", "zstd")
        writer.option("path", f"{scratch_dir(self.spark)}/{name}").saveAsTable(name)
        return name

    def _drop(self, *runs: str) -> None:
        for r in runs:
            discard(self.spark.table(r))
            self.spark.sql(f"DROP TABLE IF EXISTS {r}")


def dropped_lines(documents: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 6) -> DataFrame:
    """(doc_id, row, at) of the lines to drop; row is the hash of the text they stand in."""
    found = postings(documents, min_chars)
    ids = documents.select(F.col("doc_id").cast("double").alias("d")).where("d is not null")
    cuts = sorted({int(x) for x in ids.approxQuantile("d", [i / batches for i in range(1, batches)], 0.01)}, reverse=True) if batches > 1 else []
    batch = F.lit(len(cuts))
    for i, cut in reversed(list(enumerate(cuts))):
        batch = F.when(F.col("doc_id") > cut, i).otherwise(batch)
    kept = written(found.withColumn("batch", batch.cast("int")), "postings", ["batch"])
    runs = LineRuns(documents.sparkSession, min_docs)
    for i in range(len(cuts) + 1):
        runs.add(kept.where(F.col("batch") == i))
    found = runs.settled()
    settled = found.select("h1", "h2", "last")
    # Keys in a hundred-thousandth of all places or more are at most 100,000; they are broadcast, so that
    # no task gets a hot key's places.
    total = kept.count()
    often = found.where(F.col("docs") >= max(1, total // 100_000) + min_docs)
    heavy = F.broadcast(often.select("h1", "h2", F.col("last").alias("heavy_last")))
    rest = kept.join(heavy, ["h1", "h2"], "left")
    hot = rest.where("heavy_last <> doc_id")
    cold = rest.where("heavy_last is null").join(settled, ["h1", "h2"]).where("last <> doc_id")
    columns = ["doc_id", "row", "at"]
    return hot.select(columns).unionByName(cold.select(columns))


def _parted(documents: DataFrame, min_chars: int, min_docs: int, batches: int) -> DataFrame:
    """(row, lines, drop): each row of documents as a struct, its lines, and the sorted places of those to drop (null for none)."""
    drops = dropped_lines(documents, min_chars, min_docs, batches)
    drops = drops.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("at")).alias("drop"))
    drops = drops.select(F.col("doc_id").alias("d"), F.col("row").alias("r"), "drop")
    rows = documents.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h"), lines_of(F.col("text")).alias("lines"))
    return rows.join(drops, (F.col("id") == F.col("d")) & (F.col("h") == F.col("r")), "left").select("row", "lines", "drop")


def _kept() -> Column:
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    joined = F.array_join(F.transform(stay, lambda i: F.element_at("lines", i + 1)), "\n")
    return F.when(F.col("drop").isNull(), F.coalesce("row.text", F.lit(""))).otherwise(joined)


def dedup_lines(documents: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 6) -> DataFrame:
    """documents with n_lines (before), n_dropped and kept_text.

    A line's key is the line without blanks at its ends, A-Z in lower case. Keys of at least min_chars code points in at least
    min_docs documents lose all their lines except in the largest doc_id that holds them. Null and
    empty texts are one empty line. Rows without doc_id hold no keys and keep their lines. Rows of a
    repeated doc_id are parts of one document; each keeps its own row. Columns with clashing
    names (n_lines, n_dropped, kept_text) are replaced. No rows give no rows.
    """
    own = [F.col("row")[c].alias(c) for c in documents.columns if c not in ("n_lines", "n_dropped", "kept_text")]
    dropped = F.when(F.col("drop").isNull(), F.lit(0)).otherwise(F.size("drop")).cast("long")
    rows = _parted(documents, min_chars, min_docs, batches)
    return rows.select(*own, F.size("lines").cast("long").alias("n_lines"), dropped.alias("n_dropped"), _kept().alias("kept_text"))


def without_lines(documents: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 6) -> DataFrame:
    """documents without the lines that `dedup_lines` drops: `text` holds the kept ones (null stays null), `n_chars`, if there is one, its code points.

    All other columns stay as they are, those of any name included.
    """
    text = F.when(F.col("row.text").isNotNull(), _kept())
    new = {"text": text, "n_chars": F.char_length(text).cast("long")}
    rows = _parted(documents, min_chars, min_docs, batches)
    return rows.select(*(new.get(c, F.col("row")[c]).alias(c) for c in documents.columns))
