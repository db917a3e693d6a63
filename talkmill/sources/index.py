"""A term index on disk: postings sorted by term, the documents beside them, kept in step with a table by revisions.

Postings are range-partitioned and sorted by (term, key), so a common term lies in several files and the statistics of Parquet's row groups let a
scan read only the terms, or the range of terms with a prefix, that a query names. A sync appends the postings of new and changed
documents as another segment and rewrites the small table of documents; postings of texts that are gone do not match a document's
revision any more. `compact` writes one segment again.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.operators.retrieval import K1, B, query_terms, terms_of


def term_counts(terms: Column) -> Column:
    """array of (term, tf) of sorted terms: runs of equal ones; null for null."""
    starts = F.filter(F.sequence(F.lit(0), F.size(terms) - 1), lambda i: (i == 0) | (F.get(terms, i) != F.get(terms, i - 1)))
    ends = lambda s, k: F.coalesce(F.get(s, k + 1), F.size(terms))
    counted = F.transform(F.array(starts), lambda s: F.transform(s, lambda at, k: F.struct(F.get(terms, at).alias("term"), (ends(s, k) - at).cast("long").alias("tf"))))
    return F.when(F.size(terms) > 0, F.get(counted, F.lit(0)))


class TermIndex:
    """An index under a folder that driver and executors share. One writer at a time; readers see the last version that was published."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _versions(self) -> list[tuple[int, str]]:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/documents")
        files = root.getFileSystem(conf)
        if not files.exists(root):
            return []
        names = [s.getPath().getName() for s in files.listStatus(root)]
        return sorted((int(n.split("-")[0]), n) for n in names if "-" in n and files.exists(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/documents/{n}/_SUCCESS")))

    def documents(self) -> DataFrame:
        """(key, revision, size, segment) of the documents that are indexed."""
        versions = self._versions()
        schema = "key long, revision long, size long, segment string"
        return self.spark.read.schema(schema).parquet(f"{self.folder}/documents/{versions[-1][1]}") if versions else self.spark.createDataFrame([], schema)

    def _postings(self) -> DataFrame:
        """(term, key, revision, tf) of all segments that some document is in."""
        segments = [r["segment"] for r in self.documents().select("segment").distinct().collect()]  # as many as syncs since the last compaction
        schema = "term string, key long, revision long, tf long"
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/postings/{s}" for s in segments)) if segments else self.spark.createDataFrame([], schema)

    def _write(self, texts: DataFrame, segment: str) -> None:
        """Postings of rows (key, revision, counts): counts are a text's own, so the only exchange is the one that sorts them."""
        rows = texts.select("key", "revision", F.explode("counts").alias("c")).select("c.term", "key", "revision", "c.tf")
        rows = rows.repartitionByRange("term", "key").sortWithinPartitions("term", "key")
        rows.write.option("parquet.block.size", str(8 << 20)).parquet(f"{self.folder}/postings/{segment}")

    def _kept(self, rows: DataFrame, name: str) -> DataFrame:
        """Rows that a sync reads more than once."""
        rows.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{name}")

    def _discard(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def sync(self, documents: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
        """Brings the index in step with documents(key, text) and returns one row: indexed, updated, removed, unchanged.

        Only texts that are new or changed are split into terms, once, and written. Null keys are left out; of several rows of a key the one of the greatest
        revision counts; a null text has no terms and no size.
        """
        own = documents.select(F.col(key).cast("long").alias("key"), F.xxhash64(column).alias("revision"), F.col(column).alias("text"))
        own = own.where("key is not null")
        old, segment = self.documents(), uuid.uuid4().hex
        latest = self._kept(own.groupBy("key").agg(F.max("revision").alias("revision")), f"latest/{segment}")
        fresh = latest.join(old.select("key", "revision"), ["key", "revision"], "left_anti")
        # Texts are exchanged as they are, and split where they arrive; the terms of a text are counted in its own row.
        texts = own.join(fresh, ["key", "revision"], "left_semi").groupBy("key", "revision").agg(F.first("text").alias("text"))
        texts = texts.select("key", "revision", F.explode(F.array(F.sort_array(terms_of(F.col("text"))))).alias("terms"))
        texts = texts.select("key", "revision", F.size("terms").cast("long").alias("size"), term_counts(F.col("terms")).alias("counts"))
        texts = self._kept(texts, f"texts/{segment}")
        self._write(texts, segment)
        kept = old.join(latest, ["key", "revision"], "left_semi")
        added = texts.select("key", "revision", "size", F.lit(segment).alias("segment"))
        versions = self._versions()
        name = f"{versions[-1][0] + 1 if versions else 0}-{segment}"
        kept.unionByName(added).write.parquet(f"{self.folder}/documents/{name}")
        for part in (f"latest/{segment}", f"texts/{segment}"):
            self._discard(part)
        now = self.spark.read.schema(old.schema).parquet(f"{self.folder}/documents/{name}")
        both = now.select("key", F.col("segment").alias("new")).join(old.select("key", F.col("segment").alias("was")), "key", "full")
        count = lambda x: F.count_if(x)
        return both.agg(
            count(F.col("was").isNull()).alias("indexed"),
            count(F.col("was").isNotNull() & (F.col("new") == segment)).alias("updated"),
            count(F.col("new").isNull()).alias("removed"),
            count(F.col("was").isNotNull() & (F.col("new") != segment)).alias("unchanged"),
        )

    def hits(self, terms: list[str], prefix: str | None = None) -> DataFrame:
        """(term, key, tf, size): the postings of the terms, and of the terms with the prefix, in the texts that are current."""
        rows = self._postings()
        asked = F.col("term").isin(terms) if terms else F.lit(False)
        asked = asked | F.col("term").startswith(prefix) if prefix is not None else asked
        return rows.where(asked).join(self.documents().select("key", "revision", "size"), ["key", "revision"]).drop("revision")

    def matching(self, query: str) -> DataFrame:
        """(key): documents with all whole terms of a query and a term that begins as its last one; none for an empty query."""
        whole, prefix = query_terms(query)
        whole = sorted(set(whole))
        if prefix is None:
            return self.documents().select("key").limit(0)
        rows = self.hits(whole, prefix).groupBy("key")
        found = rows.agg(F.count_if(F.col("term").isin(whole) if whole else F.lit(False)).alias("whole"), F.max(F.col("term").startswith(prefix)).alias("begun"))
        return found.where((F.col("whole") == len(whole)) & F.col("begun")).select("key")

    def ranked(self, terms: list[str], k: int = 25) -> DataFrame:
        """(key, score, matched) of the k best documents by BM25 over the terms, ties to the smaller key."""
        terms = sorted(set(terms))
        total, mean = self.documents().agg(F.count("*"), F.avg("size")).first()
        hits = self.hits(terms)
        often = hits.groupBy("term").agg(F.count("*").alias("df"))  # a row for each term of the query
        idf = F.log(1 + (F.lit(float(total)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.lit(float(mean or math.nan))))
        rows = hits.join(F.broadcast(often), "term").groupBy("key").agg(F.round(F.sum(part), 6).alias("score"), F.count("*").alias("matched"))
        return rows.orderBy(F.desc("score"), "key").limit(k)

    def compact(self) -> None:
        """Writes the postings of current texts as one segment."""
        live, segment = self.documents(), uuid.uuid4().hex
        rows = self._postings().join(live.select("key", "revision"), ["key", "revision"], "left_semi")
        rows = rows.repartitionByRange("term", "key").sortWithinPartitions("term", "key").select("term", "key", "revision", "tf")
        rows.write.option("parquet.block.size", str(8 << 20)).parquet(f"{self.folder}/postings/{segment}")
        live.withColumn("segment", F.lit(segment)).write.parquet(f"{self.folder}/documents/{self._versions()[-1][0] + 1}-{segment}")
