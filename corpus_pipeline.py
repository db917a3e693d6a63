"""The corpus pipeline: quality, line dedup, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; each works on all that its predecessor kept. All but the
last return the columns of documents, as they are, whatever further columns docs has and however they are named. No rows give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from talkmill.llm import lines, packing, quality, simhash, tiling
from talkmill.llm.shared import written
from talkmill.tables import load


#: Rows of documents that Python gets at once, and words that a task of the last stage remembers. A worker lives through all stages, so what one leaves in it the others lack.
ROWS, WORDS = 1_000, 100_000


def lean(spark: SparkSession) -> None:
    """Arrow batches of at most ROWS rows from here on: whole texts, and what is made of them, are held a batch at a time in the JVM and in Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS:
        spark.conf.set(key, str(ROWS))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.5 or more.

    The model learns from the labelled rows of docs that are in the folds 0 and 2 of `labels`; without enough of them every score is 0.5, and all
    stay. Null and empty texts are scored like texts without any difference. Whole texts are scored, very long ones too. Each
    repeated row is judged by itself, so equal rows stay or go together; a null doc_id is no obstacle.
    """
    lean(spark)
    return quality.good_only(docs, quality.train(docs, load(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that two other documents or more repeat; n_chars follows the text.

    Lines count from 20 code points on; of equal ones (blanks at the ends and the case of A-Z aside) those in the largest doc_id stay. No row
    goes. A null text stays null, an empty one empty; a text all of whose lines go becomes empty. Rows of one doc_id are parts of one
    document. Rows without doc_id neither count nor change.
    """
    return lines.without_lines(docs, min_chars=20, min_docs=3)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id: five-word shingles, Jaccard similarity 0.8 or more.

    Null and empty texts have no shingles and are one group. Texts of fewer than five words are one shingle. Each row is
    judged by its own text; equal rows of the doc_id that stays all stay. Rows without doc_id stay.
    """
    lean(spark)
    return simhash.keep_one(docs, similarity=0.8, shingle=5)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of `benchmark`: none half of whose words stand in the document, in runs of five or more.

    Null and empty texts hold nothing and stay; so do all if the benchmark is empty. Repeated rows go or stay together; a null doc_id is no obstacle.
    """
    lean(spark)
    return tiling.decontaminated(docs, load(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, in sequences of powers of two.

    A null or empty text is its end id alone. Very long texts are cut into sequences of 4,096 first. Repeated rows and ids, and null ones, are packed row by row.
    """
    lean(spark)
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), words=WORDS)


STAGES = [
    ("quality", keep_good),
    ("lines", drop_lines),
    ("near_duplicates", drop_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: Compression, fingerprints and tokenizers are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read by the next."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
