"""A census of a folder from file metadata: formats, categories, ages and sizes. Contents are not read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
CATEGORIES = {
    "pdf": ("pdf",), "word_processing": ("doc", "docm", "docx", "dot", "dotm", "dotx", "odt", "rtf", "rtfd", "wpd", "wps"), "email": ("eml", "mbox", "msg", "olm", "ost", "pst"),
    "plain_text": ("md", "text", "txt"), "markup": ("htm", "html", "xml"), "image_or_scan": ("bmp", "gif", "heic", "jpeg", "jpg", "png", "tif", "tiff"),
    "spreadsheet": ("csv", "numbers", "ods", "xls", "xlsb", "xlsm", "xlsx"), "presentation": ("key", "odp", "ppt", "pptm", "pptx"),
    "archive": ("7z", "bz2", "gz", "rar", "tar", "tar.bz2", "tar.gz", "tar.xz", "xz", "zip"), "database": ("accdb", "db", "mdb", "sqlite", "sqlite3"),
    "apple_document": ("pages",), "icloud_placeholder": ("icloud",),
}


def extension(path: Column) -> Column:
    """The extension in lower case, of packed tar files both parts; empty without one."""
    return F.regexp_extract(F.lower(F.substring_index(path, "/", -1)), r"[^.].*?\.(tar\.(?:gz|bz2|xz)|[^.]*)$", 1)


def category(ext: Column) -> Column:
    out = F.lit("other")
    for name, exts in CATEGORIES.items():
        out = F.when(ext.isin(*exts), name).otherwise(out)
    return out


def size_bucket(octets: Column) -> Column:
    kib = 1024
    return (
        F.when(octets == 0, "zero").when(octets < 100 * kib, "under_100_kib").when(octets < kib * kib, "100_kib_to_1_mib").when(octets < 10 * kib * kib, "1_mib_to_10_mib")
        .when(octets < 100 * kib * kib, "10_mib_to_100_mib").otherwise("100_mib_or_more")
    )


def age_bucket(modified: Column) -> Column:
    year = F.year(modified)
    return (
        F.when(year.isNull(), "unknown").when(year <= 1999, "through_1999").when(year <= 2009, "2000_2009").when(year <= 2019, "2010_2019").when(year <= 2024, "2020_2024").otherwise("2025_or_later")
    )


def files(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, modified) of the files under a folder; Spark's file source lists no empty files."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return rows.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def census(found: DataFrame) -> DataFrame:
    """(measure, value, files, bytes): histograms over extension, category, size and age."""
    ext = extension(F.col("path"))
    pairs = F.array(*(F.struct(F.lit(m).alias("measure"), v.alias("value")) for m, v in (("format", ext), ("category", category(ext)), ("size", size_bucket(F.col("size"))), ("age", age_bucket(F.col("modified"))))))
    rows = found.select("size", F.explode(pairs).alias("m"))
    return rows.groupBy("m.measure", "m.value").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def settled(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, size): files that have the same size in two looks at a folder, so that nobody is still writing them. Both: (path, size)."""
    return now.select("path", "size").join(before.select("path", "size").distinct(), ["path", "size"], "left_semi")
