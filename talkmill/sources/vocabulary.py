"""Vocabularies as TOML files and converted documents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.sources.census import extension

FORMS = "path string, entry long, canonical string, kind string, priority long, place int, form string"
TEXT_FORMATS = ("txt", "text", "md", "csv", "log")
MARKUP_FORMATS = ("htm", "html", "xml")


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(path, entry, canonical, kind, priority, place, form): the forms of each `[[entries]]`, the canonical one first, then its aliases.

    Entries without a canonical form, empty aliases and files that are no TOML are left out.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tomllib

        for b in batches:
            out = []
            for name, text in zip(b["path"], b["value"]):
                try:
                    entries = tomllib.loads(text or "").get("entries", [])
                except tomllib.TOMLDecodeError:
                    continue
                for n, e in enumerate(e for e in entries if isinstance(e, dict) and str(e.get("canonical", "")).strip()):
                    forms = dict.fromkeys(str(f).strip() for f in [e["canonical"], *e.get("aliases", [])] if str(f).strip())
                    out += [(name, n, str(e["canonical"]).strip(), str(e.get("kind", "term")), int(e.get("priority", 0)), i, f) for i, f in enumerate(forms)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FORMS.split(", ")])

    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.toml", recursiveFileLookup=True)
    return files.select(F.input_file_name().alias("path"), "value").mapInPandas(each, FORMS)


def converted(spark: SparkSession, root: str) -> DataFrame:
    """(path, format, text): text and markup files as text, tags and entities gone; of other formats the text is null."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    kind = extension(F.col("path"))
    text = F.decode("content", "UTF-8")
    bare = F.regexp_replace(F.regexp_replace(text, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for entity, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(mark))
    bare = F.trim(F.regexp_replace(bare, r"[ \t]+", " "))
    return files.select("path", kind.alias("format"), F.when(kind.isin(*TEXT_FORMATS), text).when(kind.isin(*MARKUP_FORMATS), bare).alias("text"))
