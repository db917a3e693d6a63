"""Meetings in Markdown files with YAML frontmatter: walk, split, repair, parse."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TypeVar

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")
MEETING = (
    "title string, type string, date string, duration string, attendees array<string>, people array<string>, tags array<string>, "
    "decisions array<struct<text:string,topic:string,authority:string,supersedes:string>>, "
    "action_items array<struct<assignee:string,task:string,due:string,status:string>>, "
    "intents array<struct<kind:string,what:string,who:string,status:string,by_date:string>>, "
    "speaker_map array<struct<speaker_label:string,name:string,confidence:string,source:string>>, sensitivity string, recorded_by string"
)


def read_corpus(spark: SparkSession, root: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """(path, content) of the *.md files under a folder, without those in excluded folders and temporary ones."""
    files = spark.read.text(root, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True)
    rows = files.select(F.input_file_name().alias("path"), F.col("value").alias("content"))
    rows = rows.where(~F.substring_index("path", "/", -1).rlike(r"^\.|\.tmp\.md$|~"))
    for folder in excluded:
        rows = rows.where(~F.col("path").contains(f"/{folder}/"))
    return rows


def frontmatter(content: Column) -> Column:
    """What stands between a first line `---` and the next one; empty without both."""
    return F.regexp_extract(F.regexp_replace(content, "\r\n", "\n"), r"(?s)^---[ \t]*\n(.*?)\n---[ \t]*(?:\n|$)", 1)


def body(content: Column) -> Column:
    """What follows the frontmatter; the content, if it has none."""
    return F.regexp_replace(F.regexp_replace(content, "\r\n", "\n"), r"(?s)^---[ \t]*\n.*?\n---[ \t]*(?:\n|$)", "")


def scalar(front: Column, key: str) -> Column:
    """The value of a plain `key: value` line without quotes; null without one."""
    value = F.regexp_extract(front, rf"(?m)^{key}:[ \t]*(.*?)[ \t]*$", 1)
    return F.nullif(F.regexp_replace(value, "^[\"']|[\"']$", ""), F.lit(""))


def repaired(front: Column, offset: str = "+00:00") -> Column:
    """Frontmatter with an offset on bare times, plain names for wiki links of people, and quotes around due phrases."""
    out = F.regexp_replace(front, r"(?m)^(\s*date:\s*)([0-9-]{8,10}T[0-9:.]+)[ \t]*$", f"$1$2{offset}")
    people = F.regexp_extract(out, r"(?m)^people:(.*)$", 1)
    plain = F.concat(F.lit("people: ["), F.array_join(F.filter(F.transform(F.split(F.regexp_replace(people, r"[\[\]]", ""), ","), lambda p: F.trim(p)), lambda p: p != ""), ", "), F.lit("]"))
    out = F.when(people.contains("["), F.concat(F.regexp_extract(out, r"(?s)^(.*?)(?m:^)people:", 1), plain, F.regexp_extract(out, r"(?s)(?m:^)people:[^\n]*(.*)$", 1))).otherwise(out)
    return F.regexp_replace(out, r"(?m)^(\s*)due:[ \t]*([^\s\"0-9][^\"\n]*?)[ \t]*$", '$1due: "$2"')


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import yaml

    names = [f.split(" ", 1)[0] for f in ("title type date duration attendees people tags decisions action_items intents speaker_map sensitivity recorded_by").split()]
    fields = {
        "decisions": ("text", "topic", "authority", "supersedes"), "action_items": ("assignee", "task", "due", "status"),
        "intents": ("kind", "what", "who", "status", "by_date"), "speaker_map": ("speaker_label", "name", "confidence", "source"),
    }
    text = lambda v: None if v is None else str(v)

    def record(front: str | None) -> dict | None:
        try:
            data = yaml.load(front or "", yaml.BaseLoader)
        except yaml.YAMLError:
            return None
        if not isinstance(data, dict):
            return None
        out = {}
        for n in names:
            v = data.get(n)
            if n in fields:
                out[n] = [{f: text(x.get(f)) for f in fields[n]} for x in v if isinstance(x, dict)] if isinstance(v, list) else []
            elif n in ("attendees", "people", "tags"):
                out[n] = [text(x) for x in v] if isinstance(v, list) else []
            else:
                out[n] = None if isinstance(v, list | dict) else text(v)
        return out

    for b in batches:
        rows = [(p, c, r or record(f)) for p, c, r, f in zip(b["path"], b["body"], map(record, b["front"]), b["fixed"])]
        rows = [{"path": p, "body": c, **r} for p, c, r in rows if r]
        yield pd.DataFrame(rows, columns=["path", "body", *names])


def parse(corpus: DataFrame) -> DataFrame:
    """(path, body, fields of MEETING) of the files that parse, as they are or repaired; others are left out.

    YAML needs Python and the yaml package; all other steps are column functions.
    """
    front = frontmatter(F.col("content"))
    rows = corpus.select("path", body(F.col("content")).alias("body"), front.alias("front"), repaired(front).alias("fixed")).where("front <> ''")
    return rows.mapInPandas(_records, f"path string, body string, {MEETING}")


def resolve_slug(corpus: DataFrame, slug: str) -> DataFrame:
    """The first path whose file name begins with the slug."""
    return corpus.where(F.substring_index("path", "/", -1).startswith(slug)).orderBy("path").limit(1)


def revision(corpus: DataFrame) -> tuple[int, int]:
    """How many files a corpus (path, content) has, and a hash of their paths and contents that does not depend on their order."""
    h = F.conv(F.substring(F.sha2(F.concat_ws("|", "path", F.sha2("content", 256)), 256), 1, 8), 16, 10).cast("long")
    return tuple(corpus.agg(F.count("*"), F.coalesce(F.sum(h), F.lit(0))).first())


def stable_read(spark: SparkSession, root: str, work: Callable[[DataFrame], T], attempts: int = 2) -> T:
    """work(corpus), if the corpus is the same before and after it; a RuntimeError if it changes each time."""
    for _ in range(attempts):
        before = revision(read_corpus(spark, root))
        found = work(read_corpus(spark, root))
        if revision(read_corpus(spark, root)) == before:
            return found
    raise RuntimeError("the corpus changes while it is read")
