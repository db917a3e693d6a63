"""Transcript cleaning over lines (doc_id, pos, line): each pass returns lines, positions kept in order.

Passes that look at a line and its neighbours are windows; those that depend on the lines before follow a transcript line by line and hold
a few lines back.
"""

from __future__ import annotations

import uuid
from collections import Counter, deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkmill.functions import noise
from talkmill.session import shared_folder
from talkmill.tables import dealt

LINES = "doc_id long, pos double, line string"


def _ordered() -> Window:
    return Window.partitionBy("doc_id").orderBy("pos")


def lines_of(documents: DataFrame, key: str, column: str) -> DataFrame:
    """(doc_id, pos, line) of the lines of a text."""
    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(column), F.lit("")), "\n")).alias("pos", "line"))
    return rows.withColumn("pos", F.col("pos").cast("double"))


def drop_phrases(lines: DataFrame) -> DataFrame:
    """Without lines that are known phrases."""
    return lines.where(~noise.known_phrase(noise.text_part(F.col("line"))))


def drop_foreign_script(lines: DataFrame) -> DataFrame:
    """Without lines of another script than the one that 70 % of a transcript's classified lines have."""
    rows = lines.withColumn("script", noise.script(noise.text_part(F.col("line"))))
    all_ = Window.partitionBy("doc_id")
    n = F.count("script").over(all_)
    leading = F.lit(None).cast("string")
    for s in ("other", "cjk", "latin"):
        leading = F.when(F.count_if(F.col("script") == s).over(all_) >= 0.7 * n, s).otherwise(leading)
    rows = rows.withColumn("leading", F.when(n >= 2, leading))
    return rows.where(F.col("script").isNull() | F.col("leading").isNull() | (F.col("script") == F.col("leading"))).select(lines.columns)


def drop_commands(lines: DataFrame, most: int = 2) -> DataFrame:
    """Without commands at the end of a transcript, two lines at most."""
    back = Window.partitionBy("doc_id").orderBy(F.desc("pos"))
    rows = lines.withColumns({"back": F.row_number().over(back), "is_command": noise.command(noise.text_part(F.col("line")))})
    all_so_far = F.bool_and("is_command").over(back.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("tail", all_so_far & (F.col("back") <= most)).where("not tail").select(lines.columns)


def trim_end(lines: DataFrame) -> DataFrame:
    """Noise at the end goes, and before it a run of five fillers or more; one line says how many went."""
    back = Window.partitionBy("doc_id").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    text = noise.text_part(F.col("line"))
    rows = lines.withColumn("noise", noise.always_noise(text)).withColumn("in_noise", F.bool_and("noise").over(back))
    rows = rows.withColumn("ok", F.col("in_noise") | F.lower(F.trim(text)).isin(*noise.CLOSING_FILLERS)).withColumn("in_filler", F.bool_and("ok").over(back) & ~F.col("in_noise"))
    many = F.count_if("in_filler").over(Window.partitionBy("doc_id")) >= 5
    rows = rows.withColumn("gone", F.col("in_noise") | (F.col("in_filler") & many)).withColumn("n_gone", F.count_if("gone").over(Window.partitionBy("doc_id")))
    first = F.col("gone") & ~F.coalesce(F.lead("gone").over(Window.partitionBy("doc_id").orderBy(F.desc("pos"))), F.lit(False))
    note = F.concat(F.lit("[Recording ended - "), "n_gone", F.lit(" lines of trailing noise removed]"))
    rows = rows.withColumn("first", first).where("first or not gone")  # the first line that goes becomes the note, so that lines are read once
    return rows.withColumn("line", F.when(F.col("first"), note).otherwise(F.col("line"))).select(lines.columns)


def collapse_noise(lines: DataFrame) -> DataFrame:
    """Runs of three markers or more keep the first and a note; where eight markers or more are two thirds of the rest, all go."""
    rows = lines.withColumn("marker", noise.noise_marker(noise.text_part(F.col("line"))))
    rows = rows.withColumn("run", F.count_if(~F.col("marker")).over(_ordered()))
    run = Window.partitionBy("doc_id", "run", "marker")
    rows = rows.withColumns({"n": F.count("*").over(run), "at": F.row_number().over(run.orderBy("pos"))})
    long = F.col("marker") & (F.col("n") >= 3)
    note = F.concat(F.lit("[...] [non-speech audio removed - "), F.col("n") - 1, F.lit(" markers collapsed]"))
    rows = rows.where(~long | (F.col("at") <= 2)).withColumn("noted", long & (F.col("at") == 2))
    rows = rows.select("doc_id", "pos", F.when(F.col("noted"), note).otherwise(F.col("line")).alias("line"), (F.col("marker") & ~F.col("noted")).alias("marker"))
    all_ = Window.partitionBy("doc_id")
    rows = rows.withColumns({"markers": F.count_if("marker").over(all_), "size": F.count("*").over(all_), "last": F.max(F.when(F.col("marker"), F.col("pos"))).over(all_)})
    dense = (F.col("markers") >= 8) & (F.col("markers") < F.col("size")) & (F.col("markers") / F.col("size") >= 0.66)
    rows = rows.withColumn("gone", dense & F.col("marker")).where("not gone or pos = last")
    summary = F.concat(F.lit("["), "markers", F.lit(" scattered non-speech markers removed]"))
    return rows.select("doc_id", F.when(F.col("gone"), F.col("pos") + 1e9).otherwise(F.col("pos")).alias("pos"), F.when(F.col("gone"), summary).otherwise(F.col("line")).alias("line"))


def likeness(first: str, other: str) -> float:
    """1 for equal texts, the share of bytes if one holds the other, else that of common words in the longer; case aside, 0 for an empty one."""
    one, two = first.lower(), other.lower()
    if one == two or not one or not two:
        return float(bool(one) and one == two)
    if one in two or two in one:
        n = [len(t.encode()) for t in (one, two)]
        return min(n) / max(n)
    left, right = one.split(), set(two.split())
    longest = max(len(left), len(two.split()), 1)
    return len([w for w in left if w in right]) / longest


Line = tuple[float, str]


class Runs:
    """Follows the lines of a transcript and lets through what is left when runs are collapsed.

    A run is a line and those after it that are alike to it. One of `least` lines or more is let through as its first line and
    a note. Of a shorter one only the first line is decided; the next line may begin a run of its own. Two lines at most are held back.
    """

    def __init__(self, similarity: float, least: int = 3):
        self.similarity, self.least, self.held, self.size = similarity, least, [], 0

    def feed(self, line: Line) -> list[Line]:
        if self.held and self._goes_on(line[1]):
            self.size += 1
            if len(self.held) < 2:
                self.held.append(line)
            return []
        out = []
        while self.held and not self._goes_on(line[1]):
            out += self._first()
        return out + self.feed(line) if self.held else out + self._begin(line)

    def end(self) -> list[Line]:
        out = []
        while self.held:
            out += self._first()
        return out

    def _begin(self, line: Line) -> list[Line]:
        self.held, self.size = [line], 1
        return []

    def _goes_on(self, line: str) -> bool:
        first = part_of(self.held[0][1])
        return first.strip().lower() not in noise.ALWAYS_NOISE and likeness(first, part_of(line)) >= self.similarity

    def _first(self) -> list[Line]:
        """Decides the first line held, and with it a whole run if it is long enough."""
        first, *rest = self.held
        if self.size >= self.least:
            note = f"[...] [repeated audio removed - {self.size - 1} identical segments collapsed]"
            self.held, self.size = [], 0
            return [first, (rest[0][0], note)]
        self.held, self.size = rest, len(rest)
        return [first]


class Loops:
    """Follows the lines of a transcript and lets through what is left when loops are removed.

    A loop begins where a text, fillers aside, stands `hits` times in `window` lines, and goes on over fillers and over gaps of `gap` other
    lines at most. Its first line is let through, notes stand for the rest. The last `window` lines at most are held back.
    """

    def __init__(self, window: int = 10, hits: int = 5, gap: int = 2):
        self.window, self.hits, self.gap = window, hits, gap
        self.ahead: deque[tuple[float, str, str]] = deque()
        self.loop, self.gone, self.open = None, [], []

    def feed(self, line: Line) -> list[Line]:
        at = (*line, plain_text(part_of(line[1])))
        return self._inside(at) if self.loop is not None else self._outside(at)

    def end(self) -> list[Line]:
        out = self._leave() if self.loop is not None else []
        out += [(p, x) for p, x, _ in self.ahead]
        self.ahead.clear()
        return out

    def _outside(self, at: tuple[float, str, str]) -> list[Line]:
        self.ahead.append(at)
        if len(self.ahead) < self.window:
            return []
        counts = Counter(t for _, _, t in self.ahead if t and t not in noise.FILLERS)
        often = max(counts.items(), key=lambda c: (c[1], c[0]), default=("", 0))
        if often[1] < self.hits:
            p, x, _ = self.ahead.popleft()
            return [(p, x)]
        held, self.loop = list(self.ahead), often[0]
        self.ahead.clear()
        first = next(i for i, (_, _, t) in enumerate(held) if t == self.loop)
        self.gone = held[:first]
        out = [*self._note(), held[first][:2]]
        self.gone = held[first + 1 :]
        return out

    def _inside(self, at: tuple[float, str, str]) -> list[Line]:
        self.open.append(at)
        if at[2] == self.loop or (len(self.open) == 1 and at[2] in noise.FILLERS):
            self.gone += self.open
            self.open = []
        elif len(self.open) > self.gap:
            return self._leave()
        return []

    def _leave(self) -> list[Line]:
        out, rest = self._note(), self.open
        self.loop, self.open = None, []
        for at in rest:
            out += self._outside(at)
        return out

    def _note(self) -> list[Line]:
        n = len(self.gone)
        out = [(self.gone[0][0], f"[...] [hallucinated repetition removed - {n} lines collapsed]")] if n else []
        self.gone = []
        return out


def part_of(line: str) -> str:
    """What follows the first `] ` of a line; the line, if there is none."""
    at = line.find("] ")
    return line[at + 2 :] if at >= 0 else line


def plain_text(text: str) -> str:
    return " ".join("".join(c for c in text.lower() if c.isalnum() or c.isspace()).split())


def followed(lines: DataFrame, *passes: Callable[[], Runs | Loops], parts: int | None = None) -> DataFrame:
    """Each transcript's lines, in order, through the passes one after another.

    One exchange; the lines stream through a task in Arrow batches, and only what the passes hold back is kept.
    """

    def through(passing: list, given: list[Line], last: bool) -> list[Line]:
        for p in passing:
            given = [x for line in given for x in p.feed(line)] + (p.end() if last else [])
        return given

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, passing = None, []
        for b in batches:
            out: list[tuple[int, float, str]] = []
            for doc, pos, line in zip(b["doc_id"].tolist(), b["pos"].tolist(), b["line"].tolist()):
                if doc != now:
                    out += [(now, *x) for x in through(passing, [], True)]
                    now, passing = doc, [p() for p in passes]
                out += [(doc, *x) for x in through(passing, [(pos, line)], False)]
            yield pd.DataFrame(out, columns=["doc_id", "pos", "line"])
        yield pd.DataFrame([(now, *x) for x in through(passing, [], True)], columns=["doc_id", "pos", "line"])

    rows = lines.where("doc_id is not null and line is not null")
    rows = (rows.repartition("doc_id") if parts is None else dealt(rows, parts, "doc_id")).sortWithinPartitions("doc_id", "pos")
    return rows.mapInPandas(each, LINES)


def collapse_runs(lines: DataFrame, similarity: float = 0.8, parts: int | None = None) -> DataFrame:
    """Runs of three lines or more that are alike to their first keep it and a note; lines that are noise stay for other passes."""
    return followed(lines, lambda: Runs(similarity), parts=parts)


def collapse_loops(lines: DataFrame, window: int = 10, hits: int = 5, parts: int | None = None) -> DataFrame:
    """A text that stands `hits` times in ten lines or more is a loop; the loop keeps its first occurrence, notes stand for the rest.

    A loop goes on over fillers and over gaps of two other lines at most.
    """
    return followed(lines, lambda: Loops(window, hits), parts=parts)


#: The passes in their order, with the names of their counts.
PASSES = (
    ("phrases", drop_phrases), ("runs", collapse_runs), ("loops", collapse_loops), ("script", drop_foreign_script),
    ("commands", drop_commands), ("end", trim_end), ("markers", collapse_noise),
)


def clean(lines: DataFrame) -> DataFrame:
    for _, step in PASSES:
        lines = step(lines)
    return lines


def clean_stats(lines: DataFrame, parts: int | None = None) -> DataFrame:
    """(step, place, lines): how many lines each pass leaves. Each pass runs once; its lines are written as Parquet, whose footers have the count, and read by the next.

    parts: in how many parts the lines of documents are dealt for a pass, where the session's shuffle partitions are too few.
    """
    spark = lines.sparkSession
    folder = f"{shared_folder(spark)}/cleaning-{uuid.uuid4().hex}"

    def kept(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{folder}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    counts = [("input", 0, (lines := kept(lines, "input")).count())]
    for i, (name, step) in enumerate(PASSES):
        if step in (collapse_runs, collapse_loops):
            lines = kept(step(lines, parts=parts), name)
        else:
            lines = kept(step(lines if step is drop_phrases else dealt(lines, parts, "doc_id")), name)
        counts.append((name, i + 1, lines.count()))
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return spark.createDataFrame(counts, "step string, place int, lines long")


def all_noise(lines: DataFrame) -> DataFrame:
    """(doc_id, all_noise): whether all lines with text are markers, and there are some."""
    text = F.trim(noise.text_part(F.col("line")))
    rows = lines.withColumn("text", text)
    return rows.groupBy("doc_id").agg(((F.count_if(F.col("text") != "") > 0) & (F.count_if((F.col("text") != "") & ~noise.noise_marker(F.col("text"))) == 0)).alias("all_noise"))


def transcript_text(lines: DataFrame, between: str = "\n") -> DataFrame:
    """(doc_id, text): the lines of a transcript joined in order."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), between)
    return lines.groupBy("doc_id").agg(joined.alias("text"))


def word_error_rate(pairs: DataFrame, said: str, heard: str) -> DataFrame:
    """pairs with `wer`: token edits over the words said; 0 or 1 without any."""

    def rate(a: str | None, b: str | None) -> float:
        said_, heard_ = (a or "").split(), (b or "").split()
        if not said_:
            return float(bool(heard_))
        names = {w: i for i, w in enumerate(dict.fromkeys(said_ + heard_))}
        y, step = np.array([names[w] for w in heard_], np.int64), np.arange(len(heard_) + 1)
        row = step.copy()  # one row of the table of edits at a time
        for w in said_:
            change = np.minimum(row[1:] + 1, row[:-1] + (y != names[w]))
            row = np.minimum.accumulate(np.concatenate(([row[0] + 1], change)) - step) + step
        return int(row[-1]) / len(said_)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(wer=[rate(x, y) for x, y in zip(b[said], b[heard])])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema) + ", wer double"
    return pairs.mapInPandas(each, schema)


def sentence_ends(text: Column) -> Column:
    """How many sentences a text has: marks that end one, abbreviations, initials and decimals aside; a rest counts as one."""
    t = F.regexp_replace(text, r"\.{2,}", ".")
    t = F.regexp_replace(t, r"(?i)(?<![\p{L}\p{N}.])(inc|corp|ltd|co|llc|llp|no|nos|art|sec|ex|mr|mrs|ms|dr|jr|sr|st|vs|etc|cf|al|u\.s|u\.k|e\.g|i\.e|a\.m|p\.m)\.", "$1")
    t = F.regexp_replace(t, r"(?<![^\s])(\p{L})\.(?=\S)", "$1")
    parts = F.split(t, r"[!?。！？]|\.(?=\s|\p{Lu}|[\"')\]”’]|$)")
    return F.greatest(F.size(F.filter(parts, lambda p: p.rlike(r"\S"))), F.lit(1))
