"""Searching for answers: query interpretation and expansion, provisions as evidence, snippets, caps."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkmill.operators.cleaning import sentence_ends
from talkmill.operators.retrieval import CONCEPTS, concepts_of

# Fixed values.
NUMBERS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
ANYWHERE = ("anywhere in the document", "document containing", "documents containing")
MOST_QUERY_CHARS = 4_000


@dataclass(frozen=True)
class Question:
    """What a query asks of provisions."""

    concepts: tuple[str, ...]
    phrase: str | None = None
    sentences: int | None = None
    anywhere: bool = False
    excluded: tuple[str, ...] = ()


def interpreted(query: str, concepts: dict[str, tuple[str, ...]] = CONCEPTS) -> Question:
    """Concepts by their aliases, the first quoted phrase, a limit such as `two sentences`, and whether a document as a whole may match."""
    text = query.strip()
    if not text or len(text) > MOST_QUERY_CHARS:
        raise ValueError(f"a query has 1 to {MOST_QUERY_CHARS} characters")
    low = text.lower()
    quoted = re.search(r'"([^"]*)"', text)
    limit = None
    for before in re.findall(r"([a-z0-9]+)[^a-z0-9]+(?=sentences?(?![a-z0-9]))", low):
        number = int(before) if before.isdecimal() else NUMBERS.index(before) + 1 if before in NUMBERS else None
        limit = number if limit is None else limit
    return Question(
        tuple(c for c, aliases in concepts.items() if any(a in low for a in aliases)), (quoted[1].strip() or None) if quoted else None, limit, any(x in low for x in ANYWHERE)
    )


def current_only(provs: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, withdrawn): provisions of the current revision, and documents whose indexed revision is not current.

    provs: (doc_id, revision, ...); current: (doc_id, revision). Each document counts once, whatever its provisions hold.
    """
    known = current.select("doc_id", "revision").distinct()
    return provs.join(known, ["doc_id", "revision"], "left_semi"), provs.select("doc_id", "revision").distinct().join(known, ["doc_id", "revision"], "left_anti").select("doc_id").distinct()


def evidence(provs: DataFrame, question: Question, limit: int = 20, concepts: dict[str, tuple[str, ...]] = CONCEPTS) -> DataFrame:
    """(doc_id, ordinal, heading, text): the first provisions that hold all concepts, the phrase, none of the excluded and not too many sentences.

    provs: (doc_id, ordinal, heading, text, inferred). Heading and text are searched together, sentences are those of the text; provisions
    with inferred boundaries are no evidence.
    """
    whole = F.concat_ws(" ", "heading", "text")
    held = ~F.col("inferred") & (F.size(F.array_intersect(concepts_of(whole, concepts), F.array(*map(F.lit, question.concepts)).cast("array<string>"))) == len(question.concepts))
    for c in question.excluded:
        held = held & ~F.array_contains(concepts_of(whole, concepts), c)
    if question.phrase:
        held = held & F.lower(whole).contains(question.phrase.lower())
    if question.sentences is not None:
        held = held & (sentence_ends(F.col("text")) <= question.sentences)
    return provs.where(held).orderBy("doc_id", "ordinal").limit(limit).select("doc_id", "ordinal", "heading", "text")


def documents_with(provs: DataFrame, question: Question, most: int = 64, concepts: dict[str, tuple[str, ...]] = CONCEPTS) -> DataFrame:
    """(doc_id, first_ordinal, n, evidence): documents whose provisions together hold all concepts; evidence has the first `most` ordinals."""
    rows = provs.withColumn("own", F.array_intersect(concepts_of(F.concat_ws(" ", "heading", "text"), concepts), F.array(*map(F.lit, question.concepts)).cast("array<string>"))).where(F.size("own") > 0)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("ordinal"))
    groups = rows.withColumn("place", place).groupBy("doc_id").agg(
        F.array_distinct(F.flatten(F.collect_set("own"))).alias("held"), F.min("ordinal").alias("first_ordinal"), F.count("*").alias("n"),
        F.array_sort(F.collect_list(F.when(F.col("place") <= most, F.col("ordinal")))).alias("evidence"),
    )
    return groups.where(F.size("held") == len(question.concepts)).drop("held")


def key_of(phrase: Column) -> Column:
    """Blanks single, in lower case."""
    return F.lower(F.trim(F.regexp_replace(phrase, r"\s+", " ")))


def expansions(vocabulary: DataFrame, query: str, most: int = 8) -> DataFrame:
    """(place, phrase): the query itself, then the other forms of the entries that have it as a form; each once, case and blanks aside.

    vocabulary: (entry, place, form), the forms of an entry in order.
    """
    asked = key_of(F.lit(query))
    hit = vocabulary.where(key_of(F.col("form")) == asked).select("entry").distinct()
    forms = vocabulary.join(hit, "entry", "left_semi").groupBy(key_of(F.col("form")).alias("k")).agg(F.min(F.struct("entry", "place", "form")).alias("o")).where(F.col("k") != asked)
    first = vocabulary.sparkSession.range(1).select(F.struct(F.lit(-1).cast("long").alias("entry"), F.lit(0).cast("long").alias("place"), F.lit(query.strip()).alias("form")).alias("o")).where(F.lit(bool(query.strip())))
    rows = first.unionByName(forms.select(F.struct(F.col("o.entry").cast("long").alias("entry"), F.col("o.place").cast("long").alias("place"), F.col("o.form").alias("form")).alias("o"))).orderBy("o").limit(most)
    return rows.select(F.row_number().over(Window.orderBy("o")).cast("long").alias("place"), F.col("o.form").alias("phrase"))


def decode_phrases(vocabulary: DataFrame, limit: int) -> DataFrame:
    """(place, phrase): forms by priority (the highest first), kind and canonical form, each once, the first `limit`.

    vocabulary: (canonical, kind, priority, place, form).
    """
    own = F.struct((-F.col("priority")).alias("p"), "kind", F.lower("canonical").alias("c"), "place", "form")
    best = vocabulary.groupBy(key_of(F.col("form")).alias("k")).agg(F.min(own).alias("o")).orderBy("o").limit(limit)
    return best.select(F.row_number().over(Window.orderBy("o")).cast("long").alias("place"), F.col("o.form").alias("phrase"))


def line_snippet(text: Column, query: str, size: int = 200) -> Column:
    """The first line that holds the query, case aside, cut to `size` code points and `...`; empty without one."""
    hit = F.filter(F.split(text, "\n"), lambda x: F.lower(x).contains(query.lower()))
    line = F.trim(F.coalesce(F.get(hit, F.lit(0)), F.lit("")))
    return F.when(F.char_length(line) > size, F.concat(F.substring(line, 1, size), F.lit("..."))).otherwise(line)


def token_snippet(text: Column, terms: tuple[str, ...], size: int = 24) -> Column:
    """`size` words around the first that holds a term, a third of them before it, with … where the text goes on; empty without a hit."""
    w = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    hit = lambda x: F.lower(x).rlike("|".join(re.escape(t.lower()) for t in terms))
    at = F.array_position(F.transform(w, hit), True).cast("int")
    first = F.greatest(F.lit(1), F.least(at - size // 3, F.size(w) - size + 1))
    part = F.array_join(F.slice(w, first, F.lit(size)), " ")
    both = F.concat(F.when(first > 1, F.lit("…")).otherwise(""), part, F.when(first + size - 1 < F.size(w), F.lit("…")).otherwise(""))
    return F.when(at > 0, both).otherwise("")


def best_snippet(text: Column, terms: tuple[str, ...], size: int = 24) -> Column:
    """The `size` words of a text that say most of the terms, with … where the text goes on; empty without a hit, null for a null text.

    A window begins at a hit, or at the last beginning of a sentence (the first word, or one after a full stop or colon) before it, if the hit is still inside.
    Each term in it counts 1,000, each repetition 1; a beginning of a sentence 100, that of the text 120. The best window wins, of equals the first.
    One that began at a hit is then moved so that its hits stand in the middle. A hit looks at the words and hits within `size` of it, so the
    work grows with the text's length alone.
    """
    w = F.filter(F.split(text, r"\s+"), lambda x: x != "")

    def snippet(w: Column) -> Column:
        held = lambda x: F.filter(F.array(*(F.when(F.lower(x).contains(t.lower()), F.lit(k)) for k, t in enumerate(terms))), lambda k: k.isNotNull())
        hits = F.filter(F.transform(w, lambda x, i: F.struct(i.alias("i"), held(x).alias("terms"))), lambda h: F.size(h["terms"]) > 0)
        return F.transform(F.array(hits), lambda h: cut(w, h))[0]  # the array of hits is made once

    def scored(hits: Column, j: Column, start: Column, bonus: Column, hit: Column) -> Column:
        near = F.slice(hits, F.greatest(F.lit(1), j + 1 - size), F.lit(2 * size))
        inside = F.filter(near, lambda g: (g["i"] >= start) & (g["i"] < start + size))
        said = F.flatten(F.transform(inside, lambda g: g["terms"]))
        distinct = F.size(F.array_distinct(said))
        score = 1_000 * distinct + F.size(said) - distinct + bonus
        first, last = F.element_at(inside, 1)["i"], F.element_at(inside, -1)["i"]
        return F.struct(score.alias("score"), (-hit).alias("hit"), (-bonus).alias("bonus"), start.alias("start"), first.alias("first"), last.alias("last"))

    def candidates(w: Column, hits: Column, h: Column, j: Column) -> Column:
        before = F.sequence(F.greatest(F.lit(0), h["i"] - size + 1), h["i"])
        begins = F.array_max(F.filter(before, lambda p: (p == 0) | F.get(w, p - 1).rlike("[.:]$")))
        sentence = F.when(begins < h["i"], scored(hits, j, begins, F.when(begins == 0, 120).otherwise(100), h["i"]))
        return F.array_compact(F.array(scored(hits, j, h["i"], F.lit(0), h["i"]), sentence))

    def cut(w: Column, hits: Column) -> Column:
        best = F.array_max(F.transform(hits, lambda h, j: F.array_max(candidates(w, hits, h, j))))
        return F.transform(F.array(best), lambda b: words(w, b))[0]

    def words(w: Column, b: Column) -> Column:
        middle = b["first"] - F.floor((size - (b["last"] - b["first"])) / 2).cast("int")
        start = F.when(b["bonus"] < 0, b["start"]).otherwise(F.greatest(F.lit(0), F.least(middle, F.size(w) - size)))
        part = F.array_join(F.slice(w, start + 1, F.lit(size)), " ")
        both = F.concat(F.when(start > 0, F.lit("…")).otherwise(""), part, F.when(start + size < F.size(w), F.lit("…")).otherwise(""))
        return F.when(b.isNull(), "").otherwise(both)

    return F.when(text.isNotNull(), F.transform(F.array(w), snippet)[0])


def guarded(rows: DataFrame, most: int = 25_000) -> DataFrame:
    """rows, or a ValueError if there are more than `most`; at most one more is counted."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows")
    return rows


def capped(rows: DataFrame, order: list[Column], most_rows: int = 10_000, most_bytes: int = 16 << 20) -> DataFrame:
    """The first rows of an order, as many as both caps allow; the bytes are those of the rows as JSON."""
    first = rows.orderBy(*order).limit(most_rows).withColumn("_bytes", F.octet_length(F.to_json(F.struct(*rows.columns))))
    total = F.sum("_bytes").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))  # over most_rows rows at most
    return first.withColumn("_total", total).where(F.col("_total") <= most_bytes).drop("_bytes", "_total")
