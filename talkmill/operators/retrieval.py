"""Full-text retrieval: postings, BM25, prefix queries, provisions and concepts."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkmill.functions.stems import stem, stems
from talkmill.functions.text import footer_shape
from talkmill.session import checkpointed

# Fixed values.
CONCEPTS: dict[str, tuple[str, ...]] = {
    "confidentiality": ("confidentiality", "confidential information", "non-disclosure", "nondisclosure"),
    "affiliates": ("affiliate", "affiliates", "affiliated entity"),
    "compelled_disclosure": ("compelled disclosure", "required by law", "legal process", "subpoena", "court order"),
    "survival": ("survive", "survival", "termination or expiration", "expiration or termination"),
    "indemnity": ("indemnity", "indemnify", "indemnification", "hold harmless"),
    "defense_control": ("control of the defense", "control the defense", "assume the defense"),
    "limitation_of_liability": ("limitation of liability", "limited liability", "aggregate liability"),
    "assignment": ("assignment", "assign this agreement", "may not assign"),
    "change_of_control": ("change of control", "merger or acquisition"),
    "governing_law": ("governing law", "governed by the laws"),
    "business_associate": ("business associate", "business associate agreement", "baa"),
}
K1, B = 1.2, 0.75


def terms_of(text: Column) -> Column:
    """Runs of letters and digits of two or more, folded to lower case without accents."""
    return F.filter(F.split(F.translate(F.lower(text), "áàâäãåéèêëíìîïóòôöõúùûüçñ", "aaaaaaeeeeiiiiooooouuuucn"), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) >= 2)


def query_terms(query: str) -> tuple[list[str], str | None]:
    """(whole terms, prefix of the last): runs of two or more letters and digits; no terms for an empty query."""
    runs = [t for t in re.findall(r"[^\W_]+", query.lower()) if len(t) >= 2]
    return runs[:-1], runs[-1] if runs else None


def postings(documents: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, term, tf, size): how often each term stands in each document of `size` terms."""
    rows = documents.select(F.col(key), terms_of(F.col(column)).alias("terms"))
    rows = rows.select(key, F.size("terms").alias("size"), F.explode("terms").alias("term"))
    return rows.groupBy(key, "term", "size").agg(F.count("*").alias("tf"))


def matching(documents: DataFrame, query: str, key: str = "doc_id", column: str = "text") -> DataFrame:
    """Documents with all whole terms of the query and a term that begins as its last one."""
    whole, prefix = query_terms(query)
    if prefix is None:
        return documents.limit(0)
    terms = terms_of(F.col(column))
    held = F.exists(terms, lambda t: t.startswith(prefix))
    for term in whole:
        held = held & F.array_contains(terms, term)
    return documents.where(held)


def matching_stems(documents: DataFrame, query: str, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key): documents with a term of the stem of each whole term of the query, and one whose stem begins as the last one's.

    Stems are taken of the distinct terms alone. The terms that count for some part of the query are then looked up in the documents.
    """
    whole, prefix = query_terms(query)
    if prefix is None:
        return documents.select(key).limit(0)
    asked = sorted({stem(t) for t in whole})
    terms = documents.select(key, F.explode(F.array_distinct(terms_of(F.col(column)))).alias("term"))
    known = checkpointed(terms)
    rows = known.select("term").distinct().withColumn("stem", stems(F.col("term")))
    parts = F.array_compact(F.array(*(F.when(F.col("stem") == s, F.lit(s)) for s in asked), F.when(F.col("stem").startswith(stem(prefix)), F.lit(f"{stem(prefix)}*"))))
    rows = rows.select("term", F.explode(parts).alias("part"))
    return known.join(rows, "term").groupBy(key).agg(F.count_distinct("part").alias("n")).where(F.col("n") == len(asked) + 1).select(key)


def bm25(documents: DataFrame, query: list[str], key: str = "doc_id", column: str = "text", k: int = 25) -> DataFrame:
    """(key, score, matched): the k best documents for the query's terms by Robertson's BM25 (k1 1.2, b 0.75), ties to the smaller key.

    Only the postings of the query's terms are built; texts are read once.
    """
    terms = terms_of(F.col(column))
    rows = documents.select(F.col(key), F.size(terms).alias("size"), F.filter(terms, lambda t: t.isin(*query)).alias("hits"))
    rows = checkpointed(rows)  # keys, sizes and hits alone; texts are read once
    counts = rows.agg(F.count("*").alias("docs"), F.avg("size").alias("mean"))
    own = rows.select(key, "size", F.explode("hits").alias("term")).groupBy(key, "term", "size").agg(F.count("*").alias("tf"))
    held = own.groupBy("term").agg(F.count("*").alias("df"))
    rows = own.join(F.broadcast(held), "term").join(F.broadcast(counts))  # as many rows as the query has terms, and one
    idf = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    scored = rows.groupBy(key).agg(F.round(F.sum(idf * weight), 6).alias("score"), F.count("*").alias("matched"))
    return scored.orderBy(F.desc("score"), key).limit(k)


def heading(line: Column) -> Column:
    """Whether a line reads as a heading: a known opening, a number, capitals, or a short run-in caption."""
    n = F.size(F.filter(F.split(line, r"\s+"), lambda w: w != ""))
    bare = F.regexp_replace(line, r"[^\p{L}]", "")
    capitals = F.regexp_replace(bare, r"[^\p{Lu}]", "")
    known = F.lower(line).rlike("^(section|article|schedule|exhibit) ") & (n <= 12)
    numbered = line.rlike(r"^[0-9.]{0,12}[.)]\s*\S") & (n <= 12)
    upper = (F.length(bare) >= 4) & (bare == capitals) & (n <= 12)
    run_in = line.endswith(".") & (F.length(bare) >= 4) & n.between(1, 6) & F.forall(F.split(line, r"\s+"), lambda w: w.rlike(r"^[^\p{L}]*\p{Lu}"))
    too_long = (F.octet_length(line) > 180) | (line.endswith(".") & (n > 12))
    return ~too_long & (known | numbered | upper | run_in)


def provisions(documents: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, ordinal, heading, text): a document's provisions; a heading line opens one, a blank line ends one without heading."""
    lines = documents.select(key, F.posexplode(F.split(F.coalesce(F.col(column), F.lit("")), "\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    order = Window.partitionBy(key).orderBy("pos")
    lines = lines.withColumn("is_heading", (F.col("line") != "") & heading(F.col("line")))
    part = F.sum(F.col("is_heading").cast("int")).over(order)
    lines = lines.withColumn("part", F.coalesce(part, F.lit(0)))
    blank = F.sum(F.when((F.col("line") == "") & (F.col("part") == 0), 1).otherwise(0)).over(order)
    lines = lines.withColumn("block", F.coalesce(blank, F.lit(0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_heading") & (F.col("line") != ""), F.struct("pos", "line")))), lambda x: x["line"]), " ")
    groups = lines.groupBy(key, "part", "block").agg(F.max(F.when(F.col("is_heading"), F.col("line"))).alias("heading"), text.alias("text"), F.min("pos").alias("pos"))
    groups = groups.where((F.col("text") != "") | F.col("heading").isNotNull())
    orphan = F.col("text") == ""
    groups = groups.withColumns({"text": F.when(orphan, F.col("heading")).otherwise(F.col("text")), "heading": F.when(~orphan, F.col("heading"))})
    return groups.withColumn("ordinal", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).select(key, "ordinal", "heading", "text")


def concepts_of(text: Column, concepts: dict[str, tuple[str, ...]] = CONCEPTS) -> Column:
    """The concepts of which the text holds an alias, in order."""
    low = F.lower(text)
    found = [F.when(F.greatest(*(low.contains(a) for a in aliases), F.lit(False)), F.lit(name)) for name, aliases in concepts.items()]
    return F.array_compact(F.array(*found))


def same_provision(provs: DataFrame, include: list[str], exclude: list[str], concepts: dict[str, tuple[str, ...]] = CONCEPTS) -> DataFrame:
    """Provisions that hold all concepts to include and none to exclude."""
    rows = provs.withColumn("concepts", concepts_of(F.concat_ws(" ", "heading", "text"), concepts))
    held = F.size(F.array_intersect("concepts", F.array(*map(F.lit, include)))) == len(include)
    return rows.where(held & (F.size(F.array_intersect("concepts", F.array(*map(F.lit, exclude)).cast("array<string>"))) == 0))


def in_document(provs: DataFrame, include: list[str], key: str = "doc_id", concepts: dict[str, tuple[str, ...]] = CONCEPTS) -> DataFrame:
    """(key, first_ordinal, n): documents whose provisions together hold all concepts."""
    rows = provs.withColumn("concept", F.explode(concepts_of(F.concat_ws(" ", "heading", "text"), concepts))).where(F.col("concept").isin(*include))
    return rows.groupBy(key).agg(F.count_distinct("concept").alias("held"), F.min("ordinal").alias("first_ordinal"), F.count("*").alias("n")).where(F.col("held") == len(include)).drop("held")


def running_boilerplate(pages: DataFrame, key: str, page: str, column: str) -> DataFrame:
    """(key, shape, pages): shapes of the first and last three lines of a page that more than one page shows."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(column), F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = pages.select(key, page, lines.alias("lines"))
    edges = F.concat(F.slice("lines", 1, 3), F.slice(F.reverse("lines"), 1, 3))
    shapes = rows.select(key, page, F.explode(F.array_distinct(F.transform(edges, footer_shape))).alias("shape")).where("shape <> ''")
    return shapes.groupBy(key, "shape").agg(F.count_distinct(page).alias("pages")).where("pages > 1")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """A vector of length one; null for a null or zero vector or one with odd components."""
    size = F.sqrt(dot(v, v))
    return F.when((size > 0) & (size < F.lit(math.inf)), F.transform(v, lambda x: x.cast("double") / size))


def cosine_top_k(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, similarity): the k vectors nearest to the query by cosine, ties to the smaller key."""
    q = F.array(*(F.lit(float(x)) for x in query))
    rows = vectors.where(F.size(column) == len(query)).select(key, F.round(dot(unit(F.col(column)), unit(q)), 6).alias("similarity"))
    return rows.where("similarity is not null").orderBy(F.desc("similarity"), key).limit(k)


def profiles(vectors: DataFrame, who: str, column: str = "embedding", least: float = 0.5) -> DataFrame:
    """(who, dim, n, mean): each person's mean vector over samples of the modal dimension, those far from a first mean left out."""
    rows = vectors.select(F.col(who), "vec_id", unit(F.col(column)).alias("v"), F.size(column).alias("dim")).where("v is not null")
    sizes = rows.groupBy(who, "dim").agg(F.count("*").alias("c"), F.min("vec_id").alias("first"))
    modal = sizes.groupBy(who).agg(F.max(F.struct("c", (-F.col("first")).alias("first"), (-F.col("dim")).alias("dim"))).alias("m")).select(who, (-F.col("m.dim")).alias("dim"))
    rows = rows.join(modal, [who, "dim"])

    width = rows.agg(F.max("dim")).first()[0] or 0

    def means(samples: DataFrame) -> DataFrame:
        """One aggregate: the mean of each place of the vectors."""
        places = [F.avg(F.get("v", F.lit(i))) for i in range(width)]
        found = samples.groupBy(who, "dim").agg(F.array(*places).alias("all"), F.count("*").alias("n"))
        return found.select(who, "dim", F.slice("all", F.lit(1), F.col("dim")).alias("mean"), "n")

    first = means(rows).withColumnRenamed("mean", "centre").drop("n")
    near = rows.join(first, [who, "dim"]).withColumn("s", dot(F.col("v"), unit(F.col("centre"))))
    best = near.groupBy(who).agg(F.max("s").alias("best"))
    kept = near.join(best, who).where((F.col("s") >= least) | ((F.col("best") < least) & (F.col("s") == F.col("best"))))
    return means(kept)


def best_profile(vectors: DataFrame, people: DataFrame, who: str, least: float, margin: float, block: int = 4096) -> DataFrame:
    """(vec_id, who, similarity, margin): the nearest profile, if similar enough and ahead of the next by the margin; else null.

    people has one row a person (who, mean). They come in blocks of about `block`, each broadcast as a matrix; a task keeps the best two of a
    block for each of its vectors, and the blocks' best are compared at the end. Ties go to the smaller person.
    """
    units = people.select(F.col(who).alias("who"), unit(F.col("mean")).alias("p")).where("p is not null")
    asked = vectors.select("vec_id", unit(F.col("embedding")).alias("v")).where("v is not null")
    schema = "vec_id long, who long, similarity double"
    parts, count = None, max(1, -(-units.count() // block))
    for i in range(count):
        own = units.where(F.pmod(F.xxhash64("who"), F.lit(count)) == i).orderBy("who").toPandas()  # about `block` rows
        shared = vectors.sparkSession.sparkContext.broadcast((own["who"].to_numpy(), [np.asarray(p) for p in own["p"]]))

        def each(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, rows = shared.value
            dims = np.array([len(r) for r in rows])
            stacked = {d: (at := np.nonzero(dims == d)[0], np.array([rows[k] for k in at])) for d in set(dims.tolist())}
            for b in batches:
                out = []
                for vec, v in zip(b["vec_id"], b["v"]):
                    if len(v) not in stacked:
                        continue
                    at, matrix = stacked[len(v)]
                    near = np.round(matrix @ v, 6)
                    first = np.nonzero(near >= np.partition(near, -2)[-2])[0] if len(near) > 2 else np.arange(len(near))  # the best two and their ties
                    out += [(vec, ids[at[k]], near[k]) for k in first[np.lexsort((first, -near[first]))][:2]]
                yield pd.DataFrame(out, columns=["vec_id", "who", "similarity"])

        found = asked.mapInPandas(each, schema)
        parts = found if parts is None else parts.unionByName(found)
    best = parts.groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "who"))).alias("b"))  # two rows of each block
    similarity, second = -F.get("b", F.lit(0))["s"], -F.get("b", F.lit(1))["s"]
    rows = best.select("vec_id", F.get("b", F.lit(0))["who"].alias(who), similarity.alias("similarity"), F.round(similarity - F.coalesce(second, F.lit(-1.0)), 6).alias("margin"))
    return rows.withColumn(who, F.when((F.col("similarity") >= least) & (F.col("margin") >= margin), F.col(who)))


def blended(profiles_: DataFrame, samples: DataFrame, who: str) -> DataFrame:
    """(who, mean, n): profiles (who, mean, n) with new samples (who, embedding) in their running means: (old * n + sum of new) / (n + new ones).

    Samples of another length than the profile's are left out; people without a profile get one of their samples of the least length.
    """
    fresh = samples.where(F.col("embedding").isNotNull()).select(who, F.transform("embedding", lambda x: x.cast("double")).alias("v"), F.size("embedding").alias("dim"))
    wanted = fresh.groupBy(who).agg(F.min("dim").alias("least")).join(profiles_.select(who, F.size("mean").alias("own")), who, "left").select(who, F.coalesce("own", "least").alias("dim"))
    fresh = fresh.join(wanted, [who, "dim"])
    width = fresh.agg(F.max("dim")).first()[0] or 0
    sums = fresh.groupBy(who, "dim").agg(F.array(*(F.sum(F.get("v", F.lit(i))) for i in range(width))).alias("all"), F.count("*").alias("new"))
    sums = sums.select(who, F.slice("all", F.lit(1), F.col("dim")).alias("sum"), "new")
    rows = profiles_.select(who, "mean", "n").join(sums, who, "full")
    total = (F.coalesce("n", F.lit(0)) + F.coalesce("new", F.lit(0))).alias("n")
    old = F.transform("mean", lambda x: x.cast("double") * F.col("n"))
    both = F.when(F.col("sum").isNull(), old).when(F.col("mean").isNull(), F.col("sum")).otherwise(F.zip_with(old, "sum", lambda x, y: x + y))
    return rows.select(who, F.transform(both, lambda x: x / (F.coalesce("n", F.lit(0)) + F.coalesce("new", F.lit(0)))).alias("mean"), total)


def nearest_ranks(rows: DataFrame, key: str, value: str, percents: tuple[int, ...], slices: int = 256) -> DataFrame:
    """(key, p.., i..): percentiles by nearest rank, ceil(n p / 100), and by index, ceil((n - 1) p / 100) + 1; nulls do not count.

    Each key's values are cut into about `slices` ranges, whose counts say in which range each rank lies; only those ranges are put in order.
    """
    rows = rows.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(key, F.col(value).alias("v"))
    edges = rows.groupBy(key).agg(F.array_distinct(F.percentile_approx("v", [i / slices for i in range(1, slices)], 4 * slices)).alias("edges"))
    sliced = rows.join(edges, key).select(key, "v", F.size(F.filter("edges", lambda e: e < F.col("v"))).alias("slice"))
    counts = checkpointed(sliced.groupBy(key, "slice").agg(F.count("*").alias("c")))
    before = F.coalesce(F.sum("c").over(Window.partitionBy(key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = F.sum("c").over(Window.partitionBy(key))
    ranks = [F.struct(F.lit(f"p{p}").alias("name"), F.ceil(F.col("n") * p / 100).alias("rank")) for p in percents]
    ranks += [F.struct(F.lit(f"i{p}").alias("name"), (F.ceil((F.col("n") - 1) * p / 100) + 1).alias("rank")) for p in percents]
    asked = counts.withColumns({"before": before, "n": n}).select(key, "slice", "before", "c", F.explode(F.array(*ranks)).alias("r"))
    asked = asked.where((F.col("r.rank") > F.col("before")) & (F.col("r.rank") <= F.col("before") + F.col("c")))
    asked = asked.groupBy(key, "slice").agg(F.collect_list(F.struct("r.name", (F.col("r.rank") - F.col("before")).alias("place"))).alias("places"))
    own = sliced.join(asked, [key, "slice"]).withColumn("place", F.row_number().over(Window.partitionBy(key, "slice").orderBy("v")))
    found = own.select(key, "v", F.explode(F.filter("places", lambda x: x["place"] == F.col("place"))).alias("x"))
    return found.groupBy(key).agg(*(F.max(F.when(F.col("x.name") == f"{c}{p}", F.col("v"))).alias(f"{c}{p}") for c in "pi" for p in percents))
