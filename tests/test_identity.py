"""Names: blocks of short and long keys against brute force, and texts that overwhelmed backtracking patterns."""

import random

import pytest
from pyspark.sql import functions as F

from talkmill.functions.text import names_likely_same
from talkmill.operators import identity, records
from talkmill.plans import search, transcripts


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def changed(word, rng, n):
    for _ in range(n):
        i, kind = rng.randrange(1, len(word)), rng.randrange(3)
        word = word[:i] + ("" if kind == 0 else rng.choice("abc")) + word[i + (kind < 2) :]
    return word


def test_blocks_of_every_length(spark):
    """Keys two edits apart, of 6 to 60 letters and around the length where the kind of block changes, meet in some block."""
    rng, pairs = random.Random(5), []
    for k in range(400):
        word = "a" + "".join(rng.choice("abc") for _ in range(rng.choice([5, 17, 18, 19, 20, 21, 22, 23, 40, 59])))
        pairs.append((k, word, changed(word, rng, rng.randrange(3))))
    df = spark.createDataFrame(pairs, "k int, a string, b string")
    left = identity.near_keys(df, "k", "a").distinct()
    right = identity.near_keys(df, "k", "b").distinct()
    met = {r["k"] for r in left.join(right, ["k", "block"]).select("k").distinct().collect()}
    assert met == {k for k, a, b in pairs if edits(a, b) <= 2}


def test_blocks_of_a_long_key_are_few(spark):
    df = spark.createDataFrame([("x" * 100_000,), ("y" * 22,)], "k string")
    counts = identity.near_keys(df.withColumn("n", F.length("k")), "n", "k").groupBy("n").count().collect()
    assert {r["n"]: r["count"] for r in counts}[100_000] <= 45


def test_long_texts_without_marks(spark, tmp_path):
    """A text of 50,000 words without a mark, and one word of 30,000 letters twice, a letter apart."""
    rng = random.Random(1)
    long = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=12)) for _ in range(17_000)) + " dolor sit" * 16_500
    rows = [(1, long, "en", "s", 1), (2, "b" * 30_000, "en", "s", 1), (3, "Anna Bell likes", "en", "s", 1), (4, "b" * 29_999 + "c", "en", "s", 1), (5, "Ana Bell-Ray.", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    names = {r["name"] for r in search._names(spark, str(tmp_path)).collect()}
    assert long in names and "b" * 30_000 in names
    for query in (search.alias_pairs, search.alias_clusters, transcripts.entity_links):
        query(spark, str(tmp_path)).collect()
    found = {(r["a"], r["b"]) for r in search.plausible_names(spark, str(tmp_path)).collect()}
    assert ("b" * 30_000, "b" * 29_999 + "c") in found


@pytest.mark.parametrize("size", [8, 21, 30])
def test_corrections(spark, size):
    name = "a" + "bcd" * size
    tokens = spark.createDataFrame([(name[:5] + "x" + name[5:],), (name,), ("zzzz" * size,)], "token string")
    rows = records.name_corrections(tokens, spark.createDataFrame([(name,), ("other" * size,)], "name string")).collect()
    assert [tuple(r) for r in rows] == [(name[:5] + "x" + name[5:], name)]


def some_names(rng):
    """Names in whose blocks case alone tells some apart, first words with and without names of one word, cliques of both kinds, and no names."""
    spelt = lambda w: rng.choice([w, w.title(), w.upper()])
    names = [" ".join(spelt(rng.choice("abcdefgh") + "nn") if k == 0 else spelt(rng.choice(["bell", "ray"]) if k == 1 else rng.choice("xyzw")) for k in range(rng.choice([1, 2, 3, 3, 3, 4]))) for _ in range(150)]
    names += [f"solo bell {w}" for w in "abcdefg"] + ["lone", *(f"lone ray {w}" for w in "abcdefgh")] + ["case only x", "Case only x", "single", "one of", "two", "Two", "two of"]
    return [*names, *names[:20], "", " ", None]


@pytest.mark.parametrize("n", [None, 7])
def test_likely_pairs_and_clusters(spark, monkeypatch, n):
    """Blocks dealt into units give the pairs of brute force, once each, and counted blocks the clusters of these pairs."""
    monkeypatch.setattr(identity, "UNIT", 3)
    people = spark.createDataFrame([(x,) for x in some_names(random.Random(3))], "name string")
    once = people.where("trim(name) <> ''").distinct()
    every = once.withColumnRenamed("name", "a").join(once.withColumnRenamed("name", "b"), F.expr("a < b")).where(names_likely_same(F.col("a"), F.col("b")))
    pairs = identity.likely_pairs(people, n)
    assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, every.collect()))
    shown = lambda df: sorted(r.members for r in df.collect())
    out = shown(identity.likely_clusters(people, n))
    assert out == shown(identity.clusters(pairs))
    assert [f"solo bell {w}" for w in "abcdefg"] in out and ["lone", *(f"lone ray {w}" for w in "abcdefgh")] in out and not any("case only x" in x for x in out)


@pytest.mark.parametrize("query", [search.alias_pairs, search.alias_clusters])
def test_pairs_of_names_are_not_exchanged(spark, tmp_path, monkeypatch, query):
    """A pair is made once, where its block is, and goes nowhere else; the tasks that make pairs follow from the table."""
    names = ["carl ray a", "carl ray b", "carl", "Carl", *(f"anna bell x{'ab'[k % 2] * k}" for k in range(20))]
    spark.createDataFrame([(3 * k + 1, f"{x}.") for k, x in enumerate(names)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(search, "EACH", 2)
    out = query(spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(a#" not in plan and ", 12)" in plan
    rows = [" | ".join(r) for r in out.collect()]
    carls = ["Carl | carl ray a", "Carl | carl ray b", "carl ray a | carl ray b", "carl | carl ray a", "carl | carl ray b"]
    assert sorted(r for r in rows if "anna" not in r) == carls and len(rows) == len(carls) + (190 if query is search.alias_pairs else 1)
