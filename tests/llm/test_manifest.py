"""Merkle manifests against a plain version, with small tiers, edge cases, and broken proofs."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from talkmill.llm import manifest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, hash string, index long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(r, more=0):
    n = r["n_chars"] if r["n_chars"] is None else r["n_chars"] + more
    return sha(*map(encoded, (r["doc_id"], r["source"], r["lang"], n, r["text"])))


def levels(row):
    out = [row]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def beside(tree, i):
    out = []
    for row in tree[:-1]:
        other = row[i ^ 1] if i ^ 1 < len(row) else ""
        out.append((other, "") if i % 2 else ("", other))
        i //= 2
    return out


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    langs = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {}
    for k in langs:
        groups[k].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[k] = levels([leaf(r) for r in groups[k]])
    top, out = levels([trees[k][-1][0] for k in langs]), []
    for place, k in enumerate(langs):
        for i, r in enumerate(groups[k]):
            steps = beside(trees[k], i) + beside(top, place)
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            node = leaf(r, 1 if tampered else 0)
            for before, after in steps:
                node = sha(before, node, after)
            out.append((r["doc_id"], leaf(r), trees[k][-1][0], top[-1][0], sha(*(b + a for b, a in steps)), node, node == top[-1][0]))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in manifest.verified(manifest.manifest(df)).collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], DOCS)


def as_dicts(rows):
    return [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in rows]


@pytest.mark.parametrize("depth", [1, 2, 8])
def test_every_size_of_group(spark, monkeypatch, depth):
    monkeypatch.setattr(manifest, "DEPTH", depth)
    rows = [(100 * g + i, f"text {i}", f"l{g}", "s", i) for g, size in enumerate((1, 2, 3, 5, 8, 11)) for i in range(size)]
    assert result(table(spark, rows)) == plain(as_dicts(rows))


def test_edges(spark):
    """Nulls in every column, an empty text and lang, one very long text, ties, repeated rows, columns with clashing names."""
    rows = [(None, None, None, None, None), (1, None, "", "s", 3), (1, "b", "", "s", 3), (1, "a", "", "s", 3), (2, "", "=", None, 0), (2, "", "=", None, 0), (7, "é" * 300_000, "é", "s", 300_000), (14, "z", "z", "", None), (13, "z", None, "", -1)]
    got = result(table(spark, rows))
    assert got == plain(as_dicts(rows)) and len(got) == len(rows)


def test_no_rows(spark):
    assert result(table(spark, [])) == []


def test_tampering_is_seen(spark):
    rows = [(i, "t", ("en", "de", None)[i % 3], "s", i if i % 5 else None) for i in range(300)]
    got = result(table(spark, rows))
    assert got == plain(as_dicts(rows))
    changed = {i for i in range(300) if zlib.crc32(str(i).encode()) % 7 == 0 and i % 5}
    assert {r[0] for r in got if not r[6]} == changed


def test_places_with_one_hot_row(spark):
    """A third of all rows are one row; places are a permutation all the same."""
    df = spark.range(3000, numPartitions=7).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("doc_id"), F.lit("t").alias("tree"), F.lit("h").alias("hash"))
    rows = manifest.placed(df, "tree", ["doc_id", "hash"], "places").orderBy("index").collect()
    assert [r["index"] for r in rows] == list(range(3000)) and {r["size"] for r in rows} == {3000}
    assert [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows)
