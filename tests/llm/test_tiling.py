"""Tiles and coverage against plain greedy string tiling."""

import random

import numpy as np

from talkmill.llm.shared import WordHashes
from talkmill.llm.tiling import contaminated, decontaminated, tiles, words_of
from talkmill.tables import load

SF = "/root/testdata/sf0.01"


def plain_tiles(a, b, least):
    """Wise's greedy string tiling by exhaustive search."""
    marked_a, marked_b, out = set(), set(), []
    while True:
        best, found = least - 1, []
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in marked_a and j + n not in marked_b:
                    n += 1
                if n > best:
                    best, found = n, []
                if n == best and n >= least:
                    found.append((i, j))
        if not found:
            return out
        for i, j in found:
            if not (marked_a & set(range(i, i + best)) or marked_b & set(range(j, j + best))):
                marked_a |= set(range(i, i + best))
                marked_b |= set(range(j, j + best))
                out.append((i, j, best))


def test_tiles_cover_as_plain_ones():
    rng = random.Random(3)
    for letters in (2, 4, 8):
        for _ in range(40):
            a = [rng.randrange(letters) for _ in range(rng.randrange(1, 25))]
            b = [rng.randrange(letters) for _ in range(rng.randrange(1, 40))]
            key = np.random.default_rng(1).integers(1, 1 << 63, letters, dtype=np.uint64)
            got = tiles(key[a], key[b], 3)
            want = plain_tiles(a, b, 3)
            assert sorted(n for *_, n in got)[-1:] == sorted(n for *_, n in want)[-1:]
            for i, j, n in got:
                assert a[i : i + n] == b[j : j + n]
            assert len({x for i, _, n in got for x in range(i, i + n)}) == sum(n for *_, n in got)
            if letters == 8:
                assert sum(n for *_, n in got) == sum(n for *_, n in want)


def test_whole_table(spark):
    docs, bench = load(spark, SF, "documents"), load(spark, SF, "benchmark")
    items = {r.item_id: words_of(r.text) for r in bench.collect()}
    want = {}
    for r in docs.collect():
        words = words_of(r.text)
        grams = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
        for item, w in items.items():
            if sum(tuple(w[i : i + 5]) in grams for i in range(len(w) - 4)) >= 2:
                found = plain_tiles(w, words, 5)
                if (covered := sum(n for *_, n in found)) >= 0.5 * len(w):
                    want[r.doc_id, item] = covered
    got = {(r.doc_id, r.item_id): r.covered_words for r in contaminated(docs, bench).collect()}
    assert got == want and len(got) > 10
    kept = {r.doc_id for r in decontaminated(docs, bench).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - {d for d, _ in want}


def test_edges(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    swapped = "x Seven, eight nine TEN eleven twelve y z one two three four five six w"
    texts = [item, swapped, None, "", "one two three four", "short item", "a b " * 20_000 + item, "one two three four five"]
    docs = spark.createDataFrame([(i, t, 9, "k") for i, t in enumerate(texts)] + [(None, item, 9, "k"), (0, item, 9, "k")], "doc_id long, text string, item_id int, row string")
    bench = spark.createDataFrame([(1, item, 0), (2, None, 0), (3, "", 0), (4, "Short item!", 0), (None, item, 0), (5, "a b " * 300, 0), (4, "another text of item four here", 0)], "item_id long, text string, doc_id int")
    got = contaminated(docs, bench).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.item_id, r.n_tiles) for r in got) == [(-1, 1, 1), (0, 1, 1), (0, 1, 1), (1, 1, 2), (5, 4, 1), (6, 1, 1), (6, 5, 1)]
    assert {(r.start, r.end) for r in got if r.doc_id == 1} == {(1, 15)}
    assert len(contaminated(docs, bench, max_words=1).collect()) == len(got)
    assert sorted(r.doc_id for r in decontaminated(docs, bench).collect()) == [2, 3, 4, 7]
    assert decontaminated(docs, bench).columns == docs.columns
    # Blocks of one item each, more than a pass takes: the same rows, by one join, and the documents are not written.
    many = decontaminated(docs, bench, max_words=1)
    assert sorted(r.doc_id for r in many.collect()) == [2, 3, 4, 7] and many.columns == docs.columns
    assert sum("contaminated" in f for f in many.inputFiles()) > 0 and "LeftAnti" in many._jdf.queryExecution().optimizedPlan().toString()
    assert contaminated(docs.limit(0), bench).count() == 0 and contaminated(docs, bench.limit(0)).count() == 0
    assert WordHashes()([]).size == 0
