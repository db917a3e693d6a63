"""Repeated passages against plain comparison."""

import random

import numpy as np

from talkmill.llm.passages import bands_for, breaks, repeated_passages, without_repeats
from talkmill.llm.shared import WordHashes, similar_forest, union_find
from talkmill.tables import load


def grams(words, n=5):
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def test_planted_passages(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    text = lambda n: [word() for _ in range(n)]
    rows, planted = [], {}
    for p in range(60):
        passage = text(51)
        for k in range(3):
            d = 1000 + 3 * p + k
            before, after = text(rng.randrange(0, 70)), text(rng.randrange(0, 70))
            glue = rng.choice([" ", "\n"])
            planted[d] = (" ".join(before) + glue, " ".join(passage))
            rows.append((d, " ".join(before) + glue + " ".join(passage) + glue + " ".join(after)))
    rows += [(d, " ".join(text(150))) for d in range(200)]
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {r.doc_id: r for r in got}
    expected = {d for d in planted if (d - 1000) % 3}
    assert set(by) == expected and len(got) == len(by)
    for d, r in by.items():
        before, passage = planted[d]
        assert (r.start, r.end, r.n_words) == (len(before), len(before) + len(passage), 51) and r.kept_in[0] == d - (d - 1000) % 3


def test_edited_passages_inside_paragraphs(spark):
    """Of a passage of 80 words with one edited word, both sides of the edit are marked whole, if they have 20 words."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    text = lambda n: [word() for _ in range(n)]
    rows, want = [], {}
    for p in range(40):
        passage, place = text(80), rng.randrange(22, 58)
        before, after = text(30), text(rng.randrange(0, 40))
        rows.append((p, " ".join(text(25) + passage + text(30))))
        edited = [*passage[:place], word(), *passage[place + 1 :]]
        rows.append((100 + p, " ".join(before + edited + after)))
        want[100 + p] = [place, 79 - place]
    got = {}
    for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id", "start").collect():
        got.setdefault(r.doc_id, []).append(r.n_words)
    sides = [(d, n) for d, ns in want.items() for n in ns]
    assert sum(n in got.get(d, []) for d, n in sides) >= 0.9 * len(sides)
    assert all(n in want[d] for d, ns in got.items() for n in ns)


def test_similar_forest_against_all_pairs():
    rng = np.random.default_rng(2)
    base = [rng.choice(4000, 60, replace=False) for _ in range(12)]
    sets = [np.unique(np.where(rng.random(60) < rng.random() * 0.3, rng.integers(4000, 9000, 60), b)) for b in base for _ in range(30)] + [np.empty(0, np.int64)] * 2
    n, group = len(sets), np.arange(len(sets)) // 3
    alike = lambda a, b: len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))
    start = list(zip(range(n), (group * 3).tolist()))
    for side in (np.zeros(n, int), np.arange(n) % 2 + 1):
        meets = lambda r, c: (side[r] != side[c]) | (side[r] == 0)  # noqa: B023, E731
        pairs = [(a, b) for a in range(n) for b in range(a) if (side[a] != side[b] or not side[a]) and alike(a, b)]
        u, v = similar_forest(np.arange(n), group, sets, 0.8, meets, block=500)
        assert set(zip(np.maximum(u, v).tolist(), np.minimum(u, v).tolist())) <= set(pairs)
        assert (union_find(n, start + pairs) == union_find(n, start + list(zip(u.tolist(), v.tolist())))).all()


def test_whole_table(spark):
    docs = load(spark, "/root/testdata/sf0.01", "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {}
    for r in repeated_passages(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    seen = {}
    for d in sorted(texts):
        for line in texts[d].split("\n"):
            words = line.lower().split()
            if len(words) >= 20:
                seen.setdefault(tuple(words), []).append(d)
    # Equal paragraphs: all but the smallest document's are inside a span.
    for words, holders in seen.items():
        for d in holders:
            if d > holders[0]:
                spans = [texts[d][r.start : r.end].lower().split() for r in got.get(d, [])]
                assert any(" ".join(words) in " ".join(s) for s in spans), (d, holders)
    # Near-duplicate paragraphs: nearly all pairs leave the one of the larger id inside a span.
    lines = [(d, set(grams(list(w)))) for w, ds in seen.items() for d in ds[:1]]
    index = {}
    for k, (_, s) in enumerate(lines):
        for g in s:
            index.setdefault(g, []).append(k)
    pairs = {(a, b) for ks in index.values() for a in ks for b in ks if a < b and lines[a][0] != lines[b][0]}
    near = [(lines[a][0], lines[b][0]) for a, b in pairs if len(lines[a][1] & lines[b][1]) >= 0.8 * len(lines[a][1] | lines[b][1])]
    assert near and sum(max(p) not in got for p in near) <= 0.03 * len(near)
    # What a span holds stands, but for the edits of near-duplicates, in a kept document.
    for d, rs in got.items():
        for r in rs:
            own = grams(texts[d][r.start : r.end].lower().split())
            kept = set().union(*(grams(texts[k].lower().split()) for k in r.kept_in))
            assert len(own & kept) >= 0.6 * len(own) and min(r.kept_in) < d


def test_edges(spark):
    passage = " ".join(f"word{i}" for i in range(60))
    edited = passage.replace("word30 ", "other ")
    texts = {1: passage, 2: "é😀\n\n " + passage.upper() + "　end", 3: None, 4: "", 5: "x", 6: "x", 7: "x " * 3000, 8: "x " * 3000, 9: edited, 10: passage + "\n" + passage}
    rows = [(d, t, "k", 0) for d, t in texts.items()] + [(None, passage, "k", 0), (2, texts[2], "k", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string, start int")
    got = {r.doc_id: r for r in repeated_passages(docs).collect()}
    assert set(got) == {2, 8, 9, 10}
    assert (got[2].start, got[2].end, got[2].n_words) == (5, len(texts[2]), 61)  # a near-duplicate paragraph
    assert got[9].n_words == 60 and got[9].kept_in == [1] and got[10].n_words == 120
    kept = {r.doc_id: r.text for r in without_repeats(docs).where("doc_id is not null").collect()}
    assert kept[1] == passage and kept[10] == "" and kept[3] is None and len(kept) == 10
    assert repeated_passages(docs.limit(0)).count() == 0
    assert bands_for(0.8) == (7, 3) and breaks(WordHashes()([]), 5).size == 0
