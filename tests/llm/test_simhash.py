"""Fingerprints and components against plain Python."""

import random
import re

import xxhash
from pyspark.sql import functions as F

from talkmill.llm.simhash import exact_cells, fingerprint, keep_one, near_duplicates, near_links, similar_documents
from talkmill.tables import load

SF = "/root/testdata/sf0.01"


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    n = max(1, len(words) - 2)
    hashes = [xxhash.xxh64(" ".join(words[i : i + 3]).encode(), seed=42).intdigest() for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius):
    root = {d: d for d, _ in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (d, f) in enumerate(fps):
        for e, g in fps[:i]:
            if (f ^ g).bit_count() <= radius:
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
    return {d: find(d) for d, _ in fps}


def test_whole_table_against_brute_force(spark):
    docs = load(spark, SF, "documents")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    fps = sorted((d, plain_fingerprint(t)) for d, t in texts.items())
    component = plain_components(fps, 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_duplicates(docs).collect()}
    assert got == {d: (f"{f:016x}", component[d]) for d, f in fps}


def test_edges(spark):
    rows = [(1, None, 0), (2, "", 0), (3, " \t", 0), (4, "one", 0), (4, "one", 0), (None, "one", 0), (5, "Ä b c d", 0), (6, "x " * 50_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert {by[i].component_id for i in (1, 2, 3)} == {1} and by[1].fingerprint == "0" * 16
    assert by[None].component_id is None and by[None].fingerprint == by[4].fingerprint
    assert by[6].fingerprint == f"{plain_fingerprint('x ' * 50_000):016x}"
    assert near_duplicates(docs.limit(0)).count() == 0


def grams(text, n=5):
    w = (text or "").lower().split()
    n = min(n, max(1, len(w)))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def components_of(sets, pairs):
    """The least id that each id reaches over the pairs and equal sets."""
    first, root = {}, {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in [*((first.setdefault(s, d), d) for d, s in sorted(sets.items())), *pairs]:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {d: find(d) for d in sets}


def test_recall_by_band(spark):
    """All pairs of the whole table by brute force: nearly every one is joined, and none else."""
    docs = load(spark, "/root/testdata/sf0.1", "documents")
    sets = {r.doc_id: grams(r.text) for r in docs.select("doc_id", "text").collect()}
    size, index = {d: len(s) for d, s in sets.items()}, {}
    first = {s: d for d, s in sorted(sets.items(), reverse=True)}
    for s, d in first.items():
        for x in s:
            index.setdefault(x, []).append(d)
    shared = {}
    for ds in index.values():
        for i, a in enumerate(ds):
            for b in ds[:i]:
                k = (a, b) if a < b else (b, a)
                shared[k] = shared.get(k, 0) + 1
    jaccard = {(a, b): n / (size[a] + size[b] - n) for (a, b), n in shared.items()}
    pairs = {k: j for k, j in jaccard.items() if j >= 0.8}
    got = {r.doc_id: r.component_id for r in similar_documents(docs).collect()}
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 0.95), (0.95, 1.01)):
        own = [k for k, j in pairs.items() if low <= j < high]
        joined = sum(got[a] == got[b] for a, b in own)
        print(f"Jaccard {low} to {high}: {joined} of {len(own)} pairs joined")
        assert joined >= (0.9 if low < 0.85 else 0.97) * len(own)
    want = components_of(sets, pairs)
    assert all(want[c] == want[d] for d, c in got.items()), "only true pairs link"
    assert sum(want[d] != c for d, c in got.items()) <= 0.002 * len(got)


def test_pairs_are_verified_before_the_forest(spark):
    """Of a chain of close fingerprints, a and c are alike, b is between them and unlike both."""
    base = [f"w{i}" for i in range(400)]

    def edited(words, places):
        return [f"x{i}{w}" if i in places else w for i, w in enumerate(words)]

    a, c = edited(base, set()), edited(base, {10, 200, 390})
    b = edited(base, set(range(0, 400, 22)))
    texts = [" ".join(x) for x in (b, a, c)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in similar_documents(docs).collect()} == {0: 0, 1: 1, 2: 1}


def test_same_links_in_any_table(spark):
    """Whether two documents link does not depend on what else is in the table."""
    docs = load(spark, SF, "documents").where("doc_id < 400")
    few = {r.doc_id: r.component_id for r in similar_documents(docs).collect()}
    rest = load(spark, "/root/testdata/sf0.1", "documents").where("doc_id >= 2000").withColumn("doc_id", F.col("doc_id") + 1_000_000)
    more = docs.unionByName(rest)
    many = {r.doc_id: r.component_id for r in similar_documents(more).collect()}
    assert {d: many[d] for d in few} == few


def test_repeated_ids_and_edges_of_keep_one(spark):
    long = " ".join(f"w{i}" for i in range(300))
    near, other = long.replace("w7 ", "z7 "), " ".join(f"o{i}" for i in range(300))
    rows = [(1, long, "a"), (1, other, "b"), (2, near, "c"), (3, None, "d"), (4, "", "e"), (None, long, "f"), (5, other, "g"), (5, other, "h"), (6, "x " * 50_000, "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").withColumnRenamed("row", "component_id")
    kept = sorted(r.component_id for r in keep_one(docs).collect())
    assert kept == ["a", "b", "d", "f", "i"], "2 is near 1's first row, 5 equals its second; empty texts are alike"
    assert keep_one(docs).columns == docs.columns
    assert keep_one(docs.limit(0)).count() == 0


def test_links_of_large_cells(spark):
    """Cells over the tile are cut; the links are those of whole cells."""
    rng = random.Random(3)
    fps = sorted({rng.getrandbits(12) << 40 | rng.getrandbits(3) for _ in range(3000)})
    reps = spark.createDataFrame([(i, f) for i, f in enumerate(fps)], "node long, fp0 long")
    parts = {}
    for tile in (1 << 20, 64):
        found = near_links(reps, 2, exact_cells(2), tile).collect()
        parts[tile] = plain_links({(r.u, r.v) for r in found}, len(fps))
        assert all((fps[r.u] ^ fps[r.v]).bit_count() <= 2 for r in found)
    assert parts[64] == parts[1 << 20] == [c for _, c in sorted(plain_components(list(enumerate(fps)), 2).items())]


def plain_links(edges, n):
    root = list(range(n))
    for _ in range(n):
        before = list(root)
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            return root


def test_family_of_templated_texts(spark):
    """Most pairs of a large family fail the similarity; the true pairs among them are found all the same."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(200)]

    def edited(words, n):
        out = list(words)
        for i in rng.sample(range(len(out)), n):
            out[i] = word()
        return out

    texts = [edited(base, 4) for _ in range(1000)]
    texts += [edited(t, 2 + k % 3) for k, t in enumerate(texts[:200])]
    grams = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    pairs = [(a, b) for b in range(len(texts)) for a in range(b) if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])]
    assert 200 <= len(pairs) < 2000
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in similar_documents(docs).collect()}
    apart = sum(got[a] != got[b] for a, b in pairs)
    print(f"{apart} of {len(pairs)} pairs apart")
    assert apart <= 0.02 * len(pairs)
    root = list(range(len(texts)))
    for a, b in sorted(pairs, key=lambda p: p[1]):
        low, high = sorted((root[a], root[b]))
        root = [low if x == high else x for x in root]
    assert all(root[d] == root[c] for d, c in got.items()), "only true pairs link"


def test_equal_fingerprints_of_unlike_texts(spark):
    """A repeated shingle sets the whole fingerprint; the rest of the texts has nothing in common."""
    texts = [" ".join(["row"] * 100 + [f"{k}{i}" for i in range(60)]) for k in "abc"] + [" ".join(["row"] * 100 + [f"a{i}" for i in range(60)])]
    assert len({fingerprint(t, 5) for t in texts}) == 1
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in similar_documents(docs).collect()} == {0: 0, 1: 1, 2: 2, 3: 0}
