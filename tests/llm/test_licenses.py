"""Licences against comparison with every template, without pruning."""

import re
from collections import Counter
from pathlib import Path

import pyspark

from talkmill.llm.license_texts import TEMPLATES
from talkmill.llm.licenses import licenses
from talkmill.tables import load


def bag(text):
    w = re.findall(r"[^\W_]+", text.lower())
    return Counter(zip(w, w[1:]))


BAGS = [(n, bag(t)) for n, t in TEMPLATES]


def plain(text):
    text = text or ""
    cuts = [[(0, len(text))]]
    for end in (r"\n[^\S\n]*\n", r"\n", r"(?<=[.!?])\s+|\n"):
        edges = [(m.start(), m.end()) for m in re.finditer(end, text)]
        cuts.append(list(zip([0] + [e for _, e in edges], [s for s, _ in edges] + [len(text)])))
    best = {}
    for s, e in (x for level in cuts for x in level):
        own = bag(text[s:e])
        n = sum(own.values())
        found = [(2 * sum((own & b).values()) / (n + sum(b.values())), -k) for k, (_, b) in enumerate(BAGS) if n]
        if found and max(found)[0] >= 0.8:
            d, k = max(found)
            name = BAGS[-k][0]
            if name not in best or (d, n) > best[name][0]:
                best[name] = ((d, n), s, e)
    return {(n, round(d, 9), s, e) for n, ((d, _), s, e) in best.items()}


def test_whole_table(spark):
    docs = load(spark, "/root/testdata/sf0.01", "documents")
    got = {}
    for r in licenses(docs).collect():
        got.setdefault(r.doc_id, set()).add((r.license, round(r.dice, 9), r.start, r.end))
    want = {r.doc_id: plain(r.text) for r in docs.collect()}
    assert got == {d: w for d, w in want.items() if w} and len(got) > 20


def test_edges(spark):
    full = dict((n, t) for n, t in TEMPLATES if len(t) > 900)["MIT"]
    texts = [None, "", "License", full, "intro text\n\n" + full.upper().replace(", ", ",\n") + "\n\nrest", "Prose here. Licensed under CC BY-NC 4.0. More prose, which goes on.", "x " * 50_000 + "\nReleased under the MIT License.", "licence of no kind"]
    docs = spark.createDataFrame([(i, t, "k", 0) for i, t in enumerate(texts)] + [(None, texts[5], "k", 0)], "doc_id long, text string, license string, start int")
    got = licenses(docs).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.license, r.unit) for r in got) == [(-1, "CC-BY-NC-4.0", "sentence"), (3, "MIT", "text"), (4, "MIT", "block"), (5, "CC-BY-NC-4.0", "sentence"), (6, "MIT", "line")]
    assert all(texts[r.doc_id][r.start : r.end].startswith(("P", "L", "R")) for r in got if r.doc_id is not None)
    assert licenses(docs.limit(0)).count() == 0


def test_notices_of_several_parts(spark):
    """Paragraphs between blank lines, and hard-wrapped lines inside a block, of every long template."""
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    prose = " ".join(words[i * i % 8] for i in range(700))
    want, rows = [], []
    for name, full in ((n, t) for n, t in TEMPLATES if len(t) > 300):
        w = full.split()
        third = len(w) // 3
        paragraphs = "\n\n".join(" ".join(p) for p in (w[:third], w[third : 2 * third], w[2 * third :]))
        wrapped = "\n".join(" ".join(w[i : i + 9]) for i in range(0, len(w), 9))
        for notice, before, after in ((paragraphs, "\n\n", "\n\n"), (wrapped, "\n", "\n")):
            want.append((len(rows), name, notice))
            rows.append((len(rows), prose + before + notice + after + prose))
    got = {(r.doc_id, r.license): r for r in licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(want) >= 40
    for d, name, notice in want:
        r = got[d, name]
        bare = lambda t: re.findall(r"[^\W_]+", t)
        assert r.dice > 0.99 and abs(len(bare(rows[d][1][r.start : r.end])) - len(bare(notice))) <= 0.02 * len(bare(notice))


def test_licence_files_of_packages(spark):
    """Licence texts as other packages ship them, alone and inside a longer file."""
    own = Path(pyspark.__file__).parent / "licenses"
    known = {"LICENSE-py4j.txt": "BSD-3-Clause", "LICENSE-cloudpickle.txt": "BSD-3-Clause", "LICENSE-mustache.txt": "MIT", "LICENSE-jquery.txt": "MIT", "LICENSE-bootstrap.txt": "MIT", "LICENSE-CC0.txt": "CC0-1.0"}
    files = {own / f: n for f, n in known.items()}
    site = own.parents[1]
    for pattern, name in (("packaging-*/licenses/LICENSE.BSD", "BSD-2-Clause"), ("packaging-*/licenses/LICENSE.APACHE", "Apache-2.0"), ("requests-*/licenses/LICENSE", "Apache-2.0"), ("pytz-*/LICENSE.txt", "MIT")):
        files.update(dict.fromkeys(site.glob(pattern), name))
    files = {f: n for f, n in files.items() if f.exists()}
    assert len(files) >= 4
    prose = "\n".join("Some words that say what the module does and how to call it, line %d." % i for i in range(60))
    texts = [t for f in files for t in (f.read_text("utf-8"), f"{prose}\n\n{f.read_text('utf-8')}\n\n{prose}", "\n".join("# " + x for x in [*prose.split("\n"), *f.read_text("utf-8").split("\n"), *prose.split("\n")]))]
    got = {}
    for r in licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, {})[r.license] = r.dice
    for i, name in enumerate(n for n in files.values() for _ in range(3)):
        assert max(got.get(i, {"none": 0}), key=got.get(i, {"none": 0}).get) == name, (i, name, got.get(i))
