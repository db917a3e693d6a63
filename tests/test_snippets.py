"""The best window of a text, against a plain version."""

import random

from pyspark.sql import functions as F

from talkmill.operators import answers

TERMS = ("alpha", "beta", "gamma")


def plain(text, size):
    if text is None:
        return None
    w = text.split()
    hits = {i: [t for t in TERMS if t in x.lower()] for i, x in enumerate(w)}
    begins = [i for i in range(len(w)) if i == 0 or w[i - 1][-1] in ".:"]
    best = None
    for i in (i for i in hits if hits[i]):
        starts = [(i, 0)]
        p = max(b for b in begins if b <= i)
        if i - size < p < i:
            starts.append((p, 100 if p else 120))
        for start, bonus in starts:
            own = [(j, t) for j in range(start, min(len(w), start + size)) for t in hits[j]]
            distinct = len({t for _, t in own})
            score = 1_000 * distinct + len(own) - distinct + bonus
            if best is None or score > best[0]:
                at = start if bonus else max(0, min(own[0][0] - (size - (own[-1][0] - own[0][0])) // 2, len(w) - size))
                best = score, at
    if best is None:
        return ""
    at = best[1]
    return ("…" if at > 0 else "") + " ".join(w[at : at + size]) + ("…" if at + size < len(w) else "")


def test_best_window(spark):
    rng = random.Random(5)
    pool = ["alpha", "beta", "GAMMA", "alphabet", "alphagamma", "one", "two", "three.", "four:", "five", "six", "seven"]
    texts = [" ".join(rng.choice(pool[: rng.randrange(1, 13)] if rng.random() < 0.2 else pool + ["x"] * 30) for _ in range(rng.randrange(0, 90))) for _ in range(300)]
    texts += [None, "", "  ", "alpha", "one two", "Alpha x " + "x " * 60 + "beta gamma alpha end"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for size in (5, 24):
        got = dict(rows.select("id", answers.best_snippet(F.col("text"), TERMS, size)).collect())
        assert [got[i] for i in range(len(texts))] == [plain(t, size) for t in texts]
    assert dict(rows.select("id", answers.best_snippet(F.col("text"), TERMS)).collect())[len(texts) - 1].endswith("beta gamma alpha end")


def test_a_very_long_text_of_hits(spark):
    text = "alpha beta " * 30_000 + "gamma"
    got = spark.createDataFrame([(text,)], "text string").select(answers.best_snippet(F.col("text"), TERMS)).first()[0]
    assert got.endswith("alpha beta gamma") and len(got.split()) == 24
