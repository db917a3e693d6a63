"""Spelling variants against a plain version, with edge cases and words that share their halves."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from talkmill.llm import spelling

DOCS = "doc_id long, text string, word string, n long, length int"


def words_of(rows, least=7, count=2):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            out[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in out.items() if len(w) >= least and n >= count}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(rows):
    known = words_of(rows)
    near = {w: [x for x in known if one_apart(w, x)] for w in known}
    form = {}
    for w, n in known.items():
        best = min(near[w], key=lambda x: (-known[x], x), default=None)
        if best and known[best] >= 10 * n:
            form[w] = best
    out = []
    for w, n in known.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), known.get(form.get(w))))
    return sorted(out, key=str)


def result(spark, rows):
    return sorted(map(tuple, spelling.variants(spark.createDataFrame([(*r, "x", 1, 1) for r in rows], DOCS)).collect()), key=str)


def near(word, rng, letters):
    i, kind = rng.integers(len(word) + 1), rng.integers(3)
    return word[:i] + ("" if kind == 0 else letters[rng.integers(len(letters))]) + word[i + (kind < 2) :]


@pytest.mark.parametrize("part", [spelling.PART, 3])
def test_random_words(spark, monkeypatch, part):
    """Words of few letters, many of them near each other; parts of three words split every half."""
    monkeypatch.setattr(spelling, "PART", part)
    rng, letters, base = np.random.default_rng(part), "abñÿ", ["abababa", "bañbañba", "aaaaaaaa", "abÿabÿabÿabÿ"]
    rows = []
    for doc in range(40):
        words = []
        for _ in range(30):
            word = base[rng.integers(len(base))]
            for _ in range(rng.integers(3)):
                word = near(word, rng, letters)
            words.append(word if rng.integers(4) else word.title())
        rows.append((doc, " ".join(words)))
    got = result(spark, rows)
    assert got == plain(rows) and any(r[4] > 3 for r in got)


def test_paths_and_ties(spark):
    """Forms of forms lead to one root; of near words as frequent the smallest is the form."""
    rows = [(k, text) for k, text in enumerate(["qqqqqqqa " * 2, "qqqqqqqab " * 20, "qqqqqqqabc " * 200, "qqqqqqqabcd " * 2000, "wwwwwww " * 2, "wwwwwwwz " * 20, "wwwwwwwà " * 20])]
    rows = [r for r in rows if r[1].split()[0] in words_of([r])]
    got = result(spark, rows)
    assert got == plain(rows)
    by_word = {r[0]: r for r in got}
    assert by_word["qqqqqqqa"][1:3] == ("qqqqqqqab", "qqqqqqqabcd") and by_word["wwwwwww"][1] == "wwwwwwwz"


def test_edges(spark):
    """Nulls, empty and very long texts, one very long word, repeated rows, marks and other scripts between letters."""
    rows = [(None, "nullword nullword nullwords nullwords"), (1, None), (2, ""), (3, "x" * 20_000 + " " + "x" * 20_000 + " " + "x" * 20_001 + "-" + "x" * 20_001)]
    rows += [(4, "ÀÉÎÕÜßÿ ÀÉÎÕÜßÿ àéîõüßÿ×÷ ×÷×÷×÷× ×÷×÷×÷× Łódźłódź straßen1straßen straßen")] * 2 + [(5, "repeated words " * 50_000)]
    assert result(spark, rows) == plain(rows)


def test_no_words(spark):
    assert result(spark, []) == [] and result(spark, [(1, None), (2, "a b c"), (3, "onlyonce")]) == []


def test_whole_neighbourhoods():
    """Of every word all neighbours, edits of the first half and of the second together, and nothing else."""
    letters, words = "abc", ["abcabca", "aaaaaaa", "cabcabcb"]
    every = {w: {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in ["", *letters]} for w in words}
    found = {w: set() for w in words}
    targets = sorted(set().union(*every.values()) | {"other", "words"})
    for behind in (True, False):
        for w, x in zip(*spelling.neighbours(words, targets, letters, behind)):
            found[w].add(x)
    assert found == {w: x - {w} for w, x in every.items()}
