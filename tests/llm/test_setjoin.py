"""The set-similarity join against brute force: groups of near copies, chains, long lists in small blocks, edge cases."""

import numpy as np
import pytest

from talkmill.llm import setjoin

DOCS = "doc_id long, text string, node long, size long, token long, members string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, n=3):
    words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in (text or "").translate(LOWER)).split(" ") if w]
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def brute(rows, percent=90):
    sets, root = [grams(t) for _, t in rows], list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), None if d is None else least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def result(spark, rows, percent=90):
    df = spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], DOCS)
    return sorted(map(tuple, setjoin.similar_sets(df, 3, percent).collect()), key=str)


def near_copies(seed):
    """Groups of near copies around origins that are not always there, chains of small steps, passages that many texts share, short texts of common words."""
    rng = np.random.default_rng(seed)
    word = lambda: f"w{rng.integers(4000)}"
    rows, common = [], [f"the{k}" for k in range(6)]
    shared = [word() for _ in range(80)]
    for group in range(8):
        base = [word() for _ in range(int(rng.integers(30, 160)))]
        if group % 3 == 0:
            base = shared + base[: 6 * (group + 1)]
        for _ in range(14):
            text = list(base)
            for _ in range(int(rng.integers(0, max(2, len(base) // 25)))):
                text[rng.integers(len(text))] = word()
            if rng.integers(3) == 0:
                text = text[int(rng.integers(4)) :]
            if rng.integers(2) == 0:
                base = text if group % 2 else base
            rows.append(" ".join(text))
    rows += [" ".join(rng.choice(common, int(rng.integers(1, 14)))) for _ in range(60)]
    order = rng.permutation(len(rows))
    return [(int(k) * 3, rows[i]) for k, i in enumerate(order)]


@pytest.mark.parametrize(("rounds", "small", "block"), [(2, 128, 1 << 21), (0, 128, 1 << 21), (0, 1, 1 << 21), (0, 5, 700)])
def test_groups(spark, monkeypatch, rounds, small, block):
    """With leaders and without them, by pairs and by lists, and with long lists cut into small blocks: the same rows."""
    monkeypatch.setattr(setjoin, "SMALL", small)
    monkeypatch.setattr(setjoin, "ROUNDS", rounds)
    monkeypatch.setattr(setjoin, "BLOCK", block)
    monkeypatch.setattr(setjoin, "SHARE", 3)
    rows = near_copies(7)
    want = brute(rows)
    assert result(spark, rows) == want
    assert len({r[2] for r in want}) < len(want) - 40


def test_threshold_is_exact(spark):
    """Sets of 19 and 20 grams that share 18 or 19: one pair is at 0.9 and links, one is below."""
    at = " ".join(f"a{k}" for k in range(12))
    rows = [(0, " ".join(f"a{k}" for k in range(11))), (1, at)]  # 9 of 10 grams
    rows += [(2, " ".join(f"b{k}" for k in range(10))), (3, " ".join(f"b{k}" for k in range(11)))]  # 8 of 9
    assert brute(rows)[1][2] == 0 and brute(rows)[3][2] == 3
    assert result(spark, rows) == brute(rows)


def test_other_percent(spark):
    rows = near_copies(5)[:90]
    assert result(spark, rows, 70) == brute(rows, 70)


def test_edges(spark):
    """Nulls, blanks, one-word texts, capitals, other blanks, a very long text, repeated rows and ids."""
    long = " ".join(f"x{k}" for k in range(60_000))
    rows = [(None, "a b c d"), (None, None), (1, None), (2, ""), (3, " \t\n"), (4, "a b c d"), (5, "A\tB\nc  D"), (6, "one"), (7, "ONE"), (8, "one two"), (9, "a b c d")]
    rows += [(10, long), (11, long + " y"), (12, "É è"), (13, "é è"), (14, "rep eat ed row"), (14, "rep eat ed row"), (14, "other text of one id"), (15, "other text of one id"), (16, "rep eat ed row")]
    assert result(spark, rows) == brute(rows)
    assert result(spark, []) == []


def joined(n, links):
    root = list(range(n))
    for a, b in links:
        x, y = sorted((root[a], root[b]))
        root = [x if r == y else r for r in root]
    return root


def test_units():
    """The kernel alone: its links join what brute force joins, for whole lists and for two blocks, and are few."""
    rng = np.random.default_rng(3)
    for trial in range(30):
        base = np.sort(rng.choice(1 << 40, int(rng.integers(20, 200)), replace=False)).astype(np.uint64)
        sets = []
        for _ in range(40):
            own = np.delete(base, rng.choice(len(base), int(rng.integers(0, max(1, len(base) // 8))), replace=False))
            sets.append(np.unique(np.concatenate([own, rng.integers(1 << 40, size=int(rng.integers(0, 9))).astype(np.uint64)])))
        side = np.zeros(40, int) if trial % 2 else np.repeat([1, 2], 20)
        found = setjoin.Unit(sets, np.zeros(40, int), np.arange(40), side, 90, rows=7, mass=1000).run()
        alike = lambda i, j: 190 * len(np.intersect1d(sets[i], sets[j])) >= 90 * (len(sets[i]) + len(sets[j]))  # noqa: B023, E731
        every = [(i, j) for i in range(40) for j in range(i) if (not side[0] or side[i] != side[j]) and alike(i, j)]
        want = joined(40, every)
        assert joined(40, found) == want and set(found) <= {p for q in every for p in (q, q[::-1])} and len(found) <= 2 * (40 - len(set(want)))
