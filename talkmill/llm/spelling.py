"""Spelling variants: words of a corpus that are one edit apart, found by generating whole neighbourhoods.

Every word emits all of its deletions, replacements and insertions over the alphabet of the vocabulary; those that are words
are its near words, so no distance is ever computed. A neighbourhood has about 2 * length * alphabet members, too many to shuffle. So the
vocabulary goes to the neighbourhoods: an edit behind the middle of a word leaves its first half as it is, an edit before the middle
its second half. Words are dealt out by these halves, and each task looks its own candidates up in the words that it was dealt.

Candidates are made as 64-bit polynomial hashes, by arrays, from the hashes of what stands before and behind the edit; a hit is spelt out and
compared with the word it hit, so the hash decides nothing. A half that very many words share is dealt into parts: each part has some of the words
to be found and all of the words that ask.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.llm.shared import written

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Letters of a word: A to Z in both cases, and the code points U+00C0 to U+00FF.
LETTERS = "A-Za-zÀ-ÿ"
#: Different words that a task counts before it passes its counts on.
HELD = 1 << 18
#: Words of one half that one part may look for.
PART = 1 << 16
#: Candidates that are made at once.
BLOCK = 1 << 21


def garbled(doc_id: int | None, word: str, every: int) -> str:
    """The word, or without one code point where `every` divides the CRC-32 of `<doc_id>:<word>`."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    at = h % len(word)
    return word if h % every else word[:at] + word[at + 1 :]


def vocabulary(documents: DataFrame, least_length: int = 7, least_count: int = 2, every: int = 31) -> DataFrame:
    """(word, n): the words of documents(doc_id, text) and how often they occur.

    Words are maximal runs of LETTERS with A to Z in lower case; where `every` divides the CRC-32 of `<doc_id>:<run>`, one code point is left out.
    Each task counts before anything is shuffled, so a very common word costs a row a task. A null text has no words, and a null doc_id reads
    as nothing before the colon. Repeated rows count again.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counted = lambda c: pd.DataFrame({"word": pd.Series(list(c), dtype=object), "n": pd.Series(list(c.values()), dtype="int64")})
        # A run that loses a code point has least_length + 1 at least, so shorter runs never count.
        runs, counts = re.compile(f"[{LETTERS}]{{{least_length},}}"), Counter()
        for b in batches:
            for doc_id, text in zip(b["doc_id"].tolist(), b["text"]):
                if text is None:
                    continue
                doc_id = None if doc_id is None or doc_id != doc_id else int(doc_id)
                lowered = text.encode("utf-8", "surrogatepass").translate(LOWER).decode("utf-8", "surrogatepass")
                for run, n in Counter(runs.findall(lowered)).items():
                    word = garbled(doc_id, run, every)
                    if len(word) >= least_length:
                        counts[word] += n
                if len(counts) > HELD:
                    yield counted(counts)
                    counts.clear()
        yield counted(counts)

    rows = documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(each, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Hashes:
    """Polynomial hashes modulo 2 ** 64 of words of one length, and of all words one edit away from them."""

    BASE = np.uint64(0x9E3779B97F4A7C15)
    BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

    @staticmethod
    def codes(words: list[str], length: int) -> np.ndarray:
        """Code points, a row for each word."""
        return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), length)

    @staticmethod
    def letters(codes: np.ndarray) -> np.ndarray:
        """A well mixed number for each code point."""
        h = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(32))

    @classmethod
    def powers(cls, length: int) -> np.ndarray:
        base = int(cls.BASE)
        return np.array(list(accumulate(range(length - 1), lambda power, _: power * base % (1 << 64), initial=1)), np.uint64)

    @classmethod
    def of(cls, words: list[str], length: int) -> np.ndarray:
        return (cls.letters(cls.codes(words, length)) * cls.powers(length)).sum(axis=1, dtype=np.uint64)

    @classmethod
    def neighbourhoods(cls, words: list[str], length: int, alphabet: np.ndarray, behind: bool) -> Iterator[tuple[str, int, np.ndarray]]:
        """(kind, place, hashes) of the edits behind the middle of the words, or before it; hashes: words, or words x alphabet."""
        power = cls.powers(length + 1)
        terms = cls.letters(cls.codes(words, length)) * power[:length]
        before = np.zeros((len(words), length + 1), np.uint64)
        np.cumsum(terms, axis=1, out=before[:, 1:])
        after = before[:, -1:] - before
        new, middle = cls.letters(alphabet), length // 2
        for i in range(middle, length + 1) if behind else range(middle):
            yield "insert", i, (before[:, i] + after[:, i] * cls.BASE)[:, None] + (new * power[i])[None, :]
            if i < length:
                yield "delete", i, before[:, i] + after[:, i + 1] * cls.BACK
                yield "replace", i, (before[:, i] + after[:, i + 1])[:, None] + (new * power[i])[None, :]


class Known:
    """The words to be found in a task, by their hashes."""

    def __init__(self, words: list[str]):
        self.words = np.array(words, object)
        hashes = np.empty(len(words), np.uint64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for length in np.unique(lengths).tolist():
            at = np.nonzero(lengths == length)[0]
            hashes[at] = Hashes.of(self.words[at].tolist(), length)
        order = np.argsort(hashes, kind="stable")
        self.words, self.hashes = self.words[order], hashes[order]
        # A table of bits, 32 to 64 a word, tells most candidates from words before the sorted hashes are searched.
        self.shift = np.uint64(64 - min(31, max(10, len(words).bit_length() + 5)))
        self.bits = np.zeros(1 << 64 - int(self.shift) - 3, np.uint8)
        places = self.place(self.hashes)
        np.bitwise_or.at(self.bits, places >> np.uint64(3), np.uint8(1) << (places & np.uint64(7)).astype(np.uint8))

    def place(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) >> self.shift

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of candidates, and of the words with the same hash."""
        flat = hashes.ravel()
        places = self.place(flat)
        at = np.nonzero(self.bits[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8) & np.uint8(1))[0]
        low, high = np.searchsorted(self.hashes, flat[at], "left"), np.searchsorted(self.hashes, flat[at], "right")
        n = high - low
        return np.repeat(at, n), np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def neighbours(sources: list[str], targets: list[str], alphabet: str, behind: bool) -> tuple[list[str], list[str]]:
    """Pairs (word, near word): an edit of the sources behind their middle, or before it, that is one of the targets."""
    known, letters = Known(targets), np.frombuffer(alphabet.encode("utf-32-le", "surrogatepass"), np.uint32)
    by_length: dict[int, list[str]] = {}
    for word in sources:
        by_length.setdefault(len(word), []).append(word)
    out: set[tuple[str, str]] = set()
    for length, own in by_length.items():
        step = max(1, BLOCK // len(letters))
        for k in range(0, len(own), step):
            words = own[k : k + step]
            for kind, i, hashes in Hashes.neighbourhoods(words, length, letters, behind):
                for at, hit in zip(*(x.tolist() for x in known.hits(hashes))):
                    word = words[at] if kind == "delete" else words[at // len(letters)]
                    letter = "" if kind == "delete" else alphabet[at % len(letters)]
                    spelt = word[:i] + letter + word[i + (kind != "insert") :]
                    if spelt == known.words[hit] and spelt != word:
                        out.add((word, spelt))
    return [w for w, _ in out], [x for _, x in out]


def near_words(words: DataFrame, alphabet: str) -> DataFrame:
    """(word, near): all pairs, in both directions, of words(word) that are one insertion, deletion or replacement apart.

    `alphabet` has all code points of the words. Words are distinct and not null.
    """
    sizes = F.length("word")
    # A word asks under its own length and half; it is found under those of the lengths from which one edit leads to it.
    sides = F.explode(F.array(F.lit(True), F.lit(False))).alias("behind")
    middle = F.floor(F.col("length") / 2).cast("int")
    half = F.when(F.col("behind"), F.substring("word", F.lit(1), middle)).otherwise(F.expr("right(word, length - cast(floor(length / 2) as int))"))
    asked = words.select("word", sizes.alias("length"), sides).withColumn("half", half).withColumn("asks", F.lit(True))
    found = words.select("word", F.explode(F.sequence(sizes - 1, sizes + 1)).alias("length"), sides).withColumn("half", half).withColumn("asks", F.lit(False))
    key = ["behind", "length", "half"]
    large = written(found.groupBy(*key).agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).where("parts > 1"), "large-halves")
    one = F.lit(0).alias("part")
    if large.isEmpty():
        asked, found = asked.select(*key, "word", "asks", one), found.select(*key, "word", "asks", one)
    else:
        parts = F.coalesce("parts", F.lit(1))
        found = found.join(large, key, "left").select(*key, "word", "asks", F.pmod(F.xxhash64("word"), parts).cast("int").alias("part"))
        asked = asked.join(large, key, "left").select(*key, "word", "asks", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows are sorted by side and half, those to be found first. Whole halves are looked at together, and the askers of a large one PART at a time."""
        sources, targets, now, last = [], [], None, None
        found_here = lambda: pd.DataFrame(dict(zip(("word", "near"), neighbours(sources, targets, alphabet, now))), dtype=object)
        for b in batches:
            for behind, length, half, part, word, asks in zip(b["behind"].tolist(), b["length"].tolist(), b["half"], b["part"].tolist(), b["word"], b["asks"].tolist()):
                group = (behind, length, half, part)
                full = len(sources) + len(targets) > PART
                if last is not None and (behind != now or full and (group != last or asks and len(sources) > PART)):
                    if sources and targets:
                        yield found_here()
                    sources = []
                    if group != last:
                        targets = []
                now, last = behind, group
                (sources if asks else targets).append(word)
        if sources and targets:
            yield found_here()

    rows = asked.unionByName(found).repartition(*key, "part").sortWithinPartitions(*key, "part", "asks")
    # A pair whose edit can be told in two ways (a letter beside the same letter) may be found on both sides.
    return rows.mapInPandas(each, "word string, near string").distinct()


def followed(forms: DataFrame, rounds: int = 7) -> DataFrame:
    """(word, root): where the forms of forms(word, form) lead; a form's n is ten times the word's, so a path has 19 steps at most."""
    paths = written(forms.select("word", F.col("form").alias("root")), "paths")
    for _ in range(rounds):
        step = paths.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = written(paths.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "paths")
        paths = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            break
    return paths


def variants(documents: DataFrame, least_length: int = 7, least_count: int = 2, every: int = 31, times: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of `vocabulary`.

    Words are near if one inserted, deleted or replaced code point makes one of the other. A word's form is its near word of largest n (of equal
    ones the smallest in code-point order) if that n is at least `times` the word's, else null; root follows forms to the last one. n_near
    counts near words, form_n is the form's n. No words, from no rows or null and empty texts, give no rows; further columns are not read.
    """
    words = written(vocabulary(documents, least_length, least_count, every), "vocabulary")
    # At most 90: a to z, and 64 others.
    letters = [r["letter"] for r in words.select(F.explode(F.split("word", "")).alias("letter")).distinct().collect()]
    if not letters:
        return words.select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("form_n"))
    pairs = written(near_words(words.select("word"), "".join(sorted(letters))), "near-words")
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col("near")))
    near = pairs.join(words.select(F.col("word").alias("near"), "n"), "near").groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    rows = words.join(near, "word", "left")
    enough = -F.col("best.m") >= times * F.col("n")
    rows = written(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.m")).alias("form_n")), "forms")
    paths = followed(rows.where("form is not null"))
    rows = rows.join(paths, "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
