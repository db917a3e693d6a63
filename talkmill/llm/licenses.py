"""Licence scan: units of a text against licence templates by the Dice coefficient over word bigrams.

Units are the whole text, its blocks (between blank lines), lines and sentences, and runs of consecutive sentences or lines
across line ends and blank lines, as notices of several paragraphs and hard-wrapped ones are. A unit of n bigrams can reach a Dice
coefficient t only with templates of t / (2 - t) * n to (2 - t) / t * n bigrams; others are not compared. Runs are tried only from places after which so many bigrams
of the template stand within that length; a run's shared bigrams follow from running sums, so that the work stays linear.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.llm.license_texts import TEMPLATES
from talkmill.llm.shared import WordHashes, ngram_hashes

WORD = re.compile(r"[^\W_]+")
#: What ends a unit, from the largest to the smallest.
ENDS = (("block", re.compile(r"\n[^\S\n]*\n")), ("line", re.compile(r"\n")), ("sentence", re.compile(r"(?<=[.!?])\s+|\n")))
SCHEMA = "doc_id long, license string, dice double, unit string, start long, end long"


def normalised(text: str) -> list[str]:
    """Words of letters and digits, in lower case."""
    return WORD.findall(text.lower())


class Scanner:
    """Templates and their bigrams; compares units of texts."""

    def __init__(self, templates: tuple[tuple[str, str], ...], threshold: float):
        self.threshold, self.names = threshold, [n for n, _ in templates]
        words = [normalised(t) for _, t in templates]
        self.bags = [Counter(zip(w, w[1:])) for w in words]
        self.sizes = [sum(b.values()) for b in self.bags]
        #: The hashes of the templates' bigrams, in order; how often each template has each; and, by the upper bits, which hashes there may be.
        own = [ngram_hashes(WordHashes()(w), 2) for w in words]
        self.known = np.unique(np.concatenate([*own, np.empty(0, np.uint64)]))
        self.counts = np.zeros((len(words), len(self.known) + 1), np.int32)
        for k, h in enumerate(own):
            np.add.at(self.counts[k], np.searchsorted(self.known, h), 1)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.known >> np.uint64(44)).astype(np.int64)] = True
        # A unit that reaches the threshold with a template of s bigrams shares at least t / (2 - t) * s of them.
        self.least = np.array([int(np.ceil(threshold / (2 - threshold) * s - 1e-9)) for s in self.sizes], np.int64)
        self.shared = min((n for n in self.least.tolist() if n), default=1)

    def bigrams(self, hashes: WordHashes, words: list[str]) -> np.ndarray:
        """The number of each bigram, the last one for those of no template."""
        h = ngram_hashes(hashes(words), 2)
        out = np.full(len(h), len(self.known))
        at = np.nonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])[0]
        place = np.minimum(np.searchsorted(self.known, h[at]), max(len(self.known) - 1, 0))
        hit = self.known[place] == h[at] if len(self.known) else np.zeros(len(at), bool)
        out[at[hit]] = place[hit]
        return out

    def dice(self, words: list[str], templates: list[int]) -> tuple[float, int] | None:
        """(coefficient, template) of the best of those templates whose sizes allow the threshold, the first of equals."""
        n, t, bag, best = len(words) - 1, self.threshold, None, None
        for k in templates:
            size = self.sizes[k]
            if n > 0 and size and t / (2 - t) * n <= size + 1e-9 and size <= (2 - t) / t * n + 1e-9:
                bag = Counter(zip(words, words[1:])) if bag is None else bag
                d = 2 * sum(min(c, bag[p]) for p, c in self.bags[k].items()) / (n + size)
                if d >= t and (best is None or d > best[0]):
                    best = (d, k)
        return best

    def units(self, text: str) -> Iterator[tuple[str, int, int]]:
        yield "text", 0, len(text)
        for name, end in ENDS:
            at = 0
            for m in end.finditer(text):
                yield name, at, m.start()
                at = m.end()
            yield name, at, len(text)

    def runs(self, hashes: WordHashes, text: str, templates: list[int]) -> Iterator[tuple[float, int, int, int]]:
        """(coefficient, template, start, end) of the best run of each licence; of a run only the best template counts."""
        parts = [(s, e, w) for unit, s, e in self.units(text) if unit == "sentence" and (w := normalised(text[s:e]))]
        last = np.cumsum([len(w) for _, _, w in parts])
        first = np.concatenate(([0], last[:-1]))
        pairs = self.bigrams(hashes, [x for _, _, w in parts for x in w])
        found: list[np.ndarray] = []
        for k in templates:
            size, least = self.sizes[k], int(self.least[k])
            most = int((2 - self.threshold) / self.threshold * size + 1e-9)
            times = self.counts[k][pairs]
            at = np.nonzero(times)[0]
            if len(at) < least:
                continue
            # A bigram counts in a run unless the run already has it as often as the template: `back` is where that occurrence is.
            order = np.argsort(pairs[at], kind="stable")
            kind = pairs[at][order]
            rank = np.arange(len(at)) - np.searchsorted(kind, kind)
            back = np.full(len(at), -1)
            full = np.nonzero(rank >= times[at][order])[0]
            back[order[full]] = at[order[full - times[at][order][full]]]
            low, high = np.searchsorted(at, first), np.searchsorted(at, first + most)
            for i in np.nonzero((high - low >= least) & (np.searchsorted(at, last) > low))[0].tolist():
                own = slice(low[i], high[i])
                shared = np.concatenate(([0], np.cumsum(back[own] < first[i])))
                j = np.arange(*np.searchsorted(last, (first[i] + least + 1, first[i] + most + 2)))
                d = 2 * shared[np.searchsorted(at[own], last[j] - 1)] / (last[j] - first[i] - 1 + size)
                good = d >= self.threshold
                if good.any():
                    found.append(np.stack([np.full(good.sum(), i), j[good], -d[good], np.full(good.sum(), k)]))
        if not found:
            return
        i, j, d, k = np.concatenate(found, axis=1)
        order = np.lexsort((k, d, j, i))
        order = order[np.concatenate(([True], (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)))]
        best: dict[str, tuple] = {}
        span = last[j[order].astype(int)] - first[i[order].astype(int)]
        for x in order[np.lexsort((i[order], -span, d[order]))].tolist():
            best.setdefault(self.names[int(k[x])], (-float(d[x]), int(k[x]), parts[int(i[x])][0], parts[int(j[x])][1]))
            if len(best) == len({self.names[t] for t in templates}):
                break
        yield from best.values()

    def scan(self, hashes: WordHashes, text: str | None) -> list[tuple[str, float, str, int, int]]:
        """(licence, dice, unit, start, end) of each licence found: its best unit, of equals that of most words, then the largest and first."""
        words = normalised(text or "")
        pairs = self.bigrams(hashes, words)
        pairs = pairs[pairs < len(self.known)]
        if len(pairs) < self.shared:
            return []
        # What all units of the text can share with a template at most.
        kinds, times = np.unique(pairs, return_counts=True)
        most_shared = np.minimum(self.counts[:, kinds], times).sum(axis=1)
        templates = np.nonzero((self.least > 0) & (most_shared >= self.least))[0].tolist()
        if not templates:
            return []
        best: dict[str, tuple[tuple[float, int], str, int, int]] = {}

        def offer(d: float, k: int, unit: str, start: int, end: int, n: int) -> None:
            if self.names[k] not in best or (d, n) > best[self.names[k]][0]:
                best[self.names[k]] = ((d, n), unit, start, end)

        most = max(self.sizes[k] for k in templates) * (2 - self.threshold) / self.threshold
        for unit, start, end in self.units(text):
            if unit == "text" and len(words) - 1 > most:
                continue
            own = normalised(text[start:end])
            if found := self.dice(own, templates):
                offer(*found, unit, start, end, len(own))
        for d, k, start, end in self.runs(hashes, text, templates):
            offer(d, k, "run", start, end, len(normalised(text[start:end])))
        return sorted((name, rank[0], *found) for name, (rank, *found) in best.items())


def licenses(documents: DataFrame, threshold: float = 0.8, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """(doc_id, license, dice, unit, start, end) for each row of documents(doc_id, text) and licence found in it.

    Of each unit the best template counts, of each licence the best unit; equals go to the unit of more words, then to the larger one, then to the first.
    start and end (exclusive) are code points. Null and empty texts, and texts of one word, hold no licence. Repeated rows are
    listed each, a null doc_id stays null. No rows give no rows; further columns are not read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(Scanner(templates, threshold))  # the templates, a few MB

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner, hashes = shared.value, WordHashes()
        for b in batches:
            out = [(None if pd.isna(d) else int(d), *found) for d, t in zip(b["doc_id"], b["text"]) for found in scanner.scan(hashes, t)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"doc_id": "Int64"})

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(each, SCHEMA)
