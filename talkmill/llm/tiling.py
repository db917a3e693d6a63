"""Benchmark decontamination by greedy string tiling.

The word n-grams of the test items are the seeds. A document's words are hashed once; where its n-grams meet seeds, the
document and the item are tiled: the longest common run of unmarked words is found by running Karp-Rabin (a rolling hash at
a search length, which bisection raises or lowers), all its non-overlapping occurrences are marked, and so on down to
the least tile. The share of the item's words under tiles is its coverage. Tiles may stand in any order, so
reordered passages are caught.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import batched, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.llm.shared import WordHashes, ngram_hashes, scratch_dir

#: Blocks of items that are broadcast and looked for in one pass over the documents.
PASS = 4
WORD = re.compile(r"\w+")
RADIX = 0x9E3779B97F4A7C15
INVERSE = pow(RADIX, -1, 1 << 64)
SCHEMA = "doc_id long, row long, item_id long, item_words int, covered_words int, coverage double, n_tiles int, longest_tile int, start long, end long"


def words_of(text: str | None) -> list[str]:
    """Runs of letters, digits and underscores, in lower case."""
    return WORD.findall((text or "").lower())


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Run:
    """A word sequence with marks, and its Karp-Rabin hashes at any length."""

    def __init__(self, words: np.ndarray):
        self.words, self.marked = words, np.zeros(len(words), bool)
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum(words * _powers(RADIX, len(words)), dtype=np.uint64)))
        self.back = _powers(INVERSE, len(words))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of the runs of n unmarked words."""
        if len(self.words) < n:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        marks = np.concatenate(([0], np.cumsum(self.marked)))
        at = np.nonzero(marks[n:] == marks[:-n])[0]
        return at, (self.sums[at + n] - self.sums[at]) * self.back[at]


def tiles(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start in item, start in document, words) of the tiles, longest first."""
    a, b = Run(item), Run(doc)

    def common(n: int) -> bool:
        return bool(np.isin(a.grams(n)[1], b.grams(n)[1]).any())

    out, longest = [], min(len(item), len(doc))
    while longest >= least and common(least):
        low, high = least, longest
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if common(middle) else (low, middle - 1)
        before = len(out)
        at, hashes = b.grams(low)
        places: dict[int, list[int]] = {}
        for p, h in zip(at[::-1].tolist(), hashes[::-1].tolist()):
            places.setdefault(h, []).append(p)  # the first place last
        for i, h in zip(*(x.tolist() for x in a.grams(low))):
            while (rest := places.get(h)) and not a.marked[i : i + low].any():
                j = rest.pop()
                if not b.marked[j : j + low].any() and (a.words[i : i + low] == b.words[j : j + low]).all():
                    a.marked[i : i + low] = b.marked[j : j + low] = True
                    out.append((i, j, low))
        # Without a tile, all that met at this length were collisions of hashes.
        longest = low if len(out) > before else low - 1
    return out


class Seeds:
    """The n-grams of a block of items, sorted, with the item and the place of each."""

    def __init__(self, items: list[tuple[int, np.ndarray]], least: int):
        self.items = items
        parts = [(ngram_hashes(w, min(least, len(w))), i) for i, (_, w) in enumerate(items) if len(w)]
        sizes = {i: min(least, len(w)) for i, (_, w) in enumerate(items) if len(w)}
        self.lengths = sorted(set(sizes.values()))
        self.by_length = {}
        for n in self.lengths:
            own = [(h, i) for h, i in parts if sizes[i] == n]
            h = np.concatenate([x for x, _ in own])
            item = np.concatenate([np.full(len(x), i, np.int64) for x, i in own])
            place = np.concatenate([np.arange(len(x)) for x, _ in own])
            order = np.argsort(h, kind="stable")
            seen = np.zeros(1 << 20, bool)
            seen[(h >> np.uint64(44)).astype(np.int64)] = True
            self.by_length[n] = (h[order], item[order], place[order], seen)

    def found(self, words: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(index of the item, seed length, places in item, places in document) of each item that shares seeds."""
        for n, (h, item, place, seen) in self.by_length.items():
            grams = ngram_hashes(words, n)
            at = np.nonzero(seen[(grams >> np.uint64(44)).astype(np.int64)])[0]
            low, high = np.searchsorted(h, grams[at], "left"), np.searchsorted(h, grams[at], "right")
            at, low, high = at[high > low], low[high > low], high[high > low]
            if not len(at):
                continue
            # One hit for each distinct gram of the document is enough to know the items and their places.
            distinct = np.unique(np.stack([low, high], 1), axis=0)
            seeds = np.concatenate([np.arange(x, y) for x, y in distinct])
            for i in np.unique(item[seeds]):
                mine = seeds[item[seeds] == i]
                own = np.zeros(len(h) + 1, np.int64)
                own[mine] = 1
                own = np.concatenate(([0], np.cumsum(own)))
                yield int(i), n, place[mine], at[own[high] > own[low]]


def spread(places: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of `size` words lie under n-grams at the places."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, places, 1)
    np.add.at(edge, np.minimum(places + n, size), -1)
    return np.cumsum(edge)[:size] > 0


def compare(seeds: Seeds, words: np.ndarray, threshold: float) -> Iterator[tuple[int, int, int, int, int, int, int]]:
    """(item, item words, covered, tiles, longest, first and last word in the document) of items covered enough."""
    for i, n, item_at, doc_at in seeds.found(words):
        name, item = seeds.items[i]
        if spread(item_at, n, len(item)).sum() < threshold * len(item):
            continue
        # Words outside all seed hits are in no tile; one separator stands for each run of them.
        under = np.nonzero(spread(doc_at, n, len(words)))[0]
        gaps = np.nonzero(np.diff(under) > 1)[0] + 1
        place = np.insert(under, gaps, -1)
        doc = np.where(place >= 0, words[place], np.uint64(0))
        doc[place < 0] = np.arange(1, len(gaps) + 1, dtype=np.uint64)
        found = tiles(item, doc, n)
        covered = sum(t for *_, t in found)
        if covered >= threshold * len(item):
            yield name, len(item), covered, len(found), max(t for *_, t in found), min(int(place[j]) for _, j, _ in found), max(int(place[j + t - 1]) for _, j, t in found)


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes = WordHashes()
    for b in batches:
        yield pd.DataFrame({"item_id": b["item_id"], "words": [hashes(words_of(t)).view(np.int64) for t in b["text"]]})


def blocks_of(benchmark: DataFrame, max_words: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """The items, with their word hashes, in blocks of at most about max_words words (one item at least). The driver holds one block."""
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    block, size = [], 0
    for r in items.mapInPandas(_hashed, "item_id long, words array<long>").toLocalIterator():
        words = np.array(r[1], np.int64).view(np.uint64)
        if block and size + len(words) > max_words:
            yield block
            block, size = [], 0
        block.append((r[0], words))
        size += len(words)
    if block:
        yield block


def contaminated(documents: DataFrame, benchmark: DataFrame, least: int = 5, threshold: float = 0.5, max_words: int = 2_000_000) -> DataFrame:
    """(doc_id, row, item_id, item_words, covered_words, coverage, n_tiles, longest_tile, start, end) of contaminated pairs.

    A pair is listed if tiles of at least `least` words (the whole item, if shorter) cover at least that share of
    the item's words. start and end (exclusive) are the words of the document from the first tile to the last. Items come in blocks of at
    most max_words words, of which PASS at most are broadcast at a time, so what is broadcast has a bound; each PASS blocks take one pass over all documents. Null and empty
    documents and items without words match nothing; null item ids take no part; different texts of one
    item id count each. Repeated rows are listed each; a null doc_id stays null. `row` is the hash of the text, which
    tells rows of one doc_id apart. No documents or no items give no rows; further columns are not read.
    """
    spark, path, found = documents.sparkSession, None, None
    rows = documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), F.col("text").cast("string"))
    for blocks in batched(blocks_of(benchmark, max_words), PASS):
        if found is not None:  # passes follow one another; each leaves its rows in the shared folder
            path = path or f"{scratch_dir(spark)}/contaminated-{uuid.uuid4().hex}"
            found.write.mode("append").parquet(path)
        shared = spark.sparkContext.broadcast([Seeds(block, least) for block in blocks])

        def each(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            hashes = WordHashes()
            for b in batches:
                out = []
                for doc, row, text in zip(b["doc_id"], b["row"], b["text"]):
                    words = hashes(words_of(text))
                    for seeds in shared.value:
                        for i, n, covered, count, longest, start, end in compare(seeds, words, threshold):
                            out.append((None if pd.isna(doc) else int(doc), row, i, n, covered, covered / n, count, longest, start, end + 1))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"doc_id": "Int64"})

        found = rows.mapInPandas(each, SCHEMA)
    if found is None:
        return spark.createDataFrame([], SCHEMA)
    if path is None:
        return found
    found.write.mode("append").parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


def decontaminated(documents: DataFrame, benchmark: DataFrame, least: int = 5, threshold: float = 0.5, max_words: int = 2_000_000) -> DataFrame:
    """documents without the rows that `contaminated` would list, all columns as they are.

    Items of up to PASS blocks, as benchmarks mostly have, are looked for while documents pass by once. More of them are looked for in
    passes that read, and write what they find; the rows found then go in one join. documents are never written.
    """
    spark, column = documents.sparkSession, documents.columns.index("text")
    blocks = list(islice(blocks_of(benchmark, max_words), PASS + 1))
    if len(blocks) > PASS:
        found = contaminated(documents, benchmark, least, threshold, max_words).select(F.col("doc_id").alias("_found_id"), F.col("row").alias("_found_row")).distinct()
        same = documents["doc_id"].cast("long").eqNullSafe(found["_found_id"]) & (F.xxhash64(documents["text"]) == found["_found_row"])
        return documents.join(found, same, "left_anti")
    shared = spark.sparkContext.broadcast([Seeds(block, least) for block in blocks])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(50_000)
        for b in batches:
            clean = []
            for text in b.column(column).to_pylist():
                words = hashes(words_of(text))
                clean.append(not any(next(compare(seeds, words, threshold), None) for seeds in shared.value))
            yield b.filter(pa.array(clean, pa.bool_()))

    return documents.mapInArrow(each, documents.schema) if blocks else documents
