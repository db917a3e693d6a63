"""Substring dedup: passages that repeat across documents.

Two kinds of passage are banded, joined and verified:

* Paragraphs (lines) by MinHash over their word shingles. The bands are tuned for a high recall at the similarity asked
  for; paragraphs that meet in a band are compared by exact Jaccard, in tiles where many meet, and links form components.
* Pieces between content-defined breaks, for passages inside other paragraphs or across line ends. A break is a word
  whose hash is the least in its surroundings, so a passage breaks alike wherever it stands. Pieces have one band, the hash
  of all their words, as only equal ones are wanted. Where marked pieces end, the words beside them are compared with the
  keeper's, so that a passage is marked from its first word to its last.

The smallest doc_id of each component keeps its passage. In other documents the marked words are joined to spans, and
spans of at least `min_words` words are removals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.llm.shared import WordHashes, connected_components, ngram_hashes, similar_forest, written

#: Code points that str.split() parts words at.
BLANKS = np.zeros(0x3002, bool)
BLANKS[[c for c in range(0x3001) if chr(c).isspace()]] = True
NEWLINE = 10
UNIT = "kind string, doc_id long, word int, n_words int, start int, n_chars int, h1 long, h2 int, shingles array<int>, bands array<long>"
ARROW = pa.schema([
    ("kind", pa.string()), ("doc_id", pa.int64()), *((c, pa.int32()) for c in ("word", "n_words", "start", "n_chars")),
    ("h1", pa.int64()), ("h2", pa.int32()), ("shingles", pa.list_(pa.int32())), ("bands", pa.list_(pa.int64())),
])


def bands_for(similarity: float, recall: float = 0.99, rows: int = 3) -> tuple[int, int]:
    """(bands, rows of a band) such that a pair at the similarity meets with at least that probability."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows))), rows


def places(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, line) of each word, in code points."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    blank = BLANKS[np.minimum(points, len(BLANKS) - 1)]
    edge = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
    start, end = np.nonzero(edge < 0)[0], np.nonzero(edge > 0)[0]
    return start, end, np.searchsorted(np.nonzero(points == NEWLINE)[0], start)


def breaks(words: np.ndarray, radius: int) -> np.ndarray:
    """Where pieces begin: the first word, and each word whose bigram hash is the least within the radius."""
    grams = ngram_hashes(words, 2)
    if len(grams) <= 2 * radius:
        return np.zeros(min(len(words), 1), np.int64)
    around = np.lib.stride_tricks.sliding_window_view(grams, radius)
    inner = grams[radius:-radius]
    least = (inner < around[: len(inner)].min(axis=1)) & (inner <= around[radius + 1 : radius + 1 + len(inner)].min(axis=1))
    return np.concatenate(([0], np.nonzero(least)[0] + radius))


def sequence_hashes(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each word sequence."""
    out = []
    for radix in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        up, down = np.full(len(words) + 1, radix, np.uint64), np.full(len(words) + 1, pow(radix, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        sums = np.concatenate(([np.uint64(0)], np.cumsum(words * np.cumprod(up)[:-1], dtype=np.uint64)))
        h = (sums[end] - sums[start]) * np.cumprod(down)[start] + (end - start).astype(np.uint64)
        out.append(((h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64))
    return out[0], out[1]


def minhash_bands(shingles: np.ndarray, offsets: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash for each paragraph and band, over the band and `rows` minima. offsets: where each paragraph's shingles begin."""
    rng = np.random.default_rng(5)
    out = np.tile(np.arange(bands, dtype=np.uint64), (len(offsets), 1))
    for band in range(bands):
        for _ in range(rows):
            a, b = rng.integers(1, 1 << 62, 2, dtype=np.uint64)
            h = (shingles ^ b) * (a << np.uint64(1) | np.uint64(1))
            out[:, band] = out[:, band] * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(h ^ (h >> np.uint64(32)), offsets)
    return out.view(np.int64)


def _units(min_words: int, shingle: int, similarity: float, radius: int):
    """mapInArrow over (doc_id, text): the pieces and the paragraphs of at least min_words words."""
    bands, rows = bands_for(similarity)

    def of(doc: int, words: np.ndarray, at: tuple, first: np.ndarray, last: np.ndarray) -> list:
        h1, h2 = sequence_hashes(words, first, last)
        return [np.full(len(first), doc), first, last - first, at[0][first], at[1][last - 1] - at[0][first], h1, h2 >> 32]

    def table(kind: str, parts: list[list], lists: list[pa.Array] | None = None) -> pa.RecordBatch:
        columns = [np.concatenate(x) for x in zip(*parts)]
        kinds = [np.int64, np.int32, np.int32, np.int32, np.int32, np.int64, np.int32]
        flat = [pa.array(x.astype(k)) for x, k in zip(columns, kinds)]
        n = len(columns[0])
        return pa.RecordBatch.from_arrays([pa.array([kind]).take(pa.array(np.zeros(n, np.int8))), *flat, *(lists or [pa.nulls(n, f.type) for f in ARROW][-2:])], schema=ARROW)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            pieces, lines, sets = [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = hashes((text or "").lower().split())
                if doc is None or len(words) == 0:
                    continue
                at = places(text)
                first = breaks(words, radius)
                pieces.append(of(doc, words, at, first, np.append(first[1:], len(words))))
                first = np.concatenate(([0], np.nonzero(np.diff(at[2]))[0] + 1))
                last = np.append(first[1:], len(words))
                first, last = first[last - first >= min_words], last[last - first >= min_words]
                if len(first):
                    lines.append(of(doc, words, at, first, last))
                    grams = ngram_hashes(words, shingle)
                    sets += [np.unique(grams[i : j - shingle + 1]) for i, j in zip(first.tolist(), last.tolist())]
            if pieces:
                yield table("piece", pieces)
            if lines:
                flat, ends = np.concatenate(sets), np.cumsum([len(s) for s in sets])
                starts = np.concatenate(([0], ends[:-1]))
                keys = minhash_bands(flat, starts, bands, rows)
                lists = [
                    pa.ListArray.from_arrays(pa.array(np.append(starts, len(flat)).astype(np.int32)), pa.array((flat >> np.uint64(32)).astype(np.uint32).view(np.int32))),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), pa.array(keys.ravel())),
                ]
                yield table("line", lines, lists)

    return each


def _alike(similarity: float):
    """mapInPandas over rows sorted by unit (key, ta, tb): a spanning forest of the verified links inside each unit."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, unit = None, ["key", "ta", "tb"]
        for last in (False, True):
            for b in batches if not last else [None]:
                rows = pd.concat([x for x in (rest, b) if x is not None]) if (rest is not None or b is not None) else None
                if rows is None or not len(rows):
                    continue
                key = rows[unit].to_numpy()
                starts = np.concatenate(([0], np.nonzero((key[1:] != key[:-1]).any(axis=1))[0] + 1, [len(rows)] if last else [])).astype(int)
                ids, side, shingles = rows["id"].to_numpy(), rows["side"].to_numpy(), rows["shingles"].to_list()
                found = []
                for s, t in zip(starts[:-1], starts[1:]):
                    if t - s == 2:  # most units
                        a, b = shingles[s:t]
                        both = len(np.intersect1d(a, b, assume_unique=True))
                        if (side[s] != side[s + 1] or not side[s]) and both >= similarity * (len(a) + len(b) - both):
                            found.append((ids[s : s + 1], ids[s + 1 : t]))
                    elif t - s > 2:
                        meets = lambda r, c: (side[s:t][r] != side[s:t][c]) | (side[s:t][r] == 0)  # noqa: B023, E731
                        found.append(similar_forest(ids[s:t], np.arange(t - s), shingles[s:t], similarity, meets))
                rest = rows.iloc[starts[-1] :]
                if found:
                    yield pd.DataFrame(dict(zip("uv", map(np.concatenate, zip(*found)))))

    return each


def paragraph_links(lines: DataFrame, similarity: float, tile: int = 1024) -> DataFrame:
    """(u, v): links that join all paragraphs (h1, shingles, bands) which meet in a band and have that Jaccard similarity.

    Repeated rows are one paragraph. A bucket over `tile` rows is dealt by hash into parts; each pair of parts is a unit of
    work of its own.
    """
    met = lines.select("h1", F.explode("bands").alias("key"))
    sizes = met.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high"), F.count("*").alias("n")).where("low < high")
    sizes = written(sizes.select("key", F.ceil(F.col("n") / tile).cast("int").alias("parts")), "buckets")
    rows = written(met.join(sizes, "key").distinct(), "met")
    shingles = lines.join(rows.select("h1").distinct(), "h1", "left_semi").groupBy("h1").agg(F.min("shingles").alias("shingles"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("h1"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "key", F.least("part", "other").alias("ta"), F.greatest("part", "other").alias("tb"),
        F.when(F.col("part") == F.col("other"), 0).when(F.col("part") < F.col("other"), 1).otherwise(2).alias("side"), F.col("h1").alias("id"),
    )
    # Inside a unit of two parts only links between them count; those inside a part belong to the part's own unit.
    touched = rows.join(written(shingles, "shingles").withColumnRenamed("h1", "id"), "id")
    touched = touched.repartition("key", "ta", "tb").sortWithinPartitions("key", "ta", "tb")
    return touched.mapInPandas(_alike(similarity), "u long, v long")


def merged_runs(marks: list[tuple]) -> Iterator[tuple]:
    """(first, last, start, end, kept_in, left, right) of marks (first, last, start, end, kept_in, left, right) in order, where those that touch are one."""
    run = None
    for m in marks:
        if run is not None and m[0] <= run[1]:
            if m[1] > run[1]:
                run[1], run[6] = m[1], m[6]
            run[3] = max(run[3], m[3])
            run[4] |= set(m[4])
        else:
            if run is not None:
                yield tuple(run)
            run = [*m[:4], set(m[4]), *m[5:]]
    if run is not None:
        yield tuple(run)


RUN = "doc_id long, first int, last int, start int, end int, kept_in array<long>, left_doc long, left_at int, right_doc long, right_at int"


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """mapInPandas over (doc_id, marks): marks that touch become runs; left and right say where the keeper has its edges, if it has equal words there."""
    for b in batches:
        out = []
        for doc, marks in zip(b["doc_id"], b["marks"]):
            own = []
            for m in marks:
                first, last, start = m["word"], m["word"] + m["n_words"], m["start"]
                piece = m["at"] is not None
                own.append((first, last, start, start + m["n_chars"], [int(m["keeper"])], (m["keeper"], m["at"]) if piece else (None, None), (m["keeper"], m["at"] + m["n_words"]) if piece else (None, None)))
            out += [(doc, *run[:4], sorted(run[4]), *run[5], *run[6]) for run in merged_runs(own)]
        yield pd.DataFrame(out, columns=[c.split()[0] for c in RUN.split(", ")]).astype({c: "Int64" for c in ("left_doc", "left_at", "right_doc", "right_at")})


def _contexts(radius: int):
    """mapInPandas over (doc_id, text, asked): the words before (way -1, the nearest first) or after each place, up to a little beyond the next break, and their outer edges."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batches:
            out = []
            for doc, text, asked in zip(b["doc_id"], b["text"], b["asked"]):
                words = hashes((text or "").lower().split())
                at, cuts = places(text or ""), np.append(breaks(words, radius), len(words))
                for x in asked:
                    place, way = int(x["at"]), int(x["way"])
                    if place > len(words):
                        continue  # of another text with that doc_id
                    if way > 0:
                        end = min(int(cuts[min(np.searchsorted(cuts, place, "right"), len(cuts) - 1)]) + 2 * radius, len(words))
                        own, edge = words[place:end], at[1][place:end]
                    else:
                        begin = max(int(cuts[max(np.searchsorted(cuts, place, "left") - 1, 0)]) - 2 * radius, 0)
                        own, edge = words[begin:place][::-1], at[0][begin:place][::-1]
                    out.append((doc, place, way, own.view(np.int64), edge.astype(np.int32)))
            yield pd.DataFrame(out, columns=["doc_id", "at", "way", "words", "edges"])

    return each


def extended(documents: DataFrame, runs: DataFrame, radius: int) -> DataFrame:
    """runs (of `_runs`), each as far to the left and right as the document's words equal the keeper's there.

    Runs of a doc_id with several texts stay as they are.
    """
    here = [("left", -1, "first"), ("right", 1, "last")]
    asks = None
    for side, way, own in here:
        for doc, at in (("doc_id", own), (f"{side}_doc", f"{side}_at")):
            rows = runs.where(F.col(f"{side}_doc").isNotNull()).select(F.col(doc).alias("doc_id"), F.col(at).alias("at"), F.lit(way).alias("way"))
            asks = rows if asks is None else asks.unionByName(rows)
    asks = asks.distinct().groupBy("doc_id").agg(F.collect_list(F.struct("at", "way")).alias("asked"))  # two for each word of the document at most
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(written(asks, "asks"), "doc_id").mapInPandas(_contexts(radius), "doc_id long, at int, way int, words array<long>, edges array<int>")
    once = found.groupBy("doc_id", "at", "way").agg(F.min("words").alias("words"), F.min("edges").alias("edges"), F.count("*").alias("n"))
    contexts = written(once.where("n = 1").drop("n"), "contexts")
    for side, way, own in here:
        mine = contexts.where(F.col("way") == way).select("doc_id", F.col("at").alias(own), F.col("words").alias("w"), F.col("edges").alias("e"))
        theirs = contexts.where(F.col("way") == way).select(F.col("doc_id").alias(f"{side}_doc"), F.col("at").alias(f"{side}_at"), F.col("words").alias("k"))
        runs = runs.join(mine, ["doc_id", own], "left").join(theirs, [f"{side}_doc", f"{side}_at"], "left")
        unlike = F.array_position(F.zip_with("w", "k", lambda x, y: x.eqNullSafe(y)), False)
        more = F.coalesce(F.when(unlike == 0, F.size("w")).otherwise(unlike - 1), F.lit(0)).cast("int")
        runs = runs.withColumn("more", more)
        edge = F.when(F.col("more") > 0, F.element_at("e", F.greatest("more", F.lit(1))))
        runs = runs.withColumns({own: (F.col(own) + way * F.col("more")).cast("int"), ("start" if way < 0 else "end"): F.coalesce(edge, F.col("start" if way < 0 else "end"))}).drop("w", "k", "e", "more")
    return runs


def _spans(min_words: int):
    """mapInPandas over (doc_id, runs): runs that touch become spans; those of fewer words go."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, runs in zip(b["doc_id"], b["runs"]):
                own = [(r["first"], r["last"], r["start"], r["end"], [int(k) for k in r["kept_in"]], None, None) for r in runs]
                out += [(doc, s[2], s[3], s[1] - s[0], sorted(s[4])) for s in merged_runs(own) if s[1] - s[0] >= min_words]
            yield pd.DataFrame(out, columns=["doc_id", "start", "end", "n_words", "kept_in"])

    return each


def repeated_passages(documents: DataFrame, min_words: int = 20, shingle: int = 5, similarity: float = 0.8, radius: int = 5) -> DataFrame:
    """(doc_id, start, end, n_words, kept_in): the spans of documents(doc_id, text) that repeat a document of smaller id.

    start and end (exclusive) are code points; kept_in lists the documents that keep the passages. Equal passages of at least
    min_words words that hold a whole piece are found wherever they stand, from their first word to their last (of a passage of
    50 words one in some thousands holds none); near-duplicate paragraphs (lines of at least min_words words, that
    Jaccard similarity) with the recall of `bands_for`. Repeats inside one document stay. Rows of one doc_id
    are one document, and spans of equal rows are listed once; where its texts differ, spans end with whole pieces. Rows without doc_id take no part. Null and empty texts have
    no passages. Paragraphs are told apart by 64-bit hashes, pieces by 96-bit ones. No rows give no rows; further columns are not read.
    """
    units = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_units(min_words, shingle, similarity, radius), UNIT)
    units = written(units, "passages", ["kind"])
    place = ["doc_id", "word", "n_words", "start", "n_chars"]

    pieces = units.where("kind = 'piece'").select("h1", "h2", *place)
    held = pieces.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "word")).alias("k"), F.max("doc_id").alias("most"))
    held = written(held.where("k.doc_id < most").select("h1", "h2", F.col("k.doc_id").alias("keeper"), F.col("k.word").alias("at")), "pieces")
    marks = pieces.join(held, ["h1", "h2"]).where("keeper < doc_id").select(*place, "keeper", "at")

    lines = units.where("kind = 'line'").select("h1", "shingles", "bands", *place)
    components = written(connected_components(paragraph_links(lines, similarity), "paragraph-stars"), "components")
    classes = lines.groupBy("h1").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("most"))
    classes = classes.join(components.withColumnRenamed("node", "h1"), "h1", "left").withColumn("component", F.coalesce("component", "h1"))
    classes = written(classes, "classes")
    keepers = classes.groupBy("component").agg(F.min("first").alias("keeper"), F.max("most").alias("last")).where("keeper < last")
    classes = written(classes.join(written(keepers, "keepers"), "component").select("h1", "keeper"), "kept")
    marks = marks.unionByName(lines.join(classes, "h1").where("keeper < doc_id").select(*place, "keeper", F.lit(None).cast("int").alias("at")))

    mark = F.struct("word", "n_words", "start", "n_chars", "keeper", "at")
    gathered = marks.groupBy("doc_id").agg(F.array_sort(F.collect_set(mark)).alias("marks"))
    runs = extended(documents, written(gathered.mapInPandas(_runs, RUN), "runs"), radius)
    gathered = runs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("first", "last", "start", "end", "kept_in"))).alias("runs"))
    return gathered.mapInPandas(_spans(min_words), "doc_id long, start long, end long, n_words long, kept_in array<long>")


def without_repeats(documents: DataFrame, **options) -> DataFrame:
    """documents with those spans cut out of `text`; other columns stay. Rows of one doc_id with different texts stay whole."""
    found = repeated_passages(documents, **options).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_spans"))
    single = documents.groupBy("doc_id").agg((F.min(F.xxhash64("text")) == F.max(F.xxhash64("text"))).alias("_one"))
    found = found.join(single.where("_one"), "doc_id").select(F.col("doc_id").alias("_d"), "_spans")
    state = F.struct(F.lit(0).cast("long").alias("to"), F.lit("").alias("out"))
    cut = lambda s, p: F.struct(p["end"].alias("to"), F.concat(s["out"], F.substring("text", (s["to"] + 1).cast("int"), (p["start"] - s["to"]).cast("int"))).alias("out"))
    rest = lambda s: F.concat(s["out"], F.substring("text", (s["to"] + 1).cast("int"), F.char_length("text")))
    rows = documents.join(found, documents["doc_id"] == found["_d"], "left")
    kept = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(F.aggregate("_spans", state, cut, rest))
    return rows.select(*(kept.alias(c) if c == "text" else documents[c] for c in documents.columns))
