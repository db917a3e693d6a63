"""SimHash near-duplicates: fingerprints, tiled exact comparison, components.

A fingerprint is one or more 64-bit words. Two fingerprints link if they differ in at most `radius` bits. Equal ones meet by
grouping. Different ones are compared in tiles: numpy's exclusive-or and bit counts over blocks of sorted fingerprints, where
blocks whose population counts differ by more than the radius are skipped.

Which tiles meet: a cell is a set of bit places, and fingerprints that agree in them meet there. For 64 bits and a small radius,
any two fingerprints within the radius agree on some two of the `radius + 2` blocks of bits, so the pairs of blocks are cells that
find every link (`exact_cells`). For a wide radius the cells are random bit places (`sampled_cells`), the same ones for every table.
A cell over `tile` rows is cut by population count and hash into tiles, whose pairs are separate units of work. Pairs of small units
are emitted once, in the first cell where they agree; of the links of a larger unit a spanning forest is, closest first, so that a group of n
copies gives about n rows.

Where links are verified by Jaccard similarity, a forest of unverified ones could lose pairs. So trees of
few links are emitted whole. The others are named: if all links of such a tree pass, it loses nothing, and
if one fails, all pairs of its documents that are still apart are compared, and the forest is of links that passed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.llm.shared import WordHashes, connected_components, ngram_hashes, similar_forest, union_find, written

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
CHUNK = 1 << 16
#: Words that a task remembers while it makes sets of shingles.
WORDS = 50_000
#: Rows of a unit up to which all of its pairs may be emitted.
SMALL = 32
#: Words of the wide fingerprints, and the bits and the number of their cells. Texts of Jaccard similarity 0.8 differ in about 29
#: of 192 bits (standard deviation 5) and meet in some cell with a chance of 0.99, at every size of the table.
WIDE, CELL_BITS, CELLS = 3, 14, 64


def fingerprint(text: str | None, shingle: int) -> int:
    """The fingerprint over the XXH64 (seed 42) of the word shingles, repeats included; fewer words than that: of the whole sequence; none: 0."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    count = max(1, len(words) - shingle + 1)
    starts, ends = starts[:count].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for k in range(0, count, CHUNK):
        ones += set_bits(np.array([digest(joined[a:b], 42) for a, b in zip(starts[k : k + CHUNK], ends[k : k + CHUNK])], np.uint64))
    return int(packed_bits(2 * ones > count)[0])


def set_bits(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set."""
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def packed_bits(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, bitorder="little").view(np.int64)


def shingle_set(hashes: WordHashes, text: str | None, shingle: int) -> np.ndarray:
    """The sorted hashes of the word shingles of a text; fewer words than that are one shingle."""
    words = hashes((text or "").lower().split())
    return np.unique(ngram_hashes(words, min(shingle, max(1, len(words)))))


def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """WIDE words over a set of shingles, each counted once; the words after the first are of mixed hashes, which draw other bits."""
    out = np.zeros(WIDE, np.int64)
    h = shingles
    for i in range(WIDE):
        ones = np.zeros(64, np.int64)
        for k in range(0, len(h), CHUNK):
            ones += set_bits(h[k : k + CHUNK])
        out[i] = packed_bits(2 * ones > len(h))[0]
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return out


def set_hash(shingles: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes())).view(np.int64))


def fingerprints(documents: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, fp) of each row; those of a null or empty text are 0."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": np.array([fingerprint(t, shingle) for t in b["text"]], np.int64)})

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(each, "doc_id long, fp long")


def set_fingerprints(documents: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, row, node, fp0 ...): row is the hash of the text, node that of its set of shingles, which the fingerprint is of."""
    names = [f"fp{i}" for i in range(WIDE)]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes(WORDS)
        for b in batches:
            sets = [shingle_set(hashes, t, shingle) for t in b["text"]]
            wide = np.array([wide_fingerprint(s) for s in sets], np.int64).reshape(len(b), WIDE)
            yield pd.DataFrame({"doc_id": b["doc_id"], "row": b["row"], "node": np.array([set_hash(s) for s in sets], np.int64), **dict(zip(names, wide.T))})

    rows = documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), F.col("text").cast("string"))
    return rows.mapInPandas(each, "doc_id long, row long, node long, " + ", ".join(f"{c} long" for c in names))


def exact_cells(radius: int) -> np.ndarray:
    """Bit masks (cells x 1 word) such that fingerprints within the radius agree under one of them: pairs of radius + 2 blocks."""
    edges = np.linspace(0, 64, radius + 3).round().astype(int)
    blocks = [sum(1 << b for b in range(s, e)) for s, e in zip(edges[:-1], edges[1:])]
    return np.array([[a | b] for a, b in combinations(blocks, 2)], np.uint64)


def sampled_cells(words: int = WIDE, bits: int = CELL_BITS, cells: int = CELLS, seed: int = 11) -> np.ndarray:
    """Masks (cells x words) of random bit places. Their number and width are parameters and do not follow the table."""
    rng, out = np.random.default_rng(seed), np.zeros((cells, words), np.uint64)
    for c in range(cells):
        for b in rng.choice(64 * words, bits, replace=False).tolist():
            out[c, b // 64] |= np.uint64(1 << b % 64)
    return out


def distances(x: np.ndarray) -> np.ndarray:
    """How many bits are set in each row of words."""
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int16)


def near(a: np.ndarray, b: np.ndarray, radius: int, same: bool, tile: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The links between two tiles (rows x words) sorted by population count, block by block: indices into a and b, and the distances."""
    pa, pb = distances(a), distances(b)
    for i in range(0, len(a), tile):
        for j in range(i if same else 0, len(b), tile):
            x, y = slice(i, i + tile), slice(j, j + tile)
            if pb[y][0] - pa[x][-1] > radius or pa[x][0] - pb[y][-1] > radius:
                continue
            d = sum(np.bitwise_count(a[x, None, w] ^ b[None, y, w]) for w in range(a.shape[1]))
            r, c = np.nonzero(d <= radius)
            if same and i == j:
                r, c = r[r < c], c[r < c]
            yield r + i, c + j, d[r, c]


def links(a: np.ndarray, b: np.ndarray, radius: int, same: bool, tile: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A spanning forest, closest first in each block, of the links between two tiles sorted by population count.

    Returns indices into a and b, the tree of each row (of a, then of b if that is another tile), and how many links each row of a has.
    """
    shift = 0 if same else len(a)
    label = np.arange(len(b) + shift)
    count = np.zeros(len(label), np.int64)
    kept: list[np.ndarray] = []
    for r, c, d in near(a, b, radius, same, tile):
        count += np.bincount(r, minlength=len(count))
        for step in np.unique(d):
            at = np.nonzero(d == step)[0]
            while len(at := at[label[r[at]] != label[c[at] + shift]]):
                # One link for each set of rows; whole blocks of links inside a set fall away at once.
                take = at[np.unique(label[r[at]], return_index=True)[1]]
                kept.append(np.stack([r[take], c[take]]))
                label = union_find(len(label), zip(label[r[take]].tolist(), label[c[take] + shift].tolist()))[label]
    out = np.concatenate(kept, axis=1) if kept else np.empty((2, 0), np.int64)
    return out[0], out[1], label, count


def close_pairs(fp: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows of one (small) group within the radius; rows of a group stand together."""
    out = [], []
    for s in range(1, len(group)):
        at = np.nonzero(group[s:] == group[:-s])[0]
        if not len(at):
            break
        at = at[distances(fp[at] ^ fp[at + s]) <= radius]
        out[0].append(at)
        out[1].append(at + s)
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in out)


def first_met(x: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """The first cell in which the fingerprints of each pair agree; x: the differing bits of the pairs."""
    out = np.full(len(x), len(masks))
    for c in range(len(masks) - 1, -1, -1):
        out[((x & masks[c]) == 0).all(axis=1)] = c
    return out


def _units(radius: int, masks: np.ndarray, named: bool):
    """mapInPandas over rows sorted by unit: the links inside each unit, which is a tile or a pair of tiles.

    Named: trees of at most two links a row come with all their links, the links of others with the tree's name.
    """
    import xxhash

    def large(unit: tuple[int, ...], fp: np.ndarray, node: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, ...] | None:
        order = np.argsort(distances(fp), kind="stable")
        fp, node, side = fp[order], node[order], side[order]
        a, b = (side == 0, side == 0) if not side[0] else (side == 1, side == 2)
        if not a.any() or not b.any():
            return None
        same = not side[0]
        x, y, label, count = links(fp[a], fp[b], radius, same)
        tree = np.zeros(len(x), np.int64)
        if named and count.sum() > len(x):
            shift = 0 if same else int(a.sum())
            rows, total = np.bincount(label, minlength=len(label)), np.bincount(label, count, len(label))
            dense, thinned = total > 2 * rows, total > rows - 1
            names = {k: xxhash.xxh64_intdigest(f"{unit}:{k}") >> 1 for k in np.nonzero(dense)[0].tolist()}
            tree = np.array([names.get(k, 0) for k in label[x].tolist()], np.int64)
            at = np.nonzero((thinned & ~dense)[label])[0]
            if len(at):
                in_a, in_b = at[at < int(a.sum())], at[at >= shift] - shift
                more = [(in_a[r], in_b[c]) for r, c, _ in near(fp[a][in_a], fp[b][in_b], radius, same)]
                # What the forest has of these trees gives way to all their links.
                keep = ~(thinned & ~dense)[label[x]]
                x, y = (np.concatenate([z[keep], *w]) for z, w in zip((x, y), zip(*more)))
                tree = np.concatenate([tree[keep], np.zeros(len(x) - int(keep.sum()), np.int64)])
        return node[a][x], node[b][y], tree, np.full(len(x), not same)

    def small(cell: np.ndarray, unit: np.ndarray, fp: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, ...]:
        i, j = close_pairs(fp, unit, radius)
        own = first_met(fp[i] ^ fp[j], masks) == cell[i]
        i, j = i[own], j[own]
        return node[i], node[j], np.zeros(len(i), np.int64), np.zeros(len(i), bool)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, words = None, [f"fp{i}" for i in range(masks.shape[1])]
        for last in (False, True):
            for batch in batches if not last else [None]:
                now = [] if rest is None else [rest]
                if batch is not None:
                    now.append([*(batch[c].to_numpy() for c in ("cell", "key", "ta", "tb", "side", "node")), batch[words].to_numpy(np.int64).view(np.uint64)])
                if not now:
                    continue
                cell, key, ta, tb, side, node, fp = rows = [np.concatenate(x) for x in zip(*now)]
                new = (cell[1:] != cell[:-1]) | (key[1:] != key[:-1]) | (ta[1:] != ta[:-1]) | (tb[1:] != tb[:-1])
                starts = np.concatenate(([0], np.nonzero(new)[0] + 1, [len(cell)] if last else [])).astype(int)
                sizes, found = np.diff(starts), []
                for k in np.nonzero((sizes > SMALL) | ((sizes > 1) & (side[starts[:-1]] > 0)))[0].tolist():
                    s, e = starts[k], starts[k + 1]
                    found.append(large((int(cell[s]), int(key[s]), int(ta[s]), int(tb[s])), fp[s:e], node[s:e], side[s:e]))
                few = (sizes > 1) & (sizes <= SMALL) & (side[starts[:-1]] == 0)
                at = np.nonzero(np.repeat(few, sizes))[0]
                found.append(small(cell[at], np.repeat(np.arange(len(sizes)), sizes)[at], fp[at], node[at]))
                rest = [x[starts[-1] :] for x in rows]
                found = [x for x in found if x is not None and len(x[0])]
                if found:
                    yield pd.DataFrame(dict(zip(("u", "v", "tree", "crossing"), map(np.concatenate, zip(*found)))))

    return each


def near_links(reps: DataFrame, radius: int, masks: np.ndarray, tile: int = 4096, named: bool = False) -> DataFrame:
    """(u, v, tree, crossing): links that join the distinct fingerprints within the radius; reps has (node, fp0 ...).

    Named: trees of few links are whole; of the others, tree has a name (else 0), and crossing tells whether u and v are of
    two tiles, so that links inside the tiles belong to other units.
    """
    words = [f"fp{i}" for i in range(masks.shape[1])]
    pop = sum((F.bit_count(w) for w in words), F.lit(0))
    signed = masks.view(np.int64).tolist()
    keys = [F.struct(F.lit(i).cast("short").alias("cell"), F.xxhash64(F.lit(i), *(F.col(w).bitwiseAND(F.lit(m)) for w, m in zip(words, own) if m)).alias("key")) for i, own in enumerate(signed)]
    spread = reps.select("node", *words, F.explode(F.array(*keys)).alias("c")).select("c.cell", "c.key", "node", *words)
    # Cells over `tile` rows lie in slices over `tile` rows; only the cells of those slices are counted. At most 1,024 slices a cell.
    slices = spread.groupBy("cell", F.pmod("key", F.lit(1024)).alias("slice")).agg(F.count("*").alias("n")).where(F.col("n") > tile).drop("n")
    inside = spread.withColumn("slice", F.pmod("key", F.lit(1024))).join(F.broadcast(written(slices, "slices")), ["cell", "slice"], "left_semi")
    large = written(inside.groupBy("cell", "key").agg(F.count("*").alias("n")).where(F.col("n") > tile).select("cell", "key"), "large-cells")
    unit = ["cell", "key", "ta", "tb", "side", "node", *words]
    zero = [F.lit(0).alias(c) for c in ("ta", "tb", "side")]
    rows = spread
    if some := not large.isEmpty():
        rows = spread.join(large, ["cell", "key"], "left_anti")
    rows = rows.select("cell", "key", *zero, "node", *words)
    if some:
        # Tiles of a large cell: by population count, then by hash into parts of about `tile` rows.
        inside = written(spread.join(large, ["cell", "key"]).withColumn("pop", pop), "in-large-cells")
        by_pop = inside.groupBy("cell", "key", "pop").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
        parts = by_pop.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        parts = written(parts.select("cell", "key", "pop", "parts", (F.col("pop") * 1_000_000 + F.col("part")).alias("t")), "tiles")
        other = parts.select("cell", "key", F.col("pop").alias("pop_b"), F.col("t").alias("tb"))
        pairs = parts.withColumnRenamed("t", "ta").join(other, ["cell", "key"])
        pairs = pairs.where((F.col("ta") <= F.col("tb")) & (F.col("pop_b") - F.col("pop") <= radius)).select("cell", "key", "ta", "tb")
        inside = inside.join(parts.select("cell", "key", "pop", "parts").distinct(), ["cell", "key", "pop"])
        inside = inside.withColumn("t", F.col("pop") * 1_000_000 + F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        a = inside.join(pairs.withColumn("t", F.col("ta")), ["cell", "key", "t"]).withColumn("side", F.when(F.col("ta") == F.col("tb"), 0).otherwise(1))
        b = inside.join(pairs.where("ta < tb").withColumn("t", F.col("tb")), ["cell", "key", "t"]).withColumn("side", F.lit(2))
        rows = rows.unionByName(a.select(unit)).unionByName(b.select(unit))
    rows = rows.repartition("cell", "key", "ta", "tb").sortWithinPartitions("cell", "key", "ta", "tb")
    return rows.mapInPandas(_units(radius, masks, named), "u long, v long, tree long, crossing boolean")


def _alike(similarity: float, shingle: int):
    """mapInPandas over (u, v, tu, tv): the pairs whose word shingles have that Jaccard similarity."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes(WORDS)
        for b in batches:
            last, sets, keep = None, None, []
            for u, tu, tv in zip(b["u"], b["tu"], b["tv"]):
                if u != last:
                    last, sets = u, shingle_set(hashes, tu, shingle)
                other = shingle_set(hashes, tv, shingle)
                both = len(np.intersect1d(sets, other, assume_unique=True))
                keep.append(both >= similarity * (len(sets) + len(other) - both))
            yield b.loc[np.array(keep, bool), ["u", "v"]]

    return each


def _texts(shingle: int, sets: bool):
    """mapInPandas over (text) or (node, text): (node, text), or (node, shingles, n)."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes(WORDS)
        for b in batches:
            own = [shingle_set(hashes, t, shingle) for t in b["text"]]
            node = np.array([set_hash(s) for s in own], np.int64)
            yield pd.DataFrame({"node": node, "shingles": [s.view(np.int64) for s in own], "n": [len(s) for s in own]}) if sets else pd.DataFrame({"node": node, "text": b["text"].to_numpy()})

    return each


def _among(similarity: float):
    """mapInPandas over rows sorted by (tree, pa, pb): the verified links inside each tree."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, unit = None, ["tree", "pa", "pb"]
        for last in (False, True):
            for b in batches if not last else [None]:
                rows = pd.concat([x for x in (rest, b) if x is not None]) if (rest is not None or b is not None) else None
                if rows is None or not len(rows):
                    continue
                key = rows[unit].to_numpy()
                starts = np.concatenate(([0], np.nonzero((key[1:] != key[:-1]).any(axis=1))[0] + 1, [len(rows)] if last else [])).astype(int)
                for s, e in zip(starts[:-1], starts[1:]):
                    node, component, side, part = (rows[c].to_numpy()[s:e] for c in ("node", "component", "side", "part"))
                    apart = bool((part != part[0]).any())  # pairs inside a part belong to the part's own unit
                    meets = lambda r, c: ((side[r] != side[c]) | (side[r] == 0)) & ((part[r] != part[c]) | (not apart))  # noqa: B023, E731
                    u, v = similar_forest(node, component, rows["shingles"].iloc[s:e].to_list(), similarity, meets)
                    if len(u):
                        yield pd.DataFrame({"u": u, "v": v})
                rest = rows.iloc[starts[-1] :]

    return each


def verified(documents: DataFrame, reps: DataFrame, found: DataFrame, shingle: int, similarity: float, most: int = 1 << 22) -> DataFrame:
    """(u, v): links of that Jaccard similarity that join all candidate pairs which reach it.

    found is of `near_links`, named; reps has (node, rep), rep being a doc_id whose row has the node's shingles. Trees of over `most`
    shingles are dealt into parts, whose pairs are units of work.
    """
    found = written(found.distinct(), "candidates")
    ends = [F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")]
    touched = written(found.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "touched")
    asked = reps.join(touched, "node", "left_semi").select(F.col("rep").alias("d")).distinct()
    texts = documents.select(F.col("doc_id").cast("long").alias("d"), F.col("text").cast("string").alias("text")).join(asked, "d").select("text")
    texts = texts.mapInPandas(_texts(shingle, False), "node long, text string").join(touched, "node", "left_semi")
    texts = written(texts.groupBy("node").agg(F.min("text").alias("text")), "texts")
    pairs = found.select(*ends).distinct().join(texts.select(F.col("node").alias("u"), F.col("text").alias("tu")), "u")
    pairs = pairs.join(texts.select(F.col("node").alias("v"), F.col("text").alias("tv")), "v")
    alike = written(pairs.select("u", "v", "tu", "tv").mapInPandas(_alike(similarity, shingle), "u long, v long"), "links")
    named = found.where("tree <> 0")
    failed = written(named.select("tree", *ends).join(alike, ["u", "v"], "left_anti").select("tree").distinct(), "failed")
    if failed.isEmpty():
        return alike
    side = lambda n: F.when(F.col("crossing"), n).otherwise(0).alias("side")
    both = F.array(F.struct(F.col("u").alias("node"), side(1)), F.struct(F.col("v").alias("node"), side(2)))
    members = named.join(failed, "tree", "left_semi").select("tree", F.explode(both).alias("m")).select("tree", "m.node", "m.side").distinct()
    components = connected_components(alike, "verified-stars")
    members = members.join(components, "node", "left").select("tree", "node", "side", F.coalesce("component", "node").alias("component"))
    members = written(members, "members")
    open_trees = members.groupBy("tree").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("tree")
    members = written(members.join(open_trees, "tree", "left_semi"), "open-members")
    sets = texts.join(members.select("node").distinct(), "node", "left_semi")
    sets = written(sets.select("text").mapInPandas(_texts(shingle, True), "node long, shingles array<long>, n long"), "sets")
    parts = members.join(sets.select("node", "n"), "node").groupBy("tree").agg(F.ceil(F.sum("n") / most).cast("int").alias("parts"))
    rows = members.join(written(parts.where("parts > 1"), "parts"), "tree", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("tree", F.least("part", "other").alias("pa"), F.greatest("part", "other").alias("pb"), "node", "side", "component", "part")
    rows = rows.join(sets, "node").repartition("tree", "pa", "pb").sortWithinPartitions("tree", "pa", "pb")
    return alike.unionByName(rows.mapInPandas(_among(similarity), "u long, v long"))


def _hex(word: str) -> Column:
    return F.lower(F.lpad(F.hex(word), 16, "0"))


def near_duplicates(documents: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of documents(doc_id, text), by 64-bit fingerprints.

    component_id is the smallest doc_id among the documents that links reach; a radius up to 6 is exact.
    Null and empty texts have fingerprint zero and link like any other. A row without doc_id keeps its fingerprint, links
    nothing and has no component. Repeated rows and ids stay as they are; each row links by its own
    text. No rows give no rows; further columns are not read.
    """
    if not 0 <= radius <= 6:
        raise ValueError("cells are exact for a radius of 0 to 6")
    fps = written(fingerprints(documents, shingle), "fingerprints")
    reps = written(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "representatives")
    found = near_links(reps.select(F.col("rep").alias("node"), F.col("fp").alias("fp0")), radius, exact_cells(radius))
    components = connected_components(found.select("u", "v"), "stars")
    classes = reps.join(components, reps["rep"] == components["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    rows = fps.join(classes, "fp", "left")
    return rows.select("doc_id", _hex("fp").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def similar_documents(documents: DataFrame, similarity: float = 0.8, shingle: int = 5, radius: int = 48) -> DataFrame:
    """(doc_id, row, fingerprint, component_id) for each row of documents(doc_id, text): near-duplicates by verified Jaccard similarity.

    Texts link if the sets of their word shingles have that Jaccard similarity. Candidates are wide fingerprints over those sets
    that differ in at most `radius` of 192 bits and meet in one of CELLS cells of CELL_BITS random bits, which are the same for every table; each
    row is judged by its own text. component_id is the smallest doc_id among the documents that links reach, row the hash of
    the text. Null and empty texts have no shingles and are all alike. A row without doc_id links nothing and has no component.
    Repeated rows and ids stay as they are. No rows give no rows; further columns are not read.
    """
    words = [f"fp{i}" for i in range(WIDE)]
    fps = written(set_fingerprints(documents, shingle), "fingerprints")
    reps = fps.where("doc_id is not null").groupBy("node", *words).agg(F.min("doc_id").alias("rep"))
    reps = written(reps, "representatives")
    found = near_links(reps.select("node", *words), radius, sampled_cells(), named=True)
    components = connected_components(verified(documents, reps, found, shingle, similarity), "stars")
    classes = written(reps.join(components, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component")), "classes")
    least = classes.groupBy("component").agg(F.min("rep").alias("component_id"))
    classes = classes.join(least, "component").select("node", "component_id")
    rows = fps.join(classes, "node", "left")
    return rows.select(
        "doc_id", "row", F.concat(*map(_hex, words)).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )


def keep_one(documents: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """documents without the rows of `similar_documents` whose component has a smaller doc_id; columns stay as they are.

    Equal rows of the smallest doc_id all stay, and so do rows without doc_id.
    """
    found = similar_documents(documents, similarity, shingle)
    drop = found.where("component_id < doc_id").select(F.col("doc_id").alias("d"), F.col("row").alias("r")).distinct()
    same = (documents["doc_id"].cast("long") == drop["d"]) & (F.xxhash64(documents["text"]) == drop["r"])
    return documents.join(drop, same, "left_anti").select(documents.columns)
