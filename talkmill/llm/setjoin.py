"""Set-similarity self-join of documents over word n-grams, by skipping work that sets' relations make needless.

Sets link when their Jaccard similarity is at least `percent`. With h for the size of the symmetric difference of sets of a and b
members, that is h * (100 + percent) <= (a + b) * (100 - percent). Sets are 64-bit hashes of their n-grams; equal sets are one class from the start.

**Lists.** Members have one order for all sets: in strata by hash, in each stratum the rarest first. A set emits whole strata until
it has as many members as its prefix is long (a quarter of a long set), so frequencies are counted over all sets but for a part of the
members. What one set alone has can meet nothing, yet it takes places of the prefix: most sets are out before any list is made.
An entry of an index list has the set's size and the member's place in the order.

**Blocks.** A list is cut into blocks by size and place. If sets first meet at places i and j, they share at most 1 + min(a - i - 1, b - j - 1) members, so
blocks of sizes or places that cannot link are skipped as a whole.

**Answers from a similar set's answers.** The sets of a list are first compared with one leader. Of two sets with differences s and t to the leader, each
other's difference is the symmetric difference of s and t: it is derived from the leader's answers, at the cost of what differs. Sets that link
with the leader are joined already, so a group of n near copies costs about n comparisons. What is left open: pairs of sets of short lists that
are still apart are compared if they meet often enough in their prefixes; long lists are compared block by block, where each block again has a leader.

Rounds of leaders are jobs over written tables; units of work have bounded numbers of members, however long a list is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.llm.shared import WordHashes, connected_components, ngram_hashes, union_find, written

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
STRATA = 4
#: Rounds of leaders before what is left is compared by pairs and in blocks.
ROUNDS = 2
#: Entries of a list up to which its pairs may be named, members of the sets of a block of a longer one, and how many sets meet one copy of their leader.
SMALL, BLOCK, SHARE = 128, 1 << 21, 1024


def ngram_set(hashes: WordHashes, text: str | None, n: int) -> np.ndarray:
    """The sorted hashes of the word n-grams of a text, A to Z in lower case; fewer words than that are one gram, none are no gram."""
    words = hashes((text or "").encode("utf-8", "surrogatepass").translate(LOWER).split())
    return np.unique(ngram_hashes(words, min(n, max(1, len(words)))))


def prefix_length(size: int, percent: int) -> int:
    """So many first members have one in common in any two sets that link: the overlap has percent of the size at least."""
    return size - -(-percent * size // 100) + 1 if size else 0


def linked(h: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes a and b with h members in just one of them link; exact in whole numbers."""
    return h * (100 + percent) <= (a + b) * (100 - percent)


def set_rows(documents: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, size, high, low, counts, members) of each row: the hash of the set in two halves, and the strata that it emits, with their sizes."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        hashes = WordHashes()
        for b in batches:
            out = []
            for text in b["text"]:
                own = ngram_set(hashes, text, n)
                digest = xxhash.xxh3_128_intdigest(own.tobytes())
                stratum, need, got = own % np.uint64(STRATA), prefix_length(len(own), percent), []
                for k in range(STRATA):
                    if sum(map(len, got)) >= need:
                        break
                    got.append(own[stratum == k])
                counts = [len(got[k]) if k < len(got) else 0 for k in range(STRATA)]
                out.append((len(own), digest >> 64, digest & (1 << 64) - 1, counts, np.concatenate([own[:0], *got]).tobytes()))
            size, high, low, counts, members = zip(*out) if out else ([],) * 5
            halves = [np.array(x, np.uint64).view(np.int64) for x in (high, low)]
            texts = {"counts": pd.Series(list(counts), dtype=object), "members": pd.Series(list(members), dtype=object)}
            yield pd.DataFrame({"doc_id": b["doc_id"], "size": np.array(size, np.int64), "high": halves[0], "low": halves[1], **texts})

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(each, "doc_id long, size long, high long, low long, counts array<int>, members binary")


def postings(classes: DataFrame) -> DataFrame:
    """(token, node): the emitted members of each class, a row each."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            held, nodes, total = [], [], 0
            for node, members in zip(b["node"].tolist(), b["members"]):
                held.append(np.frombuffer(members, np.int64))
                nodes.append(node)
                total += len(held[-1])
                if total > 1 << 18:
                    yield pd.DataFrame({"token": np.concatenate(held), "node": np.repeat(nodes, list(map(len, held)))})
                    held, nodes, total = [], [], 0
            if held:
                yield pd.DataFrame({"token": np.concatenate(held), "node": np.repeat(nodes, list(map(len, held)))})

    return classes.select("node", "members").mapInPandas(each, "token long, node long")


def index_lists(classes: DataFrame, percent: int) -> DataFrame:
    """(token, node, size, place, alone): the entries of the lists of two sets or more.

    place is the token's place in the set's order, alone the share (in thousandths) of the set's emitted members that no other set has.
    """
    rows = postings(classes)
    often = rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    shared = rows.join(often, "token")
    # The order of a set: strata first, then frequency, then the hash. An array is as long as the set's own emitted members.
    stratum = F.pmod("token", F.lit(STRATA))  # the remainder of the unsigned hash, as 2 ** 64 is a multiple
    ranked = shared.groupBy("node").agg(F.array_sort(F.collect_list(F.struct(stratum.alias("stratum"), "df", "token"))).alias("own"))
    need = (F.col("size") - F.ceil(F.lit(percent) * F.col("size") / 100) + 1).cast("int")
    rows = ranked.join(classes.select("node", "size", "counts", need.alias("need")), "node")
    # What a set has alone stands at the front of its stratum, so it moves the places of that stratum and of the later ones.
    alone = lambda k: F.get("counts", F.lit(k)) - F.size(F.filter("own", lambda e: e["stratum"] == k))
    moved = F.array(*(sum((alone(j) for j in range(k)), alone(k)) for k in range(STRATA)))
    rows = rows.withColumn("moved", moved).withColumn("alone", F.col("moved")[STRATA - 1] * 1000 / sum(F.get("counts", F.lit(k)) for k in range(STRATA)))
    at = lambda e, i: F.struct(e["token"].alias("token"), (F.get("moved", e["stratum"]) + i).cast("long").alias("place"))
    prefix = F.filter(F.transform("own", at), lambda e: e["place"] < F.col("need"))
    entries = rows.select("node", "size", F.col("alone").cast("int").alias("alone"), F.explode(prefix).alias("e"))
    entries = written(entries.select("e.token", "node", "size", "e.place", "alone"), "entries")
    many = entries.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token")
    return entries.join(many, "token", "left_semi")


def sets_of(documents: DataFrame, asked: DataFrame, n: int) -> DataFrame:
    """(node, members): the whole sets of the classes asked(node, rep, high, low), from the texts of their first documents."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        hashes = WordHashes()
        for b in batches:
            for text in b["text"]:  # one by one: a batch of texts may have very many members
                own = ngram_set(hashes, text, n)
                digest = xxhash.xxh3_128_intdigest(own.tobytes())
                halves = np.array([digest >> 64, digest & (1 << 64) - 1], np.uint64).view(np.int64)
                yield pd.DataFrame({"high": halves[:1], "low": halves[1:], "members": pd.Series([own.tobytes()], dtype=object)})

    texts = documents.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    texts = texts.join(asked.select("rep").distinct(), "rep", "left_semi").select("text")
    found = texts.mapInPandas(each, "high long, low long, members binary").join(asked.select("node", "high", "low"), ["high", "low"])
    # The first document's id may have rows with other texts, or the same text twice.
    return found.groupBy("node").agg(F.first("members").alias("members"))


def leader_pairs(entries: DataFrame, seed: int, percent: int) -> DataFrame:
    """(leader, node): each set of a list with the leader of its sizes and with that of the sizes above, where they are apart and may link.

    entries has (token, node, size, place, alone, component). In round 0 the leader is the set that has least alone: of a group of near copies
    that is the one nearest to their origin. Later rounds take any.
    """
    band = F.floor(F.log(F.col("size").cast("double")) / float(np.log(100 / percent))).cast("int")
    rows = entries.withColumn("band", band)
    rank = F.struct(*([F.col("alone")] if not seed else []), F.xxhash64("node", F.lit(seed)), F.col("node").alias("leader"), F.col("size").alias("a"), F.col("place").alias("i"), F.col("component").alias("own"))
    leaders = rows.groupBy("token", "band").agg(F.min(rank).alias("l")).select("token", "band", "l.leader", "l.a", "l.i", "l.own")
    asking = rows.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    pairs = asking.join(leaders, ["token", "band"]).where("component <> own")
    most = F.least(F.col("size") - F.col("place"), F.col("a") - F.col("i"))
    pairs = pairs.where(most * (100 + percent) >= (F.col("size") + F.col("a")) * percent)
    pairs = pairs.where((F.col("size") * 100 >= F.col("a") * percent) & (F.col("a") * 100 >= F.col("size") * percent))
    return pairs.select("leader", "node").distinct()


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): the pairs(leader, node) that link. A leader's set is copied once for SHARE others, so that no task gets all of a leader's sets."""
    parts = pairs.groupBy("leader").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("parts"))
    heads = parts.join(sets.withColumnRenamed("node", "leader"), "leader")
    heads = heads.select("leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("node"), "members")
    others = pairs.join(parts, "leader").select("leader", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "node")
    rows = heads.unionByName(others.join(sets, "node")).repartition("leader", "part").sortWithinPartitions("leader", "part", F.col("node").asc_nulls_first())

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head = None
        for b in batches:
            out = []
            for leader, node, members in zip(b["leader"].tolist(), b["node"], b["members"]):
                own = np.frombuffer(members, np.uint64)
                if pd.isna(node):
                    head = own
                elif linked(np.int64(len(head) + len(own) - 2 * common(head, own)), len(head), len(own), percent):
                    out.append((leader, int(node)))
            if out:
                yield pd.DataFrame(out, columns=["u", "v"])

    return rows.select("leader", F.col("node").cast("string").alias("node"), "members").mapInPandas(each, "u long, v long")


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many members two sorted sets share."""
    if not len(a):
        return 0
    return int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.setxor1d(a, b, assume_unique=True)


class Unit:
    """The links inside a list or between two of its blocks, of sets that are still apart: so many of them as join what they all join.

    sizes, places and component are arrays; side is 0 in a whole list, else 1 and 2 for the two blocks, which alone are compared.
    """

    def __init__(self, sets: list[np.ndarray], places: np.ndarray, component: np.ndarray, side: np.ndarray, percent: int, rows: int = 128, mass: int = 1 << 17):
        sizes = np.array([len(s) for s in sets], np.int64)
        # Blocks: sizes within about a hundredth, then places.
        order = np.lexsort((places, np.floor(np.log(np.maximum(sizes, 1)) * 100), side))
        self.order, self.sets, self.percent = order, [sets[k] for k in order], percent
        self.sizes, self.places, self.side = sizes[order], places[order].astype(np.int64), side[order]
        self.label = np.unique(component[order], return_inverse=True)[1]
        fine, heavy = np.floor(np.log(np.maximum(self.sizes, 1)) * 100), np.cumsum(self.sizes) // mass
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(fine) != 0) | (np.diff(heavy) != 0) | (np.diff(self.side) != 0)
        starts = np.nonzero(new)[0]
        cuts = [c for s, e in zip(starts, [*starts[1:], len(order)]) for c in range(s, e, rows)]
        self.blocks = [np.arange(s, e) for s, e in zip(cuts, [*cuts[1:], len(order)])]
        self.found: list[tuple[int, int]] = []

    def skipped(self, x: np.ndarray, y: np.ndarray) -> bool:
        """Whether no set of one block can link with one of the other: by sides, sizes and places, or as all are joined already."""
        if self.side[x[0]] and self.side[x[0]] == self.side[y[0]]:
            return True
        (a, b), (low_a, low_b) = (self.sizes[k].max() for k in (x, y)), (self.sizes[k].min() for k in (x, y))
        most = min((self.sizes[k] - self.places[k]).max() for k in (x, y))
        if low_b * self.percent > a * 100 or low_a * self.percent > b * 100 or most * (100 + self.percent) < (low_a + low_b) * self.percent:
            return True
        own = self.label[x[0]]
        return bool((self.label[x] == own).all() and (self.label[y] == own).all())

    def run(self) -> list[tuple[int, int]]:
        for k, x in enumerate(self.blocks):
            leader, own = self.sets[x[0]], None
            for y in self.blocks[k:]:
                if self.skipped(x, y):
                    continue
                own = [difference(leader, self.sets[i]) for i in x] if own is None else own
                self.derive(x, y, own, own if y is x else [difference(leader, self.sets[i]) for i in y])
        return [(int(self.order[i]), int(self.order[j])) for i, j in self.found]

    def derive(self, x: np.ndarray, y: np.ndarray, dx: list[np.ndarray], dy: list[np.ndarray]) -> None:
        """Links between blocks from the differences of their sets to one leader."""
        hx, hy = (np.array([len(d) for d in z], np.int64) for z in (dx, dy))
        a, b = self.sizes[x][:, None], self.sizes[y][None, :]
        far = self.label[x][:, None] != self.label[y][None, :]
        if y is x:
            far &= np.tri(len(x), k=-1, dtype=bool).T
        # What the leader's answers settle at once: the difference of two sets lies between the difference and the sum of theirs to the leader.
        self.join(x, y, far & linked(hx[:, None] + hy[None, :], a, b, self.percent))
        far &= self.label[x][:, None] != self.label[y][None, :]
        far &= linked(np.abs(hx[:, None] - hy[None, :]), a, b, self.percent)
        most = np.minimum((self.sizes - self.places)[x][:, None], (self.sizes - self.places)[y][None, :])
        far &= most * (100 + self.percent) >= (a + b) * self.percent
        r, c = np.nonzero(far.any(axis=1))[0], np.nonzero(far.any(axis=0))[0]
        if not len(r):
            return
        columns = np.unique(np.concatenate([dx[i] for i in r]))
        both = np.zeros((len(r), len(c)), np.int64)
        step = max(1, (1 << 23) // (len(r) + len(c)))
        for s in range(0, len(columns), step):
            both += (incidence([dx[i] for i in r], columns[s : s + step]) @ incidence([dy[j] for j in c], columns[s : s + step]).T).astype(np.int64)
        h = hx[r][:, None] + hy[c][None, :] - 2 * both
        hit = np.zeros_like(far)
        hit[np.ix_(r, c)] = linked(h, a[r], b[:, c], self.percent)
        self.join(x, y, far & hit)

    def join(self, x: np.ndarray, y: np.ndarray, hit: np.ndarray) -> None:
        """Takes links between rows that are still apart, one for each set of joined rows at a time."""
        r, c = np.nonzero(hit)
        r, c = x[r], y[c]
        while len(new := np.nonzero(self.label[r] != self.label[c])[0]):
            take = new[np.unique(self.label[r[new]], return_index=True)[1]]
            self.found += zip(r[take].tolist(), c[take].tolist())
            self.label = union_find(int(self.label.max()) + 1, zip(self.label[r[take]].tolist(), self.label[c[take]].tolist()))[self.label]


def incidence(sets: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
    """sets x columns: which of the sorted columns each set has."""
    out = np.zeros((len(sets), len(columns)), np.float32)
    for i, own in enumerate(sets):
        at = np.minimum(np.searchsorted(columns, own), len(columns) - 1)
        out[i, at[columns[at] == own]] = 1
    return out


def meetings(entries: DataFrame) -> DataFrame:
    """(u, v, a, b, i, j): pairs of sets of a list that are still apart, u < v, with their sizes and places; no list has over SMALL entries."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, names = None, ["token", "node", "size", "place", "component"]
        for last in (False, True):
            for b in batches if not last else [None]:
                held = [x for x in (rest, None if b is None else b[names].to_numpy()) if x is not None]
                if not held:
                    continue
                rows = np.concatenate(held)
                starts = np.nonzero(np.diff(rows[:, 0]))[0] + 1
                cut = len(rows) if last else int(starts[-1]) if len(starts) else 0
                rows, rest = rows[:cut], rows[cut:]
                for s in range(1, min(SMALL, len(rows))):
                    x, y = rows[:-s], rows[s:]
                    same = x[:, 0] == y[:, 0]
                    if not same.any():
                        break
                    keep = same & (x[:, 4] != y[:, 4])
                    x, y = x[keep], y[keep]
                    yield pd.DataFrame(np.concatenate([x[:, 1:4], y[:, 1:4]], axis=1), columns=["u", "a", "i", "v", "b", "j"])

    rows = entries.repartition("token").sortWithinPartitions("token", "node")
    pairs = rows.select("token", "node", "size", "place", "component").mapInPandas(each, "u long, a long, i long, v long, b long, j long")
    return pairs.select("u", "v", "a", "b", "i", "j")


def likely_pairs(entries: DataFrame, elsewhere: DataFrame | None, percent: int) -> DataFrame:
    """(leader, node): the pairs of short lists that may link, by where and how often they meet.

    Members that two sets share are among their meetings, or stand behind the last of them, or behind the end of one of the prefixes. elsewhere has
    (node, more): in how many long lists, whose pairs are not named here, a set is. A pair that first meets in a long list is compared there.
    """
    pairs = meetings(entries)
    pairs = pairs.where((F.col("a") * 100 >= F.col("b") * percent) & (F.col("b") * 100 >= F.col("a") * percent))
    pairs = pairs.groupBy("u", "v", "a", "b").agg(F.count("*").alias("c"), *(f(x).alias(f"{n}_{x}") for x in "ij" for n, f in (("first", F.min), ("last", F.max))))
    if elsewhere is None:
        pairs = pairs.withColumn("more", F.lit(0))
    else:
        for x in "uv":
            pairs = pairs.join(elsewhere.select(F.col("node").alias(x), F.col("more").alias(f"more_{x}")), x, "left")
        pairs = pairs.withColumn("more", F.least(F.coalesce("more_u", F.lit(0)), F.coalesce("more_v", F.lit(0))))
    behind = lambda x: F.ceil(F.col(x) * percent / 100) - 1  # of a set of that size, what its prefix leaves
    met = F.col("c") + F.col("more")
    most = F.least(
        F.least(F.col("a") - F.col("first_i"), F.col("b") - F.col("first_j")),
        met + F.least(F.col("a") - F.col("last_i"), F.col("b") - F.col("last_j")) - 1,
        met + F.greatest(behind("a"), behind("b")),
    )
    return pairs.where(most * (100 + percent) >= (F.col("a") + F.col("b")) * percent).select(F.col("u").alias("leader"), F.col("v").alias("node"))


def compared_at_last(entries: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): links that join all sets of the lists that are still apart and link; entries has (token, node, size, place, component)."""
    long = written(entries.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > SMALL).select("token"), "long-lists")
    if long.isEmpty():
        return compared(written(likely_pairs(entries, None, percent), "pairs"), sets, percent)
    inside = written(entries.join(long, "token", "left_semi"), "in-long-lists")
    more = inside.groupBy("node").agg(F.count("*").alias("more"))
    pairs = written(likely_pairs(entries.join(long, "token", "left_anti"), more, percent), "pairs")
    return compared(pairs, sets, percent).unionByName(compared_in_blocks(inside, sets, percent))


def compared_in_blocks(entries: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): links that join all sets of a list that are still apart and link, if the list is where they first meet.

    A list of over BLOCK members in all is cut by size, and by hash where many sets have one size, into blocks of about BLOCK; blocks
    that may link, by their sizes and places, are units of work, two by two.
    """
    total = written(entries.groupBy("token").agg(F.sum("size").alias("mass")).where(F.col("mass") > BLOCK).select("token"), "long-lists")
    unit = ["token", "ta", "tb", "side", "node", "place", "component"]
    zero = [F.lit(0).cast("long").alias(c) for c in ("ta", "tb")] + [F.lit(0).alias("side")]
    if total.isEmpty():
        rows = entries.select("token", *zero, "node", "place", "component")
    else:
        rows = entries.join(total, "token", "left_anti").select("token", *zero, "node", "place", "component")
        band = F.floor(F.log(F.col("size").cast("double")) / float(np.log(100 / percent))).cast("int")
        inside = entries.join(total, "token", "left_semi").withColumn("band", band)
        parts = inside.groupBy("token", "band").agg(F.ceil(F.sum("size") / BLOCK).cast("int").alias("parts"))
        inside = inside.join(parts, ["token", "band"]).withColumn("t", F.col("band") * 1_000_000 + F.pmod(F.xxhash64("node"), F.col("parts")))
        inside = written(inside.select("token", "t", "node", "size", "place", "component"), "in-long-lists")
        stats = [F.min("size").alias("low"), F.max("size").alias("high"), F.max(F.col("size") - F.col("place")).alias("left"), F.min("component").alias("first"), F.max("component").alias("last")]
        blocks = written(inside.groupBy("token", "t", F.expr("t div 1000000").alias("band")).agg(*stats), "blocks")
        other = blocks.select("token", F.col("t").alias("tb"), F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band"), *(F.col(c).alias(f"{c}_b") for c in ("low", "high", "left", "first", "last")))
        pairs = blocks.withColumnRenamed("t", "ta").join(other, ["token", "band"]).where("ta <= tb")
        pairs = pairs.where((F.col("low_b") * percent <= F.col("high") * 100) & (F.least("left", "left_b") * (100 + percent) >= (F.col("low") + F.col("low_b")) * percent))
        pairs = pairs.where("first <> last or first_b <> last_b or first <> first_b").select("token", "ta", "tb")
        a = inside.join(pairs.withColumn("t", F.col("ta")), ["token", "t"]).withColumn("side", F.when(F.col("ta") == F.col("tb"), 0).otherwise(1))
        b = inside.join(pairs.where("ta < tb").withColumn("t", F.col("tb")), ["token", "t"]).withColumn("side", F.lit(2))
        rows = rows.unionByName(a.select(unit)).unionByName(b.select(unit))
    rows = rows.join(sets, "node").repartition("token", "ta", "tb").sortWithinPartitions("token", "ta", "tb")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, key = None, ["token", "ta", "tb"]
        for last in (False, True):
            for b in batches if not last else [None]:
                held = [x for x in (rest, b) if x is not None]
                if not held:
                    continue
                own = pd.concat(held) if len(held) > 1 else held[0]
                of = own[key].to_numpy()
                starts = np.concatenate(([0], np.nonzero((of[1:] != of[:-1]).any(axis=1))[0] + 1, [len(own)] if last else [])).astype(int)
                node, place, component, side, members = (own[c].to_numpy() for c in ("node", "place", "component", "side", "members"))
                for s, e in zip(starts[:-1], starts[1:]):
                    if e - s > 1:
                        links = Unit([np.frombuffer(m, np.uint64) for m in members[s:e]], place[s:e], component[s:e], side[s:e], percent).run()
                        if links:
                            u, v = np.array(links).T + s
                            yield pd.DataFrame({"u": node[u], "v": node[v]})
                rest = own.iloc[starts[-1] :] if not last else None

    return rows.select(*unit, "members").mapInPandas(each, "u long, v long")


def open_lists(entries: DataFrame, components: DataFrame | None) -> DataFrame:
    """The entries, with the component of their sets, of the lists whose sets are not all joined."""
    if components is None:
        return entries.withColumn("component", F.col("node"))
    rows = entries.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    apart = rows.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("token")
    return rows.join(apart, "token", "left_semi")


def joined_by_leaders(links: DataFrame) -> DataFrame:
    """(node, component) of the sets that link with a leader: sets with one component are connected. Not all connected sets have one, but this is a job, not many."""
    first = links.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component"))
    second = first.select(F.col("node").alias("component"), F.col("component").alias("further"))
    return first.join(second, "component", "left").select("node", F.coalesce("further", "component").alias("component"))


def similar_sets(documents: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of documents(doc_id, text).

    The set of a text is that of its word n-grams (words end at blanks, tabs and line ends; A to Z in lower case); fewer words are one gram as
    a whole. Sets link at a Jaccard similarity of at least percent / 100, compared in whole numbers; component_id is the smallest doc_id
    that links reach. Null, empty and blank texts have no gram and link with nothing, each other included. Equal texts are one class, however
    many there are. A row without doc_id links nothing and has no component. Repeated rows and ids stay as they are; each row links by its
    own text. No rows give no rows; further columns are not read. Members are 64-bit hashes.
    """
    fps = written(set_rows(documents, n, percent), "set-rows")
    own = fps.where("doc_id is not null and size > 0").groupBy("size", "high", "low")
    classes = own.agg(F.min("doc_id").alias("rep"), F.first("counts").alias("counts"), F.first("members").alias("members"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    entries = written(index_lists(classes, percent), "lists")
    sets = written(sets_of(documents, classes.join(entries.select("node").distinct(), "node", "left_semi"), n), "sets")
    links = components = None
    for k in range(ROUNDS + 1):
        left = written(open_lists(entries, components), "open-lists")
        if left.isEmpty():
            break
        found = compared_at_last(left, sets, percent) if k == ROUNDS else compared(written(leader_pairs(left, k, percent), "pairs"), sets, percent)
        found = written(found, "links")
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            components = written(connected_components(links, "stars") if k == ROUNDS else joined_by_leaders(links), "components")
    roots = classes.select("node", "size", "high", "low", "rep")
    roots = roots.withColumn("component", F.col("node")) if components is None else roots.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    roots = written(roots, "roots")
    least = roots.groupBy("component").agg(F.min("rep").alias("component_id"))
    found = roots.join(least, "component").select("size", "high", "low", "component_id")
    rows = fps.join(found, ["size", "high", "low"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"))
