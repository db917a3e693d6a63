"""What several training-data operators use: written intermediates, word hashes, components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir`, or one of our own where it is unset and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="talkmill-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cuts the lineage: `df` as Parquet in the shared folder, read again."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files behind a DataFrame of `written` that no later plan reads."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def hot_join(left: DataFrame, right: DataFrame, key: str, total: int, share: int = 1024) -> DataFrame:
    """Inner join on `key`. right has one row a key and `n`, how many rows of left have it; left has `total` rows.

    Keys of over a `share`-th of the rows are `share` at most; they are broadcast, so that no task gets all rows of a hot key.
    """
    hot = F.col("n") > max(share, total // share)
    heavy, rest = right.where(hot).drop("n"), right.where(~hot).drop("n")
    return left.join(F.broadcast(heavy), key).unionByName(left.join(F.broadcast(heavy.select(key)), key, "left_anti").join(rest, key))


def connected_components(edges: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of the edges (u, v); component is the smallest node reached.

    Large-star and small-star rounds (Kiveris et al., 2014). Each round's stars are written to the
    shared folder, so that a lost executor costs one round. Nulls and loops link nothing; nodes
    without an edge are not returned. Raises if `max_rounds` do not suffice.
    """
    pair = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    pair = pair.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    stars = written(pair.distinct(), name)
    for k in range(max_rounds + 1):
        ends = stars.select(F.explode(F.array(*(F.struct(F.col(c).alias("node"), F.lit(c == "u").cast("int").alias("up")) for c in "uv"))).alias("e"))
        ends = ends.groupBy("e.node").agg(F.sum("e.up").alias("up"), F.count("*").alias("n"))
        total, most = ends.agg(F.sum("up"), F.max(F.when(F.col("up") > 0, F.col("n")))).first()
        if (most or 0) <= 1:
            break  # each upper node has one edge, to a node without a lower one: what is left are the components' stars
        if k == max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        # Large star: each upper neighbour w of a node u moves to the least node around u.
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        upper = stars.select(F.col("v").alias("u"), F.col("u").alias("w"))
        large = written(hot_join(upper, least, "u", total).select(F.col("w").alias("u"), F.col("m").alias("v")).distinct(), name)
        # Small star: the lower neighbours of a node, and the node itself, move to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = hot_join(large.withColumnRenamed("v", "w"), low, "u", total)
        small = small.where("w <> m").select(F.col("w").alias("u"), F.col("m").alias("v"))
        after = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), name)
        discard(stars)
        discard(large)
        stars = after
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


class WordHashes:
    """64-bit hashes of words, remembered in a bounded table.

    XXH3 over the UTF-8 bytes, so that all executors agree.
    """

    def __init__(self, limit: int = 200_000):
        import xxhash

        self.digest, self.limit, self.known = xxhash.xxh3_64_intdigest, limit, {}

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.limit:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.digest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n word hashes (none, if there are fewer words)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += words[k : k + m]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def similar_forest(ids: np.ndarray, group: np.ndarray, sets: list[np.ndarray], similarity: float, meets=None, block: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of different groups whose sets (sorted arrays) have that Jaccard similarity.

    Rows of the largest group are not compared with each other; meets(r, c), of places in the arrays, tells which pairs count. A block
    of rows has 256 rows and about `block` members at most (one row at least), so the memory is bounded by the sets themselves.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    own = [sets[k] for k in order]
    sizes, label = np.array([len(s) for s in own]), np.unique(group[order], return_inverse=True)[1]
    free = label != np.bincount(label).argmax()
    loose, fixed, at, out = np.nonzero(free)[0], np.nonzero(~free)[0], 0, ([], [])

    def dense(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        flat = np.concatenate([own[k] for k in rows])
        place = np.minimum(np.searchsorted(columns, flat), max(len(columns) - 1, 0))
        hit = columns[place] == flat if len(columns) else np.zeros(len(flat), bool)
        full = np.zeros((len(rows), len(columns)), np.float32)
        full[np.repeat(np.arange(len(rows)), sizes[rows])[hit], place[hit]] = 1
        return full

    while at < len(loose):
        head = loose[at : at + max(1, int(np.searchsorted(np.cumsum(sizes[loose[at : at + 256]]), block, "right")))]
        at += len(head)
        columns = np.unique(np.concatenate([own[k] for k in head]))
        full = dense(head, columns)
        # Sets much smaller or larger cannot reach the similarity. Free rows before the head have met it already.
        low = int(np.searchsorted(sizes, sizes[head[0]] * similarity - 1e-6, "left"))
        high = int(np.searchsorted(sizes, sizes[head[-1]] / similarity + 1e-6, "right"))
        others = np.concatenate([fixed[np.searchsorted(fixed, low) : np.searchsorted(fixed, head[0])], np.arange(head[0], high)])
        for j in range(0, len(others), 256):
            tail = others[j : j + 256]
            if (label[tail] == label[head[0]]).all() and (label[head] == label[head[0]]).all():
                continue
            both = (full @ dense(tail, columns).T).astype(np.int64)
            r, c = np.nonzero(both >= similarity * (sizes[head, None] + sizes[None, tail] - both))
            r, c = head[r], tail[c]
            keep = (r != c) if meets is None else (r != c) & meets(order[r], order[c])
            r, c = r[keep], c[keep]
            while len(new := np.nonzero(label[r] != label[c])[0]):
                take = new[np.unique(label[r[new]], return_index=True)[1]]
                out[0].append(ids[order[r[take]]])
                out[1].append(ids[order[c[take]]])
                label = union_find(int(label.max()) + 1, zip(label[r[take]].tolist(), label[c[take]].tolist()))[label]
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in out)


def union_find(n: int, pairs) -> np.ndarray:
    """Roots of 0..n-1 under the index pairs; a root is the smallest index of its set."""
    root = np.arange(n)
    for a, b in pairs:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        while root[b] != b:
            root[b] = root[root[b]]
            b = root[b]
        if a != b:
            root[max(a, b)] = min(a, b)
    while (root[root] != root).any():
        root = root[root]
    return root
