"""Exact top-k inner products by columnar branch-and-bound.

Queries come in blocks of a fixed size. A pass over the candidates takes a fixed number of blocks, broadcast to its tasks. A task
keeps its candidates in vertical layout, one array per dimension, and accumulates the products a block
of dimensions at a time. After each block, a candidate whose partial product plus the remaining mass
(Cauchy-Schwarz over the dimensions to come) cannot reach the k-th best score is dropped and the
survivors are compacted. Each task returns k rows a query; the last step ranks those.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkmill.llm.shared import scratch_dir

PARTIAL = "query_id long, vec_id long, score long"


def scaled(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component; vectors null, empty or with null or non-finite components go."""
    x = F.transform(F.col("embedding"), lambda e: e.cast("double"))
    whole = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull())
    kept = kept.where(whole & (F.size("x") > 0))
    return kept.select("vec_id", F.transform("x", lambda e: F.floor(e * scale)).alias("v"))


class Best:
    """The k best (score, smaller id first) of each query so far, as a task has seen them."""

    def __init__(self, queries: int, k: int):
        self.k, self.rows = k, [(np.empty(0, np.int64), np.empty(0, np.int64))] * queries
        self.floor = np.full(queries, -np.inf)

    def add(self, q: int, score: np.ndarray, vec: np.ndarray) -> None:
        score, vec = np.concatenate([self.rows[q][0], score]), np.concatenate([self.rows[q][1], vec])
        order = np.lexsort((vec, -score))[: self.k]
        self.rows[q] = (score[order], vec[order])
        if len(order) == self.k:
            # As a float, a little low, so that a large score that rounds up does not shut out its equals.
            least = float(self.rows[q][0][-1])
            self.floor[q] = least - abs(least) * 1e-15


def search_tile(ids: np.ndarray, tile: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, best: Best, step: int) -> None:
    """Adds a tile of candidates (dimensions x rows) to the best of the queries (dimensions x queries)."""
    dims = len(tile)
    mass = lambda m: np.sqrt(np.cumsum((m.astype(np.float64) ** 2)[::-1], axis=0)[::-1])
    left, left_q = mass(tile), mass(queries)
    first = tile[:step].T @ queries[:step]
    for q, query in enumerate(query_ids):
        alive, part = np.nonzero(ids != query)[0], None
        part = first[alive, q]
        for at in range(step, dims + step, step):
            if at >= dims:
                break
            # The slack covers the rounding of the roots and, of large components, of the products.
            bound = left[at, alive] * left_q[at, q]
            keep = part + bound + 1 + 1e-12 * (np.abs(part) + bound) >= best.floor[q]
            alive, part = alive[keep], part[keep]
            if not len(alive):
                break
            part = part + queries[at : at + step, q] @ tile[at : at + step, alive]
        if len(alive):
            good = part >= best.floor[q]
            best.add(q, part[good].astype(np.int64), ids[alive[good]])


def passes(asked: DataFrame, dims: int, n: int, block: int, blocks: int, kind: type) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """The n queries of a length, as lists of at most about `blocks` blocks of (ids, dimensions x queries)."""
    count = -(-n // (block * blocks))
    for i in range(count):
        own = asked.where((F.col("d") == dims) & (F.pmod(F.xxhash64("vec_id"), F.lit(count)) == i)).drop("d").toPandas().sort_values("vec_id")
        parts = (own.iloc[at : at + block] for at in range(0, len(own), block))
        if out := [(p["vec_id"].to_numpy(np.int64), np.ascontiguousarray(np.stack([np.asarray(v, np.int64) for v in p["v"]]).T, kind)) for p in parts]:
            yield out


def partial_best(candidates: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], k: int, tile: int, step: int, kind: type) -> DataFrame:
    """(query_id, vec_id, score): of each task the k best candidates of each query."""
    shared = candidates.sparkSession.sparkContext.broadcast(queries)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = [Best(len(ids), k) for ids, _ in shared.value]
        for b in batches:
            for at in range(0, len(b), tile):
                rows = b.iloc[at : at + tile]
                ids, columns = rows["vec_id"].to_numpy(np.int64), np.ascontiguousarray(np.stack([np.asarray(v, np.int64) for v in rows["v"]]).T, kind)
                for (query_ids, matrix), own in zip(shared.value, best):
                    search_tile(ids, columns, query_ids, matrix, own, step)
        for (query_ids, _), own in zip(shared.value, best):
            score, vec = (np.concatenate(x) for x in zip(*own.rows))
            yield pd.DataFrame({"query_id": np.repeat(query_ids, [len(s) for s, _ in own.rows]), "vec_id": vec, "score": score})

    return candidates.mapInPandas(each, PARTIAL)


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 1024, blocks: int = 16, tile: int = 4096, step: int = 16, scale: int = 1024
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query row over all rows of another id.

    Both take (vec_id, embedding). Ties go to the smaller vec_id. Vectors that are null, empty or hold
    null or non-finite components take no part; neither do null ids; vectors of different lengths do not
    meet. Of repeated query ids the smallest vector counts; repeated candidate rows count each.
    Products are of floats while all sums stay below 2**53, else of whole numbers; both are exact, and a ValueError says that
    sums may leave 64 bits. No
    queries or no candidates give no rows; further columns are not read. A pass takes `blocks` blocks of queries; the results of
    several passes are written one after another to the shared folder.
    """
    spark = vectors.sparkSession
    candidates = scaled(vectors, scale)
    asked = scaled(queries, scale).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = asked.withColumn("d", F.size("v"))
    sizes = asked.groupBy("d").count().collect()  # one row for each vector length
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    schema, path, found = "query_id long, rank int, vec_id long, score long", f"{scratch_dir(spark)}/top-{uuid.uuid4().hex}", None
    single = len(sizes) == 1 and sizes[0][1] <= block * blocks
    largest = candidates.agg(F.max(F.array_max(F.transform("v", lambda e: F.abs(e.cast("double")))))).first()[0] or 0.0
    for d, n in sizes:
        if largest * largest * d >= 2.0**63:
            raise ValueError("inner products of these vectors may leave 64 bits")
        kind = np.float64 if largest * largest * d < 2.0**53 else np.int64
        for group in passes(asked, d, n, block, blocks, kind):
            best = partial_best(candidates.where(F.size("v") == d), group, k, tile, step, kind)
            found = best.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
            if not single:
                found.write.mode("append").parquet(path)
    if found is None:
        return spark.createDataFrame([], schema)
    return found if single else spark.read.schema(schema).parquet(path)
