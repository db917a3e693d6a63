"""Quality by compression.

Two zstandard dictionaries are built from samples of good and of bad labelled text. A text is compressed in blocks with
each; the difference of the two sizes, normalised by their sum and by the text's length, goes through a logistic
calibration, fitted on labelled rows that the dictionaries have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = ("by_sum", "by_length")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


@dataclass
class Compressors:
    """The two dictionaries; picklable, the compressors are made where they are used."""

    good: bytes
    bad: bytes
    level: int = 3
    block: int = 2048

    def features(self, texts: Iterator[str | None]) -> np.ndarray:
        """A row of FEATURES for each text; all zero for an empty one."""
        import zstandard

        plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        good, bad = (
            zstandard.ZstdCompressor(level=self.level, dict_data=zstandard.ZstdCompressionDict(d), **plain).compress for d in (self.good, self.bad)
        )
        rows = []
        for text in texts:
            data = (text or "").encode("utf-8", "surrogatepass")
            parts = [data[i : i + self.block] for i in range(0, len(data), self.block)]
            g, b = sum(len(good(p)) for p in parts), sum(len(bad(p)) for p in parts)
            rows.append(((b - g) / (b + g), (b - g) / len(data)) if data else (0.0, 0.0))
        return np.array(rows, np.float64).reshape(len(rows), len(FEATURES))


@dataclass
class Calibration:
    """Logistic weights over standardised features."""

    weights: np.ndarray
    middle: np.ndarray
    scale: np.ndarray

    def __call__(self, features: np.ndarray) -> np.ndarray:
        z = np.column_stack([np.ones(len(features)), (features - self.middle) / self.scale])
        return 1 / (1 + np.exp(-np.clip(z @ self.weights, -500, 500)))

    @classmethod
    def fit(cls, features: np.ndarray, good: np.ndarray, weight: np.ndarray, ridge: float = 0.01, steps: int = 60) -> Calibration:
        """Newton steps of weighted, ridge-regularised logistic regression."""
        middle, scale = features.mean(axis=0), features.std(axis=0)
        scale[scale == 0] = 1
        z = np.column_stack([np.ones(len(features)), (features - middle) / scale])
        w = np.zeros(z.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
            hessian = (z * (weight * p * (1 - p) + 1e-6)[:, None]).T @ z + ridge * np.eye(len(w))
            w = w + np.linalg.solve(hessian, z.T @ (weight * (good - p)) - ridge * w)
        return cls(w, middle, scale)


@dataclass
class Model:
    compressors: Compressors | None
    calibration: Calibration | None
    prior: float = 0.5

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.compressors is None or self.calibration is None:
            return np.full(len(texts), self.prior)
        return self.calibration(self.compressors.features(texts))


def agreed(labels: DataFrame, remainder: int) -> DataFrame:
    """(doc_id, quality) of the labelled documents of a fold; those with null or disagreeing labels are left out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("quality in (0, 1)")
    one = known.where(fold(F.col("doc_id")) == remainder).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
    return one.where("quality = other").drop("other")


def sampled(documents: DataFrame, labels: DataFrame, most: int, most_bytes: int) -> DataFrame:
    """(doc_id, quality, text): of each class the documents whose hashed ids are least, at most `most`, as far as their texts fit in most_bytes.

    A text that does not fit beside those taken before it is left out, and later ones that fit are taken. Where none fits, the shortest is taken."""
    order = F.xxhash64(F.lit(3), "doc_id")
    good, bad = (labels.where(F.col("quality") == q).orderBy(order, "doc_id").limit(most) for q in (1, 0))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    rows = texts.join(F.broadcast(good.unionByName(bad)), "doc_id")  # at most 2 * most rows of two numbers
    sizes = rows.groupBy("doc_id", "quality").agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("n"), F.first(order).alias("o")).toPandas()
    fit = [d for _, own in sizes.sort_values(["o", "doc_id"]).groupby("quality") for d in fitting(own["doc_id"].tolist(), own["n"].tolist(), most_bytes)]
    return rows.join(F.broadcast(documents.sparkSession.createDataFrame([(int(d),) for d in fit], "doc_id long")), "doc_id")  # at most 2 * most ids


def fitting(ids: list[int], sizes: list[int], most: int) -> list[int]:
    """The ids, in order, whose sizes fit in `most` with those taken before; the one of least size if none does."""
    out, total = [], 0
    for d, n in zip(ids, sizes):
        if total + n <= most:
            out.append(d)
            total += n
    return out or [min(zip(sizes, ids))[1]]


def _blocks(block: int):
    """mapInPandas: the texts in blocks of bytes."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, q, text in zip(b["doc_id"], b["quality"], b["text"]):
                data = (text or "").encode("utf-8", "surrogatepass")
                out += [(doc, q, i, data[i * block : (i + 1) * block]) for i in range(-(-len(data) // block))]
            yield pd.DataFrame(out, columns=["doc_id", "quality", "at", "data"])

    return each


def train(documents: DataFrame, labels: DataFrame, most: int = 2000, most_bytes: int = 16 << 20, size: int = 112 << 10) -> Model:
    """Dictionaries from the labelled rows of fold 0, calibration on those of fold 2; fold 1 is held out.

    Each takes whole texts of at most `most` documents and most_bytes bytes of a class; the dictionaries are built from their blocks of 1 KiB.
    Without enough of both classes to build dictionaries (zstandard asks for a few samples) or to calibrate,
    the model scores every text with the prior, 0.5. Labels that are null, neither 0 nor 1, or contradict each other, are left out.
    """
    import zstandard

    samples = sampled(documents, agreed(labels, 0), most, most_bytes)
    samples = samples.mapInPandas(_blocks(1024), "doc_id long, quality int, at int, data binary").toPandas()
    samples = samples.sort_values(["doc_id", "at", "data"])
    built = {}
    for q in (0, 1):
        own = [bytes(d) for d in samples.loc[samples["quality"] == q, "data"]]
        try:
            built[q] = zstandard.train_dictionary(min(size, max(256, sum(map(len, own)) // 8)), own).as_bytes()
        except (zstandard.ZstdError, ValueError, MemoryError):
            return Model(None, None)
    compressors = Compressors(built[1], built[0])

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(compressors.features(b["text"]), columns=FEATURES).assign(doc_id=b["doc_id"].to_numpy(), quality=b["quality"].to_numpy())

    held = agreed(labels, 2)
    counts = {q: n for q, n in held.groupBy("quality").count().collect()}
    rows = sampled(documents, held, most, most_bytes).select("doc_id", "quality", "text")
    rows = rows.mapInPandas(measured, ", ".join(f"{f} double" for f in FEATURES) + ", doc_id long, quality int").toPandas()
    rows = rows.sort_values(["doc_id", *FEATURES])
    if rows["quality"].nunique() < 2:
        return Model(None, None)
    # Each class weighs what it weighs among all labelled rows.
    good = rows["quality"].to_numpy(float)
    share = {q: counts[q] / (good == q).sum() for q in (0, 1)}
    weight = np.where(good == 1, share[1], share[0])
    return Model(compressors, Calibration.fit(rows[list(FEATURES)].to_numpy(), good, weight * len(good) / weight.sum()))


def score(model: Model, text: Column) -> Column:
    """The score of a text, 0 to 1, higher is better. Whole texts are read; null and empty ones have the score of zero features."""

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(texts.tolist()), dtype="float64")

    return of(text.cast("string"))


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """documents with `score`. A `score` column is replaced; other columns, null ids and repeated rows stay. No rows give no rows."""
    return documents.withColumn("score", score(model, F.col("text")))


def good_only(documents: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of documents whose score is at least that, all columns as they are, clashing names included."""
    return documents.where(score(model, F.col("text")) >= least)
