"""Held-out accuracy, and that what is held out teaches nothing."""

import zlib

import numpy as np
import zstandard
from pyspark.sql import functions as F

from talkmill.llm.quality import Calibration, fitting, good_only, sampled, scored, train
from talkmill.tables import load

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = load(spark, SF, "documents").select("doc_id", "text"), load(spark, SF, "labels")
    model = train(docs, labels)
    rows = scored(docs, model).join(labels, "doc_id").select("doc_id", "score", "quality").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 500 and all(0 <= r.score <= 1 for r in rows)
    hit = np.mean([(r.score >= 0.5) == (r.quality == 1) for r in held])
    bad = np.mean([r.score < 0.5 for r in held if r.quality == 0])
    assert hit > 0.98 and bad > 0.93
    # Turning the held-out labels round changes nothing.
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = train(docs, turned)
    assert again.compressors == model.compressors and np.array_equal(again.calibration.weights, model.calibration.weights)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 5.0), (2, "", 5.0), (2, "", 5.0), (None, "x " * 100_000, 5.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, None), (2, None, 1)], "doc_id long, quality int, text int")
    model = train(docs, labels)
    assert [r.score for r in scored(docs, model).collect()] == [0.5] * 4
    assert train(docs.limit(0), labels.limit(0)).compressors is None and scored(docs.limit(0), model).count() == 0
    full = train(load(spark, SF, "documents"), load(spark, SF, "labels"))
    got = scored(docs, full).orderBy("doc_id").collect()
    assert len(got) == 4 and got[1].score == got[2].score == got[3].score and 0 <= got[0].score <= 1


def test_an_over_long_text_leaves_the_sample_whole(spark):
    """Wherever a text that does not fit stands in the order, all others are sampled."""
    labels = spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int")
    order = [r["doc_id"] for r in labels.orderBy(F.xxhash64(F.lit(3), "doc_id")).collect()]
    for long in (order[0], order[1], order[30], order[-1]):
        docs = labels.select("doc_id", F.when(F.col("doc_id") == long, F.repeat(F.lit("x "), 1 << 19)).otherwise("a short text").alias("text"))
        got = {r["doc_id"] for r in sampled(docs, labels, 100, 1 << 16).select("doc_id").collect()}
        assert got == set(range(60)) - {long}
    assert fitting([1, 2, 3], [9, 7, 8], 5) == [2] and fitting([1, 2, 3], [3, 9, 2], 5) == [1, 3]


def test_calibration_is_logistic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20_000, 2))
    p = 1 / (1 + np.exp(-(0.5 + x @ [1.0, -2.0])))
    got = Calibration.fit(x, (rng.random(20_000) < p).astype(float), np.ones(20_000))
    assert np.abs(got(x) - p).max() < 0.05


def test_against_a_plain_version(spark):
    """Sizes, folds and calibration computed one by one, over a whole table below the sample's bounds."""
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: (r.text or "").encode() for r in load(spark, sf, "documents").collect()}
    known = {r.doc_id: r.quality for r in load(spark, sf, "labels").collect() if r.quality in (0, 1) and r.doc_id in texts}
    fold = {d: zlib.crc32(str(d).encode()) % 3 for d in texts}
    tools = []
    for q in (1, 0):
        samples = [texts[d][i : i + 1024] for d in sorted(known) if fold[d] == 0 and known[d] == q for i in range(0, len(texts[d]), 1024)]
        built = zstandard.train_dictionary(min(112 << 10, sum(map(len, samples)) // 8), samples)
        tools.append(zstandard.ZstdCompressor(level=3, dict_data=built, write_content_size=False, write_checksum=False, write_dict_id=False))

    def features(data):
        good, bad = (sum(len(t.compress(data[i : i + 2048])) for i in range(0, len(data), 2048)) for t in tools)
        return [(bad - good) / (bad + good), (bad - good) / len(data)] if data else [0.0, 0.0]

    used = [d for d in sorted(known) if fold[d] == 2]
    x, y = np.array([features(texts[d]) for d in used]), np.array([known[d] for d in used], float)
    middle, scale = x.mean(axis=0), x.std(axis=0)
    w, rows = np.zeros(3), lambda f: np.column_stack([np.ones(len(f)), (np.array(f) - middle) / scale])
    z = rows(x)
    for _ in range(200):  # Newton steps on the ridge-regularised likelihood
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + 0.01 * np.eye(3), z.T @ (p - y) + 0.01 * w)
    want = dict(zip(texts, 1 / (1 + np.exp(-rows([features(t) for t in texts.values()]) @ w))))
    got = {r.doc_id: r.score for r in scored(load(spark, sf, "documents"), train(load(spark, sf, "documents"), load(spark, sf, "labels"))).collect()}
    assert got.keys() == want.keys() and max(abs(got[d] - want[d]) for d in got) < 1e-4


def test_sample_is_bounded_by_bytes(spark):
    """Whole texts within the bounds, in the order of hashed ids; one text at least."""
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(50)] + [(99, "y" * 5000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(50)] + [(99, 0)], "doc_id long, quality int")
    got = sampled(docs, labels, 30, 1000).collect()
    assert sum(r.quality == 1 for r in got) == 10 and [len(r.text) for r in got if r.quality == 0] == [5000]
    assert len(sampled(docs, labels, 5, 10_000).where("quality = 1").collect()) == 5


def test_clashing_columns_stay(spark):
    docs = spark.createDataFrame([(1, "a b c", 0.1, "x")], "doc_id long, text string, score double, _text string")
    model = train(load(spark, SF, "documents"), load(spark, SF, "labels"))
    assert good_only(docs, model, 0.0).collect() == docs.collect() and good_only(docs, model, 1.1).count() == 0
