"""Each stage of the pipeline against a plain version, on what its predecessor kept."""

import corpus_pipeline
import public_tokenizers

from talkmill.llm import packing
from talkmill.llm.quality import scored, train
from talkmill.llm.shared import written
from talkmill.tables import load
from tests.llm.test_lines import plain as plain_lines
from tests.llm.test_packing import held, ids_of

SF = "/root/testdata/sf0.01"


def grams(text):
    w = (text or "").lower().split()
    n = min(5, max(1, len(w)))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_stages(spark):
    docs = load(spark, SF, "documents")
    stages, kept = dict(corpus_pipeline.STAGES), {}
    assert list(stages) == ["quality", "lines", "near_duplicates", "decontamination", "packing"]
    frame = docs
    for name, stage in stages.items():
        frame = written(stage(spark, frame, SF), name)
        kept[name] = frame.collect()
        if name != "packing":
            assert frame.columns == docs.columns

    model = train(docs, load(spark, SF, "labels"))
    good = {r.doc_id for r in scored(docs, model).where("score >= 0.5").collect()}
    assert {r.doc_id for r in kept["quality"]} == good and len(good) > 700

    want = plain_lines([(r.doc_id, r.text) for r in kept["quality"]])
    assert {r.doc_id: r.text for r in kept["lines"]} == {d: t for d, (_, _, t) in want.items()}
    assert all(r.n_chars == len(r.text) for r in kept["lines"])

    texts = {r.doc_id: grams(r.text) for r in kept["lines"]}
    left = {r.doc_id for r in kept["near_duplicates"]}
    index = {}
    for d, s in texts.items():
        for g in s:
            index.setdefault(g, []).append(d)
    alike = lambda a, b: len(texts[a] & texts[b]) >= 0.8 * len(texts[a] | texts[b])
    for d in set(texts) - left:
        assert any(alike(e, d) for g in texts[d] for e in index[g] if e < d) or not texts[d]
    near = {(a, b) for ds in index.values() if len(ds) < 100 for a in ds for b in ds if a < b and alike(a, b)}
    assert sum(a in left and b in left for a, b in near) <= 0.05 * len(near)

    leaks = {r.doc_id for r in kept["near_duplicates"]} - {r.doc_id for r in kept["decontamination"]}
    items = [" ".join(r.text.split()) for r in load(spark, SF, "benchmark").collect()]
    holds = {r.doc_id for r in kept["near_duplicates"] if any(i in " ".join((r.text or "").split()) for i in items)}
    assert leaks >= holds and len(leaks) <= len(holds) + 5

    pieces = {}
    for r in kept["packing"]:
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == {r.doc_id for r in kept["decontamination"]}
    for r in kept["decontamination"][:150]:
        held(pieces[r.doc_id], ids_of(r.text))


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def test_stages_leave_little_in_a_worker(spark):
    """Stages give Python batches of few rows, and the last one's encoder is not kept: a worker lives through all stages."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    docs = load(spark, SF, "documents")
    plain = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")).drop("sequence_id")
    try:
        spark.conf.set(key, "10000")
        out = dict(corpus_pipeline.STAGES)["packing"](spark, docs, SF)
        assert spark.conf.get(key) == "1000"
        assert sorted(out.select(plain.columns).collect()) == sorted(plain.collect())
        path, kept = public_tokenizers.path("word_bpe_49k.json"), packing.encoder.cache_info().currsize
        encode = packing.passing_encoder(path, 2, 50)
        for text in (" ".join(f"w{i}" for i in range(k, k + 40)) for k in range(0, 400, 40)):
            assert encode([text]) == [packing.Encoder(path, 2)._whole(text) + encode.end] and len(encode.known) <= 100
        assert packing.encoder.cache_info().currsize == kept
        spark.conf.set(key, "200")
        corpus_pipeline.lean(spark)
        assert spark.conf.get(key) == "200"
    finally:
        spark.conf.set(key, before)


def test_stages_on_edges(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, empty tables, and extra columns with the names that stages use."""
    for name in ("labels", "benchmark"):
        load(spark, SF, name).write.parquet(f"{tmp_path}/full/{name}.parquet")
        load(spark, SF, name).limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    item = load(spark, SF, "benchmark").where("text is not null").orderBy("item_id").first().text
    clean = load(spark, SF, "documents").join(load(spark, SF, "labels").where("quality = 1"), "doc_id").orderBy("doc_id").first().text
    texts = [None, "", clean, clean, clean + "\n" + clean + " end", " ".join(f"w{i}" for i in range(60_000)), item, "one two", "\n\n"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, n_dropped string, row string, lines string, node string, fp0 string, _text string"
    extra = tuple("abcdefg")
    rows = [(i, t, "en", "s", None if t is None else len(t), *extra) for i, t in enumerate(texts)]
    rows += [rows[2], rows[5], (None, clean, None, None, None, *extra), (None, None, None, None, None, *[None] * 7)]
    docs = spark.createDataFrame(rows, schema)
    for tables in ("full", "none"):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs, f"{tmp_path}/{tables}")
            if name == "packing":
                assert got.agg({"length": "sum"}).first()[0] > 120_000
                continue
            assert got.schema == docs.schema, name
            kept = got.collect()
            if name == "quality" and tables == "none":
                assert len(kept) == len(rows)
            if name == "lines":
                assert len(kept) == len(rows) and all(r.score == "a" and r.row == "c" for r in kept if r.doc_id is not None)
            if name == "near_duplicates":
                ids = sorted((-1 if r.doc_id is None else r.doc_id) for r in kept)
                assert ids == [-1, -1, 0, 2, 2, 5, 5, 6, 7], "empty texts are one group; 3 and 4 are like 2; equal rows of one id stay"
            if name == "decontamination":
                ids = [r.doc_id for r in kept]
                assert (6 in ids) == (tables == "none") and len(ids) == len(rows) - (tables == "full")
            assert stage(spark, docs.limit(0), f"{tmp_path}/{tables}").count() == 0
