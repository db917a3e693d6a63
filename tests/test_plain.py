"""What SQL cannot express, against plain versions: replays, repetitions and loops, word errors, blocks of names."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from talkmill.functions.stems import stem
from talkmill.operators import answers, cleaning, identity, names, records, retrieval, voices
from talkmill.plans import answers as answer_plans
from talkmill.plans import live
from talkmill.streaming import operators, windows
from talkmill.streaming.stateful import Operator

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["topic_shifts", "nudge_policy", "partial_gate", "speech_smoothing", "session_states", "nudge_scores"])
def test_replay_is_step_by_step(spark, monkeypatch, name):
    """The query over streamed partitions gives what one loop over all rows of a key gives."""
    query = {**live.QUERIES, **answer_plans.QUERIES}[name]
    got = sorted(map(str, query(spark, SF).collect()))

    def plain(self, rows, key, order):
        by = {}
        for r in rows.collect():
            by.setdefault(r[key], []).append(r)
        out = []
        for k, own in by.items():
            own.sort(key=lambda r: tuple((r[c] is not None, r[c]) for c in order))
            state, found = {x: (list(v) if isinstance(v, list) else dict(v) if isinstance(v, dict) else v) for x, v in self.initial.items()}, []
            for r in own:
                state, more = self.step(state, r.asDict())
                found += more
            out += [(k, *m) for m in found]
        return spark.createDataFrame(out, f"{key} {dict(rows.dtypes)[key]}, {self.output}")

    monkeypatch.setattr(Operator, "replay", plain)
    assert sorted(map(str, query(spark, SF).collect())) == got and got


def plain_runs(texts, similarity=0.8):
    out, i = [], 0
    while i < len(texts):
        same = list(itertools.takewhile(lambda t: cleaning.likeness(texts[i], t) >= similarity, texts[i + 1 :]))
        if texts[i].lower() in cleaning.noise.ALWAYS_NOISE:
            same = []
        out.append(texts[i])
        if len(same) >= 2:
            out.append(f"[...] [repeated audio removed - {len(same)} identical segments collapsed]")
        i += len(same) + 1 if len(same) >= 2 else 1
    return out


def test_runs_against_a_plain_version(spark):
    rng = random.Random(1)
    pool = ["we ship it today", "we ship it", "we ship it now", "a b c d e", "a b c d f", "x", "[music]", "", "A B C D E"]
    talks = [[rng.choice(pool[: rng.randrange(2, 10)]) for _ in range(rng.randrange(0, 40))] for _ in range(60)]
    lines = spark.createDataFrame([(d, float(i), x) for d, t in enumerate(talks) for i, x in enumerate(t)], cleaning.LINES)
    got = {d: [] for d in range(len(talks))}
    for r in sorted(cleaning.collapse_runs(lines).collect(), key=lambda r: (r.doc_id, r.pos)):
        got[r.doc_id].append(r.line)
    assert [got[d] for d in range(len(talks))] == [plain_runs(t) for t in talks]


def test_loops_keep_all_but_the_loop():
    rng = random.Random(2)
    for _ in range(200):
        before, after = ([f"{w} {i}" for i in range(rng.randrange(0, 15))] for w in ("before", "after"))
        loop = []
        for i in range(rng.randrange(6, 20)):
            loop += ["loop text", *rng.choice([[], ["okay"], [f"gap {i}"], [f"gap {i}", f"gap b {i}"]])] if i < 5 else ["loop text"]
        passing, out = cleaning.Loops(), []
        for i, x in enumerate(before + loop + after):
            out += passing.feed((float(i), x))
        texts = [x for _, x in sorted(out + passing.end())]
        assert texts.count("loop text") < 10 and (texts.count("loop text") <= 5 or len(loop) < 15)
        assert [x for x in texts if x.startswith("after")] == after
        held = [x for x in texts if x.startswith("before")]
        assert held == before[: len(held)] and len(before) - len(held) <= 5
    passing = cleaning.Loops()
    plain = [(float(i), f"line {i}") for i in range(30)]
    assert [y for x in plain for y in passing.feed(x)] + passing.end() == plain


def test_word_errors_against_a_plain_version(spark):
    rng = random.Random(3)
    pairs = [tuple(" ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 12))) for _ in range(2)) for _ in range(200)]

    def plain(a, b):
        x, y = a.split(), b.split()
        d = [[i + j if not i * j else 0 for j in range(len(y) + 1)] for i in range(len(x) + 1)]
        for i, j in itertools.product(range(1, len(x) + 1), range(1, len(y) + 1)):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (x[i - 1] != y[j - 1]))
        return d[-1][-1] / len(x) if x else float(bool(y))

    got = cleaning.word_error_rate(spark.createDataFrame(pairs, "said string, heard string"), "said", "heard").collect()
    assert [r.wer for r in got] == [plain(*p) for p in pairs]


def test_deletion_blocks_miss_no_pair(spark):
    rng = random.Random(4)
    pool = {"".join(rng.choice("abc") for _ in range(rng.randrange(2, 9))) for _ in range(150)}
    rows = spark.createDataFrame([(n,) for n in sorted(pool)], "name string")
    both = rows.withColumnRenamed("name", "a").join(rows.withColumnRenamed("name", "b"), F.expr("a < b"))
    want = {(r.a, r.b) for r in both.where(identity.plausibly_same(F.col("a"), F.col("b")).isNotNull()).collect()}
    got = {(r.a, r.b) for r in identity.plausible_pairs(rows).collect()}
    assert got == want and len(want) > 100


def test_ranks_and_profiles(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice([1.0, 2.0, rng.random()])) for k in (1, 2) for _ in range(777 * k)] + [(3, 5.0), (3, None), (None, 1.0)]
    got = {r.k: r for r in retrieval.nearest_ranks(spark.createDataFrame(rows, "k int, v double"), "k", "v", (1, 50, 99), slices=8).collect()}
    for k in (1, 2, 3):
        own = sorted(v for kk, v in rows if kk == k and v is not None)
        for p in (1, 50, 99):
            assert got[k][f"p{p}"] == own[max(1, -(-len(own) * p // 100)) - 1] and got[k][f"i{p}"] == own[-(-(len(own) - 1) * p // 100)]
    people = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(20)], "label long, mean array<double>")
    vectors = spark.createDataFrame([(1, [4.0, 1.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, None)], "vec_id long, embedding array<double>")
    best = retrieval.best_profile(vectors, people, "label", 0.5, 0.0, block=3).collect()
    assert [(r.vec_id, r.label, r.similarity, r.margin) for r in best] == [(1, 4, 1.0, 0.0)]


def test_names(spark):
    cases = {
        "Junlei, tech lead": "Junlei", "Robert (Bob) Smith": "Robert (Bob) Smith", "Ann (the product manager)": "Ann", "Bo — Senior Engineer": "Bo", "Geert speaker 0 speaker 1": "Geert",
        "Junlei Tech Lead speaker 0": "Junlei", "speaker 3": None, "The team": None, "qa team": None, "Dev": "Dev", "Winnie the Pooh": "Winnie the Pooh", "Catch 22": "Catch 22", "": None,
    }
    got = spark.createDataFrame([(n,) for n in cases], "n string").select("n", names.clean_name(F.col("n")).alias("c")).collect()
    assert {r.n: r.c for r in got} == cases
    lists = {"Gert and Liam": ["Gert", "Liam"], "Liam & Joe": ["Liam", "Joe"], "A, B, and C": ["A", "B", "C"], "Chen, Sarah": ["Chen, Sarah"], "x;y": ["x", "y"], "Andy Sand": ["Andy Sand"]}
    got = spark.createDataFrame([(n,) for n in lists], "n string").select("n", names.people_of(F.col("n")).alias("p")).collect()
    assert {r.n: r.p for r in got} == lists
    talk = spark.createDataFrame([(1, 0, "[A 0:01] This is Matt speaking"), (1, 1, "[A 0:02] Mats is late"), (1, 2, "[A 0:03] Matthew is late"), (2, 0, "[A 0:01] this is Matt")], "doc_id long, pos int, line string")
    fixed = names.own_name_repaired(talk, talk.where("doc_id = 1").select("doc_id"), "Mat", ("Matt",)).orderBy("doc_id", "pos").collect()
    assert [r.line for r in fixed] == ["[A 0:01] This is Mat speaking", "[A 0:02] Mat is late", "[A 0:03] Matthew is late", "[A 0:01] this is Matt"]


def test_questions_and_caps(spark):
    q = answers.interpreted('clauses on "sole remedy" with indemnity and governing law in at most two sentences')
    assert q == answers.Question(("indemnity", "governing_law"), "sole remedy", 2, False)
    assert answers.interpreted("documents containing a subpoena").anywhere and answers.interpreted("3 sentences").sentences == 3
    for bad in ("", " ", "x" * 5000):
        with pytest.raises(ValueError):
            answers.interpreted(bad)
    provs = spark.createDataFrame([(1, 1, "Indemnity", "One. Two.", False), (1, 2, None, "indemnify. governed by the laws", True), (2, 1, None, "governed by the laws of X. We indemnify. Sole remedy.", False)], "doc_id long, ordinal int, heading string, text string, inferred boolean")
    own = answers.Question(("indemnity", "governing_law"), "sole REMEDY", 3)
    assert [r.doc_id for r in answers.evidence(provs, own).collect()] == [2]
    assert not answers.evidence(provs, answers.Question(("indemnity",), None, 2, excluded=("governing_law",))).where("doc_id = 2").collect()
    assert {r.doc_id: r.evidence for r in answers.documents_with(provs, answers.Question(("indemnity", "governing_law")), most=1).collect()} == {1: [1], 2: [1]}
    rows = spark.range(10)
    assert answers.guarded(rows, 10).count() == 10 and answers.capped(rows, [F.col("id")], 5, 1000).count() == 5 and answers.capped(rows, [F.col("id")], 10, 8).count() == 1
    with pytest.raises(ValueError):
        answers.guarded(rows, 9)


def test_solo_clips_and_scores(spark):
    windows_ = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [1.0, 0.1]), ("b", [1.0, 0.0]), ("c", [1.0, 0.0]), ("c", [-1.0, 0.0]), ("d", [1.0]), ("d", [1.0, 0.0]), ("e", [1.0, 0.0]), ("e", [1.0, 0.0])], "clip string, embedding array<double>")
    clips = spark.createDataFrame([(c, 1.0 if c == "e" else 9.0, 20.0, 0.0) for c in "abcdef"], "clip string, speech_seconds double, snr double, clipping double")
    got = {r.clip: r.refused for r in voices.solo_profiles(windows_, clips).collect()}
    assert got == {"a": None, "b": "few windows", "c": "several voices", "d": "uneven windows", "e": "short", "f": "few windows"}
    rows = [("label", "o1", None, 0, 100, "", None, None, False), ("label", "o2", "ask", 50, 200, "", None, None, False), ("nudge", "", "ask", None, None, "Try  this", 60, 70, False), ("nudge", "", "ask", None, None, "try this", 80, 90, True), ("nudge", "", "tell", None, None, "x", 90, 99, False), ("nudge", "", "ask", None, None, "y", 900, 999, False)]
    table = spark.createDataFrame([(1, *r) for r in rows], "fixture long, kind string, name string, opportunity string, start_ms long, end_ms long, text string, evidence_ms long, delivered_ms long, stale boolean")
    r = voices.nudge_scores(table).first()
    assert (r.nudges, r.useful, r.repeated, r.stale, r.opportunities, r.precision, r.recall) == (4, 2, 2, 1, 2, 0.5, 1.0)


def test_streams_of_partials_and_sinks(spark, tmp_path):
    source, seen, out = (str(tmp_path / n) for n in ("in", "seen", "out"))
    rows = spark.createDataFrame([(f"2026-01-01 00:00:0{i}.{i}00", "s", i, 0, f"t{i}") for i in range(4)], "ts string, session string, sequence int, revision int, text string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.coalesce(1).write.parquet(source)
    assert windows.debounced(rows).count() == 4
    lines = rows.select(F.col("sequence").alias("line"), "session", F.col("ts").alias("l_start"), (F.col("ts") + F.expr("interval 1 second")).alias("l_end"))
    segments = rows.select("session", F.col("text").alias("speaker"), F.col("ts").alias("start"), (F.col("ts") + F.expr("interval 1 second")).alias("end"))
    assert windows.attributed(lines, segments).count() >= 4
    for k in range(2):  # a new checkpoint delivers the batch again
        stream = spark.readStream.schema(rows.schema).parquet(source)
        assert windows.to_memory_sink(stream, str(tmp_path / f"c{k}"), seen, lambda b: b.write.mode("append").parquet(out)).awaitTermination(120)
    assert spark.read.parquet(out).count() == 4
    ring = spark.createDataFrame([(1, i, m) for i, m in enumerate([5, 1, 9, 2])], "k int, i int, ms int")
    assert [(r.n, r.p50, r.p95) for r in windows.newest_percentiles(ring, "k", "i", "ms", 3).orderBy("i").collect()][-1] == (3, 2, 9)
    assert operators.latency(3).output.startswith("n long")


def test_stems(spark):
    pairs = """caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size
        hopping hop falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc digitizer digit
        conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis
        hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr
        hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac
        adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler
        probate probat rate rate cease ceas controll control roll roll""".split()
    assert [stem(w) for w in pairs[::2]] == pairs[1::2]
    docs = spark.createDataFrame([(1, "Licensing attributes"), (2, "licensed; attribution"), (3, "licences attribution"), (4, "license"), (5, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in retrieval.matching_stems(docs, "licensed attribut").collect()) == [1, 2]
    assert retrieval.matching_stems(docs, " ").count() == 0


def test_live_texts_and_chunks(spark):
    rows = [(1, 0.0, "[0:01] hello there"), (1, 1.0, "[soft piano tune]"), (1, 2.0, "[0:02] 東京は夜です"), (1, 3.0, "how are you"), (1, 4.0, "[12:30]"), (1, 5.0, "fine (laughs)"), (2, 0.0, "[music]"), (3, 0.0, " ")]
    got = {r.doc_id: r.text for r in records.live_texts(spark.createDataFrame(rows, cleaning.LINES)).collect()}
    assert got == {1: "hello there how are you [12:30] fine (laughs)"}
    rng = random.Random(6)
    texts = ["\n".join("x" * rng.choice([0, 3, 30, 500]) for _ in range(rng.randrange(0, 30))) for _ in range(60)] + [None, ""]
    parts = {}
    for r in records.chunks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 50).collect():
        parts.setdefault(r.doc_id, []).append(r)
    for d, text in enumerate(texts):
        own, text = sorted(parts.get(d, []), key=lambda r: r.chunk), (text or "") + "\n"
        assert [r.start for r in own] == [sum(x.chars for x in own[:i]) for i in range(len(own))]
        assert sum(r.chars for r in own) == (len(text) if len(text) > 1 else 0)
        for r, after in zip(own, [*own[1:], None]):
            piece = text[r.start : r.start + r.chars]
            assert piece.endswith("\n") and (r.chars <= 201 or piece.count("\n") == 1)
            if after:
                assert r.chars + len(text[after.start :].split("\n")[0]) > 200, "a chunk takes all lines that fit"
