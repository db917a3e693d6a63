"""Cleaning passes on hand-made transcripts."""

from pyspark.sql import functions as F

from talkmill.operators import cleaning as C


def run(spark, step, *texts):
    rows = [(d, float(i), line) for d, lines in enumerate(texts) for i, line in enumerate(lines)]
    lines = spark.createDataFrame(rows, C.LINES)
    out = {d: [] for d in range(len(texts))}
    for r in sorted(step(lines).collect(), key=lambda r: (r.doc_id, r.pos)):
        out[r.doc_id].append(r.line)
    return [out[d] for d in range(len(texts))]


def test_runs_are_alike_to_their_first(spark):
    a = [f"[0:0{i}] so we ship it today" for i in range(4)] + ["[0:09] and then"]
    b = ["one two three four five", "one two three four six", "one two three seven six", "x"]
    got = run(spark, C.collapse_runs, a, b, ["[music]"] * 4, ["a", "a"])
    assert got[0] == [a[0], "[...] [repeated audio removed - 3 identical segments collapsed]", "[0:09] and then"]
    assert got[1] == b and got[2] == ["[music]"] * 4 and got[3] == ["a", "a"]


def test_loops(spark):
    loop = ["pick his brain", "Okay."] * 6
    got = run(spark, C.collapse_loops, ["hello there", *loop, "bye now"], [f"line {i}" for i in range(12)])
    assert got[0][0] == "[...] [hallucinated repetition removed - 1 lines collapsed]" or got[0][0] == "hello there"
    assert got[0].count("pick his brain") == 1 and got[0][-1] == "bye now"
    assert got[1] == [f"line {i}" for i in range(12)]


def test_markers(spark):
    got = run(spark, C.collapse_noise, ["a", "[music]", "[music]", "(applause)", "b"], ["[music]", "[music]", "b"], [x for i in range(9) for x in ("[music]", "(risas)", f"t{i}")])
    assert got[0] == ["a", "[music]", "[...] [non-speech audio removed - 2 markers collapsed]", "b"]
    assert got[1] == ["[music]", "[music]", "b"]
    assert got[2][-1].endswith("scattered non-speech markers removed]") and not any("[music]" == x for x in got[2])


def test_ends(spark):
    got = run(spark, C.trim_end, ["a", "Yeah.", "[music]", "[BLANK_AUDIO]"], ["a", *["okay."] * 5], ["a", *["okay."] * 4])
    assert got[0] == ["a", "Yeah.", "[Recording ended - 2 lines of trailing noise removed]"]
    assert got[1] == ["a", "[Recording ended - 5 lines of trailing noise removed]"] and len(got[2]) == 5
    assert run(spark, C.drop_commands, ["a", "ok stop", "Stop recording.", "please stop recording"], ["stop recording", "b"]) == [["a", "ok stop"], ["stop recording", "b"]]


def test_scripts_and_phrases(spark):
    latin = [f"word {i}" for i in range(8)]
    assert run(spark, C.drop_foreign_script, [*latin, "東京", "123"], ["word", "東京"]) == [[*latin, "123"], ["word", "東京"]]
    assert run(spark, C.drop_phrases, ["a", "[0:01] Thanks for watching."]) == [["a"]]


def test_flags_and_rates(spark):
    rows = [(0, 0.0, "[music]"), (0, 1.0, ""), (1, 0.0, "[music]"), (1, 1.0, "x"), (2, 0.0, "")]
    assert {r.doc_id: r.all_noise for r in C.all_noise(spark.createDataFrame(rows, C.LINES)).collect()} == {0: True, 1: False, 2: False}
    pairs = spark.createDataFrame([("a b c", "a x c d"), (None, "x"), ("", None)], "said string, heard string")
    assert [round(r.wer, 4) for r in C.word_error_rate(pairs, "said", "heard").collect()] == [0.6667, 1.0, 0.0]
    texts = {"One. Two! Three?": 3, "See Sec. 1.1 of it": 1, "Acme Inc. shall. It does": 2, "Wait... what": 2, "": 1, "it.Recipient": 2, "U.S. law": 1}
    for text, n in texts.items():
        assert spark.createDataFrame([(text,)], "t string").select(C.sentence_ends(F.col("t"))).first()[0] == n, text


def test_empty(spark):
    empty = spark.createDataFrame([], C.LINES)
    assert C.clean(empty).count() == 0 and C.transcript_text(empty).count() == 0
