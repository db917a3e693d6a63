"""Preference pairs against plain Python."""

from talkmill.llm.chat import preference_pairs, stale_replies
from talkmill.tables import load


def render(turns):
    text, spans = "", []
    for role, content in turns:
        head = f"<|{role}|>\n"
        text += head + content + "<|end|>\n"
        if role == "assistant":
            spans.append((len(text) - len(content) - 8, len(text)))
    return text, spans


def plain(chosen, rejected):
    """Both: turn -> (role, text)."""
    turns = sorted(set(chosen) | set(rejected))
    n = 0
    while n < len(turns) and chosen.get(turns[n]) == rejected.get(turns[n]):
        n += 1
    c = render([chosen[t] for t in turns[n:] if t in chosen])
    r = render([rejected[t] for t in turns[n:] if t in rejected])
    return (n, render([chosen[t] for t in turns[:n]])[0], c[0], r[0], c[1], r[1])


def result(r):
    return (r.n_prompt_turns, r.prompt, r.chosen, r.rejected, [tuple(s) for s in r.chosen_spans], [tuple(s) for s in r.rejected_spans])


def test_whole_table(spark):
    table = load(spark, "/root/testdata/sf0.01", "conversations")
    talks = {}
    for r in table.collect():
        talks.setdefault(r.conv_id, {})[r.turn] = (r.role, r.text)
    want = {}
    for c, turns in talks.items():
        replies = [t for t in sorted(turns) if turns[t][0] == "assistant"]
        if replies:
            chosen = {t: x for t, x in turns.items() if t <= replies[-1]}
            rejected = chosen | {replies[-1]: ("assistant", turns[replies[0]][1])}
            if chosen != rejected:
                want[c] = plain(chosen, rejected)
    got = preference_pairs(*stale_replies(table)).collect()
    assert {r.pair_id: result(r) for r in got} == want and len(got) == len(want) > 50
    assert all(r.chosen and r.rejected and r.chosen != r.rejected for r in got)


def test_segments_join_to_the_whole(spark):
    chosen = {t: ("assistant" if t % 2 else "user", f"message {t} é😀") for t in range(500)}
    rejected = {**{t: x for t, x in chosen.items() if t < 300}, 300: ("user", "other"), 301: ("assistant", "")}
    frame = lambda talk: spark.createDataFrame([(7, t, r, x) for t, (r, x) in talk.items()], "pair_id long, turn long, role string, text string")
    assert [result(r) for r in preference_pairs(frame(chosen), frame(rejected)).collect()] == [plain(chosen, rejected)]
    got = preference_pairs(frame(chosen), frame(rejected), segment_turns=64).orderBy("segment").collect()
    want = plain(chosen, rejected)
    assert len(got) == 8 and sum(r.n_prompt_turns for r in got) == want[0] == 300
    assert ["".join(r[c] for r in got) for c in ("prompt", "chosen", "rejected")] == list(want[1:4])
    at, spans = 0, []
    for r in got:
        spans += [(at + s.start, at + s.end) for s in r.chosen_spans]
        at += len(r.chosen)
    assert spans == want[4]


def test_edges(spark):
    schema = "pair_id long, turn int, role string, text string, chosen int, segment string"
    chosen = [(1, 0, "user", "q", 0, "s"), (1, 0, "user", "q", 0, "s"), (1, 1, "assistant", None, 0, "s"), (2, 0, None, "", 0, "s"), (3, 5, "user", "only here", 0, "s"), (None, 0, "user", "x", 0, "s"), (4, None, "user", "x", 0, "s"), (5, 0, "user", "b", 0, "s"), (5, 0, "user", "a", 0, "s"), (6, -1, "user", "x" * 200_000, 0, "s")]
    rejected = [(1, 0, "user", "q", 0, "s"), (2, 0, None, None, 0, "s"), (5, 0, "user", "a", 0, "s"), (6, -1, "assistant", "x" * 200_000, 0, "s")]
    a, b = spark.createDataFrame(chosen, schema), spark.createDataFrame(rejected, schema)
    got = {r.pair_id: result(r) for r in preference_pairs(a, b).collect()}
    assert set(got) == {1, 3, 5, 6}, "2 has equal sides"
    assert got[1] == (1, "<|user|>\nq<|end|>\n", "<|assistant|>\n<|end|>\n", "", [(14, 22)], [])
    assert got[3][:2] == (0, "") and got[5][2:4] == ("<|user|>\na<|end|>\n<|user|>\nb<|end|>\n", "<|user|>\na<|end|>\n") and got[6][5] == [(14, 200_022)]
    assert preference_pairs(a.limit(0), b.limit(0)).count() == 0
