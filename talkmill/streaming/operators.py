"""The stateful operators of live sessions: topic shifts, nudges, partial transcripts, speech smoothing, sessions, latency."""

from __future__ import annotations

import math
import re

from talkmill.functions.text import KEYWORD_STOPWORDS, TRANSITION_CUES
from talkmill.streaming.stateful import Operator, TimedOperator


def _missing(row: dict, *columns: str) -> bool:
    """Whether one of the columns is null (NaN, in pandas' columns of numbers)."""
    return any(row[c] is None or row[c] != row[c] for c in columns)


def _keywords(text: str) -> set[str]:
    words = re.split(r"[^\w]|_", "".join(c.lower() if c.isascii() else c for c in text))
    return {w for w in words if len(w.encode()) >= 4 and w not in KEYWORD_STOPWORDS}


def topic_shifts(least_terms: int = 3, overlap: float = 0.10, most_terms: int = 18) -> Operator:
    """rows (text) -> (prior, current, overlap): an utterance whose keywords hardly meet the topic's, or that says so.

    Utterances of fewer keywords count for nothing. Otherwise keywords join the topic, which keeps its last ones in
    the order of the alphabet.
    """

    def step(state: dict, row: dict) -> tuple[dict, list[tuple]]:
        text, anchor = row["text"] or "", set(state["anchor"])
        now = _keywords(text)
        if len(now) < least_terms:
            return state, []
        if not anchor:
            return {"anchor": sorted(now)}, []
        share = len(anchor & now) / len(anchor | now)
        said = any(cue in text.lower() for cue in TRANSITION_CUES)
        if said or (share <= overlap and len(anchor) >= least_terms):
            return {"anchor": sorted(now)}, [(" ".join(sorted(anchor)), " ".join(sorted(now)), share)]
        return {"anchor": sorted(anchor | now)[-most_terms:]}, []

    return Operator(step, {"anchor": []}, "prior string, current string, overlap double")


def nudges(modes: tuple[str, ...], confidence: int = 60, interval_ms: int = 10_000, ttl_ms: int = 30_000) -> Operator:
    """rows (ms, kind, text, source, opportunity, confidence, nudge) -> (nudge, text, ms, supersedes): drafts that may be shown.

    A draft needs text and source, an opportunity of the mode, confidence, and distance to the last nudge. Rows of kind `helpful`,
    `not_helpful` and `dismissed` answer a shown nudge, once each: dismissal asks for 4 s and 5 points more, `not_helpful` for 8 s
    and 10 points more, `helpful` for 1 s and 3 points less; at most 60 s and 95 points. A nudge still alive is superseded.
    """

    def bars(s: dict) -> tuple[int, int]:
        wait = interval_ms + 4_000 * s["dismissed"] + 8_000 * s["not_helpful"] - 1_000 * s["helpful"]
        points = confidence + 5 * s["dismissed"] + 10 * s["not_helpful"] - 3 * s["helpful"]
        return min(60_000, max(0, wait)), min(95, max(0, points))

    def step(s: dict, row: dict) -> tuple[dict, list[tuple]]:
        if row["kind"] in ("helpful", "not_helpful", "dismissed"):
            if row["nudge"] in s["shown"] and row["nudge"] not in s["answered"]:
                s["answered"].append(row["nudge"])
                s[row["kind"]] += 1
                if row["kind"] == "dismissed" and s["active"] == row["nudge"]:
                    s["active"] = None
            return s, []
        text, source = (row["text"] or "").strip()[:240], (row["source"] or "").strip()[:64]
        wait, points = bars(s)
        if not text or not source or row["opportunity"] not in modes or min(100, row["confidence"]) < points:
            return s, []
        if s["last"] is not None and row["ms"] - s["last"] < wait:
            return s, []
        old = s["active"] if s["active"] is not None and row["ms"] - s["last"] < ttl_ms else None
        s["count"] += 1
        name = f"nudge-{s['count']}"
        s.update(active=name, last=int(row["ms"]), shown=[*s["shown"], name][-128:])
        s["answered"] = [a for a in s["answered"] if a in s["shown"]]
        return s, [(name, text, int(row["ms"]), old)]

    first = {"count": 0, "last": None, "active": None, "shown": [], "answered": [], "helpful": 0, "not_helpful": 0, "dismissed": 0}
    return Operator(step, first, "nudge string, text string, ms long, supersedes string")


def stable_partials(cadence_ms: int = 120) -> Operator:
    """rows (audio_ms, text) -> (audio_ms, stable, rest, revision): what partial transcripts may show.

    Words that two hypotheses in a row agree on are stable and never change; a hypothesis that would change them waits. Updates come
    at most once in cadence_ms and only with other text.
    """

    def common(a: list[str], b: list[str]) -> int:
        n = min(len(a), len(b))
        return n if a[:n] == b[:n] else next(i for i, (x, y) in enumerate(zip(a, b)) if x != y)

    def step(s: dict, row: dict) -> tuple[dict, list[tuple]]:
        words = (row["text"] or "").split()
        if not words:
            return s, []
        agreed = common(s["before"], words)
        s["before"] = words
        if agreed < len(s["stable"]):
            s["regressions"] += 1
            return s, []
        s["stable"] = words[:agreed]
        soon = s["at"] is not None and row["audio_ms"] - s["at"] < cadence_ms
        if not s["stable"] or soon or words == s["shown"]:
            return s, []
        s.update(at=int(row["audio_ms"]), shown=words, revision=s["revision"] + 1)
        return s, [(s["at"], " ".join(s["stable"]), " ".join(words[agreed:]), s["revision"])]

    return Operator(step, {"before": [], "stable": [], "shown": [], "at": None, "revision": 0, "regressions": 0}, "audio_ms long, stable string, rest string, revision long")


def newest_partials() -> Operator:
    """rows (sequence, revision, final, text) -> the same, if no newer version of the utterance, nor its final one, has come."""

    def step(s: dict, row: dict) -> tuple[dict, list[tuple]]:
        k, version = str(row["sequence"]), [int(row["final"]), int(row["revision"])]
        if version <= s["seen"].get(k, [-1, -1]):
            return s, []
        s["seen"][k] = version
        for old in sorted(map(int, s["seen"]))[:-64]:
            del s["seen"][str(old)]
        return s, [(int(row["sequence"]), int(row["revision"]), bool(row["final"]), row["text"])]

    return Operator(step, {"seen": {}}, "sequence long, revision long, final boolean, text string")


def speech(on: float = 0.5, off: float = 0.35, least_speech_ms: int = 250, least_silence_ms: int = 500, window_ms: int = 32) -> Operator:
    """rows (probability) -> (window, speaking): speech once it has lasted, silence once that has.

    Between `off` and `on` nothing changes; below `off` the run of speech starts anew.
    """

    def step(s: dict, row: dict) -> tuple[dict, list[tuple]]:
        p = row["probability"] or 0.0
        s["window"] += 1
        if p >= on:
            s["low_since"] = None
            s["segment"], s["run"] = True, s["run"] + window_ms
            s["sure"] = s["sure"] or s["run"] >= least_speech_ms
        elif p < off and s["segment"]:
            s["run"] = 0
            s["low_since"] = s["window"] if s["low_since"] is None else s["low_since"]
            if (s["window"] - s["low_since"]) * window_ms >= least_silence_ms:
                s.update(segment=False, sure=False, low_since=None)
        return s, [(s["window"], s["segment"] and s["sure"])]

    return Operator(step, {"window": 0, "segment": False, "sure": False, "run": 0, "low_since": None}, "window long, speaking boolean")


#: State, event -> state.
TRANSITIONS = {("new", "start"): "active", ("active", "pause"): "paused", ("paused", "resume"): "active", ("active", "stop"): "processing", ("paused", "stop"): "processing", ("processing", "done"): "complete", ("processing", "fail"): "failed"}


def sessions() -> Operator:
    """rows (event) -> (event, state, accepted): events that do not fit the session's state are refused."""

    def step(s: dict, row: dict) -> tuple[dict, list[tuple]]:
        after = TRANSITIONS.get((s["state"], row["event"]))
        return ({"state": after} if after else s), [(row["event"], after or s["state"], after is not None)]

    return Operator(step, {"state": "new"}, "event string, state string, accepted boolean")


def latency(newest: int = 64) -> Operator:
    """rows (ms) -> (n, p50, p95): nearest-rank percentiles of the newest values."""

    def step(s: dict, row: dict) -> tuple[dict, list[tuple]]:
        s["ring"] = [*s["ring"], int(row["ms"])][-newest:]
        ordered = sorted(s["ring"])
        rank = lambda p: ordered[max(1, math.ceil(p * len(ordered) / 100)) - 1]
        return s, [(len(ordered), rank(50), rank(95))]

    return Operator(step, {"ring": []}, "n long, p50 long, p95 long")


def expiring_nudges(modes: tuple[str, ...], confidence: int = 60, interval_ms: int = 10_000, ttl_ms: int = 30_000) -> TimedOperator:
    """`nudges` with their ends: (event, nudge, text, ms, supersedes), event `shown`, or `expired` at the end of a nudge's life.

    A nudge that was dismissed or superseded does not expire.
    """
    plain = nudges(modes, confidence, interval_ms, ttl_ms)

    def step(s: dict, row: dict) -> tuple[dict, list[tuple]]:
        s, shown = plain.step(s, row)
        return s, [("shown", *m) for m in shown]

    def ring(s: dict, at: int) -> tuple[dict, list[tuple]]:
        name, s["active"] = s["active"], None
        return s, [("expired", name, None, at, None)]

    alarm = lambda s: None if s["active"] is None else s["last"] + ttl_ms
    return TimedOperator(step, plain.initial, "event string, " + plain.output, alarm, ring)


def coalesced_partials(wait_ms: int = 250) -> TimedOperator:
    """rows (ms, epoch, sequence, revision, text) -> (ms, epoch, sequence, revision, text, n): the newest of the partials that come within a wait.

    The first partial starts the wait, later ones do not prolong it; when it is over, the newest by (epoch, sequence, revision) goes out,
    n says of how many. Rows with a null or a blank text take no part. What is older than the last that went out is dropped.
    """

    def step(s: dict, row: dict) -> tuple[dict, list[tuple]]:
        if _missing(row, "epoch", "sequence", "revision", "text") or not row["text"].strip():
            return s, []
        version = [int(row[c]) for c in ("epoch", "sequence", "revision")]
        if s["sent"] is not None and version <= s["sent"]:
            return s, []
        if s["until"] is None:
            s.update(until=int(row["ms"]) + wait_ms, n=0, best=None)
        s["n"] += 1
        if s["best"] is None or version >= s["best"][:3]:
            s["best"] = [*version, row["text"]]
        return s, []

    def ring(s: dict, at: int) -> tuple[dict, list[tuple]]:
        out = (at, *s["best"], s["n"])
        s.update(until=None, sent=s["best"][:3])
        return s, [out]

    first = {"until": None, "best": None, "n": 0, "sent": None}
    return TimedOperator(step, first, "ms long, epoch long, sequence long, revision long, text string, n long", lambda s: s["until"], ring)


def settling(quiet_ms: int = 2_000) -> TimedOperator:
    """rows (ms, size) of a file -> (ms, size): a file whose size has not changed for that long; every look at it tells its size.

    Empty files, and files without a size, do not settle. A file that changes after it has settled settles again.
    """

    def step(s: dict, row: dict) -> tuple[dict, list[tuple]]:
        size = 0 if _missing(row, "size") else int(row["size"])
        if size != s["size"]:
            s.update(size=size, until=int(row["ms"]) + quiet_ms if size > 0 else None)
        return s, []

    def ring(s: dict, at: int) -> tuple[dict, list[tuple]]:
        s["until"] = None
        return s, [(at, s["size"])]

    return TimedOperator(step, {"size": None, "until": None}, "ms long, size long", lambda s: s["until"], ring)


def reattribution(horizon_ms: int = 600_000) -> TimedOperator:
    """rows (ms, line, speaker, start, end) of a session -> (line, speaker, overlap, revision): who speaks a line, told anew when it changes.

    A row with a line is an utterance, one with a speaker alone a segment, [start, end) in ms of the session's clock; both come in any order. A line's
    speaker is the one of the greatest total overlap, of equals the least; without overlap nothing is told. Repeated utterances count once, rows without
    a start, an end or both ids not at all.
    Rows are held until the session has been quiet for `horizon_ms`; a session is a meeting, so its rows are bounded by its length.
    """

    def tell(s: dict, line: str) -> list[tuple]:
        own = s["lines"][line]
        if not own["by"]:
            return []
        speaker, overlap = min(own["by"].items(), key=lambda x: (-x[1], int(x[0])))
        if speaker == own["told"]:
            return []
        own.update(told=speaker, revision=own["revision"] + 1)
        return [(int(line), int(speaker), overlap, own["revision"])]

    def meet(own: dict, speaker: str, start: int, end: int) -> bool:
        overlap = min(own["end"], end) - max(own["start"], start)
        if overlap > 0:
            own["by"][speaker] = own["by"].get(speaker, 0) + overlap
        return overlap > 0

    def step(s: dict, row: dict) -> tuple[dict, list[tuple]]:
        s["until"] = int(row["ms"]) + horizon_ms
        if _missing(row, "start", "end") or (_missing(row, "line") and _missing(row, "speaker")):
            return s, []
        start, end = int(row["start"]), int(row["end"])
        if not _missing(row, "line"):
            line = str(int(row["line"]))
            if line in s["lines"]:
                return s, []
            s["lines"][line] = {"start": start, "end": end, "by": {}, "told": None, "revision": 0}
            for segment in s["segments"]:
                meet(s["lines"][line], *segment)
            return s, tell(s, line)
        segment = [str(int(row["speaker"])), start, end]
        s["segments"].append(segment)
        return s, [m for line, own in s["lines"].items() if meet(own, *segment) for m in tell(s, line)]

    def ring(s: dict, at: int) -> tuple[dict, list[tuple]]:
        return {"lines": {}, "segments": [], "until": None}, []

    first = {"lines": {}, "segments": [], "until": None}
    return TimedOperator(step, first, "line long, speaker long, overlap long, revision long", lambda s: s["until"], ring)
