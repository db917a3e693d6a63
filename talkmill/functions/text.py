"""Text functions as Column expressions: slugs, topics, names, deadlines, cues."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TOPIC_STOPWORDS = ("a", "an", "and", "as", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with", "we", "should", "will", "be", "is", "are", "use", "using")
TITLE_STOPWORDS = (*TOPIC_STOPWORDS, "meeting", "call", "sync", "chat", "discussion", "review", "update", "weekly", "daily", "standup")
KEYWORD_STOPWORDS = (
    "about", "after", "again", "also", "because", "been", "before", "being", "could", "from", "have", "into", "just", "more", "next", "only", "other", "should",
    "that", "their", "there", "these", "they", "this", "those", "through", "today", "very", "want", "were", "what", "when", "where", "which", "while", "with", "would", "your",
)
EXPLICIT_CUES = ("we decided", "we agreed", "decision:", "approved", "we will", "we're going with", "final decision", "confirmed")
TENTATIVE_CUES = ("we should consider", "might want to", "we could", "possibly", "maybe", "thinking about")
DECISIVE_CUES = ("we decided", "we agreed", "decision is", "approved", "rejected", "go with", "final answer", "i will", "we will", "we'll")
TRANSITION_CUES = ("moving on", "next topic", "switching to", "turn to", "separately", "new subject")
CONFIDENCE = ("tentative", "inferred", "strong", "explicit")


def words(text: Column) -> Column:
    """The words between white space; none for a null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def contains_any(text: Column, cues: tuple[str, ...]) -> Column:
    """Whether the lower-cased text contains a cue."""
    low = F.lower(text)
    found = F.lit(False)
    for cue in cues:
        found = found | low.contains(cue)
    return found


def slugify(name: Column) -> Column:
    """Letters and digits in lower case, other runs as one hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")


def normalize_topic(text: Column) -> Column:
    """The first four words that are no stopwords, lower-cased, without punctuation at their ends."""
    bare = F.transform(words(text), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    own = F.filter(bare, lambda w: (w != "") & ~F.lower(w).isin(*TOPIC_STOPWORDS))
    return F.array_join(F.transform(F.slice(own, 1, 4), F.lower), " ")


def normalize_decision(text: Column) -> Column:
    """ASCII letters in lower case, all but letters, digits and single blanks gone."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " "))


def _unit_seconds(text: Column, unit: str, seconds: int) -> Column:
    numbers = F.regexp_extract_all(text, F.lit(f"([0-9]+){unit}"), F.lit(1))
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, n: a + n.cast("long") * seconds)


def duration_seconds(text: Column) -> Column:
    """Seconds of `1h 2m 3s`; null if there are none."""
    total = _unit_seconds(text, "h", 3600) + _unit_seconds(text, "m", 60) + _unit_seconds(text, "s", 1)
    return F.when(total > 0, total)


def clock_seconds(text: Column) -> Column:
    """Seconds of `1h 2m`, `23:45` or `1:02:03`; null if it is none of these."""
    parts = F.split(F.trim(text), ":")
    clock = F.aggregate(F.transform(parts, lambda p: F.expr("0L") + p.try_cast("long")), F.lit(0).cast("long"), lambda a, p: a * 60 + p)
    return F.when(F.trim(text).rlike("^[0-9]+(:[0-9]{1,2}){1,2}$"), clock).otherwise(duration_seconds(text))


def title_keywords(title: Column) -> Column:
    """Words of over three bytes that are no stopwords, in order."""
    own = F.split(F.lower(title), r"[^\p{L}\p{N}]+")
    return F.filter(own, lambda w: (F.octet_length(w) > 3) & ~w.isin(*TITLE_STOPWORDS))


def keywords(text: Column) -> Column:
    """Distinct words of at least four bytes that are no stopwords, sorted."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own = F.filter(F.split(low, r"[^\p{L}\p{N}]+"), lambda w: (F.octet_length(w) >= 4) & ~w.isin(*KEYWORD_STOPWORDS))
    return F.array_sort(F.array_distinct(own))


def speaker_labels(body: Column) -> Column:
    """Distinct speakers of lines such as `[SARAH CHEN 0:45] text`, title-cased, in order."""
    names = F.regexp_extract_all(body, F.lit(r"(?m)^\s*\[([^\]]*\S)\s+[0-9:]*:[0-9:]*\s*\]"), F.lit(1))
    return F.array_distinct(F.transform(names, lambda n: F.initcap(F.regexp_replace(F.trim(n), r"\s+", " "))))


def names_likely_same(a: Column, b: Column) -> Column:
    """One name shortens the other: equal first words, and equal second words or another number of words."""
    left, right = words(F.lower(a)), words(F.lower(b))
    both = (F.size(left) >= 2) & (F.size(right) >= 2)
    rest = F.when(both, F.get(left, F.lit(1)) == F.get(right, F.lit(1))).otherwise(F.size(left) != F.size(right))
    return F.coalesce((F.lower(a) != F.lower(b)) & (F.get(left, F.lit(0)) == F.get(right, F.lit(0))) & rest, F.lit(False))


#: Letters with accents and what they fold to.
ACCENTS = ("áàâäãåéèêëíìîïóòôöõúùûüçñýÿ", "aaaaaaeeeeiiiiooooouuuucnyy")


def folded(name: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(name), *ACCENTS)


def compact_key(name: Column) -> Column:
    """The folded letters and digits of a name."""
    return F.regexp_replace(folded(name), r"[^\p{L}\p{N}]", "")


def plausibly_same(a: Column, b: Column) -> Column:
    """`separator_variant` for equal compact keys of three or more, `phonetic_edit` for single ASCII words with one initial
    and one edit (two, if the shorter has six letters), else null."""
    ka, kb = compact_key(a), compact_key(b)
    na, nb = F.trim(folded(a)), F.trim(folded(b))
    single = (F.size(words(na)) == 1) & (F.size(words(nb)) == 1) & (F.octet_length(na) == F.length(na)) & (F.octet_length(nb) == F.length(nb))
    budget = F.when(F.least(F.length(na), F.length(nb)) >= 6, 2).otherwise(1)
    close = single & (F.substring(na, 1, 1) == F.substring(nb, 1, 1)) & F.levenshtein(na, nb, 2).between(0, budget)
    return F.when((ka == "") | (kb == ""), None).when(ka == kb, F.when(F.length(ka) >= 3, "separator_variant")).when(close, "phonetic_edit")


def name_rank(slug: Column, name: Column) -> Column:
    """Of the names of one slug, the least of these is preferred: slug match, more words, more letters, then the order."""
    return F.struct((slugify(name) != slug).alias("a"), (-F.size(words(name))).alias("b"), (-F.length(name)).alias("c"), F.lower(name).alias("d"), name.alias("name"))


def days_since(moment: Column, as_of: Column) -> Column:
    """Whole hours over 24, at least 0; 999 if there is no moment."""
    hours = F.floor(F.timestamp_diff("SECOND", moment, as_of) / 3600)
    return F.when(moment.isNull(), 999.0).otherwise(F.greatest(hours / 24.0, F.lit(0.0)))


def commitment_status(status: Column, due: Column, as_of: Column) -> Column:
    """`stale` or `open`, null for other statuses; an open one is stale after its due date (text) or moment."""
    day = F.when(due.rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), due.try_cast("date"))
    late = F.coalesce(as_of.cast("date") > day, as_of.cast("timestamp") > F.when(day.isNull() & due.contains("T"), due.try_cast("timestamp")), F.lit(False))
    return F.when(status == "stale", "stale").when(status == "open", F.when(late, "stale").otherwise("open"))


def owner_prefix(text: Column) -> Column:
    """struct(owner, content) of `@owner: content`; a null owner and the text itself otherwise."""
    owner = F.trim(F.regexp_extract(text, r"^@([^:]*):", 1))
    return F.when(owner != "", F.struct(owner.alias("owner"), F.trim(F.regexp_extract(text, r"(?s)^@[^:]*:(.*)$", 1)).alias("content"))).otherwise(
        F.struct(F.lit(None).cast("string").alias("owner"), text.alias("content"))
    )


def inline_deadline(text: Column) -> Column:
    """The deadline in `(due x)`, `(by x)`, `(deadline x)`, or of a first bare `by x` of at most 30 bytes; else null."""
    low = F.lower(text)
    quoted = F.coalesce(*(F.when(low.rlike(rf"\({w} [^)]*\)"), F.trim(F.regexp_extract(low, rf"\({w} ([^)]*)\)", 1))) for w in ("due", "by", "deadline")))
    first = F.locate("by ", low)
    bounded = (first == 1) | ~F.substring(low, first - 1, F.lit(1)).rlike("[a-z]")
    bare = F.trim(F.regexp_extract(F.substring(low, first + 3, F.length(low)), r"^([\p{L}\p{N} /-]*)", 1))
    return F.coalesce(quoted, F.when((first > 0) & bounded & (bare != "") & (F.octet_length(bare) <= 30), bare))


def topic_prefix(text: Column) -> Column:
    """What stands before the first `: `, ` – ` or ` — `, if it has 2 to 60 bytes."""

    def before(mark: str) -> Column:
        part = F.trim(F.substring_index(text, mark, 1))
        return F.when(text.contains(mark) & F.octet_length(part).between(2, 60), part)

    return F.coalesce(before(": "), before(" – "), before(" — "))


def decision_confidence(text: Column) -> Column:
    return F.when(contains_any(text, EXPLICIT_CUES), "explicit").when(contains_any(text, TENTATIVE_CUES), "tentative").otherwise("strong")


def confidence_rank(name: Column) -> Column:
    """The place of a confidence, from 0; null for an unknown one."""
    at = F.array_position(F.array(*map(F.lit, CONFIDENCE)), name)
    return F.when(at > 0, at - 1)


def line_text(line: Column) -> Column:
    """The text of a transcript line, without a leading `[...]`."""
    return F.trim(F.regexp_replace(line, r"^\s*\[[^\]]*\]", ""))


def due_phrase(text: Column) -> Column:
    """The run of letters, digits, blanks and hyphens after ` by `, else after `due `; null if it is blank."""
    low = F.lower(text)
    run = lambda mark: F.trim(F.regexp_extract(low, rf"{mark}([\p{{L}}\p{{N}} -]*)", 1))
    return F.coalesce(F.when(run(" by ") != "", run(" by ")), F.when(run("due ") != "", run("due ")))


def footer_shape(line: Column) -> Column:
    """A line in lower case with runs of digits as one #, for recognising running headers."""
    return F.regexp_replace(F.lower(F.trim(line)), "[0-9]+", "#")


def snippet(text: Column, query: str, size: int = 200) -> Column:
    """The first line that contains the query, cut to `size` characters; the first line if none does."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    hit = F.filter(lines, lambda x: F.lower(x).contains(query.lower()))
    return F.substring(F.trim(F.coalesce(F.get(hit, F.lit(0)), F.get(lines, F.lit(0)), F.lit(""))), 1, size)


def size_bucket(octets: Column) -> Column:
    return F.when(octets < 1024, "under_1k").when(octets < 10 * 1024, "under_10k").when(octets < 1024 * 1024, "under_1m").otherwise("over_1m")


def age_bucket(days: Column) -> Column:
    return F.when(days < 30, "under_30_days").when(days < 365, "under_a_year").when(days < 3 * 365, "under_three_years").otherwise("older")
