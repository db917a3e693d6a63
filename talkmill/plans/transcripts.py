"""Named queries over transcripts and extraction; the SQL-expressible ones with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.functions import noise
from talkmill.functions import text as T
from talkmill.operators import cleaning, extraction
from talkmill.operators import titles as named
from talkmill.tables import dealt, load, tasks

#: Documents a task, where lines of a document must meet.
EACH = 5_000


def _summaries(spark: SparkSession, sf: str) -> DataFrame:
    """A summary with sections for each conversation: its turns as items."""
    t = load(spark, sf, "conversations")
    first = F.translate("text", "\n", " ")
    item = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("@"), "role", F.lit(": "), first, F.lit(" by friday 12)")))
    item = item.when(F.col("turn") % 4 == 1, F.concat(F.lit("We decided: "), first)).when(F.col("turn") % 4 == 2, F.concat(F.lit("Maybe "), first)).otherwise(F.concat(F.lit("@user: "), first, F.lit(" (due monday)")))
    name = F.when(F.col("turn") % 4 == 0, "Action Items").when(F.col("turn") % 4 == 1, "Decisions").when(F.col("turn") % 4 == 2, "Open Questions").otherwise("Commitments")
    part = F.concat(F.lit("## "), name, F.lit("\n- "), item, F.lit("\n```\n## not a section\n- no item\n```"))
    return t.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))), lambda x: x["p"]), "\n").alias("text"))


def summary_intents(spark: SparkSession, sf: str) -> DataFrame:
    """Intents from the sections of summaries."""
    return extraction.intents(extraction.sections(_summaries(spark, sf))).drop("pos")


def summary_insights(spark: SparkSession, sf: str) -> DataFrame:
    """Insights from intents, deduplicated."""
    return extraction.insights(extraction.intents(extraction.sections(_summaries(spark, sf))))


def entity_links(spark: SparkSession, sf: str) -> DataFrame:
    """Entities by slug with a label and aliases."""
    name = F.regexp_extract("text", r"^(\p{L}++(?:[ -]\p{L}++)*+)", 1)
    rows = load(spark, sf, "documents").select(F.when(F.col("doc_id") % 3 == 0, F.translate(name, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(name).alias("name"))
    return extraction.entities(rows).select("slug", "label", F.array_join("aliases", " | ").alias("aliases"), "n")


def memo_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Derived tags and merged attendees of conversations."""
    t = load(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("roles"), F.count("*").alias("n"), F.max("turn").alias("last"))
    tags = extraction.derived_tags(F.col("roles"), F.array(F.concat(F.lit("Topic "), F.col("n") % 5)), F.array(F.concat(F.lit("Project "), F.col("last"))), F.lit("Voice Memo"), F.col("n") > 4)
    people = extraction.merged_attendees(F.col("roles"), F.lit("User, guest;  ,SYSTEM"))
    return t.select("conv_id", F.array_join(tags, ",").alias("tags"), F.array_join(people, ",").alias("attendees"))


def speaker_names(spark: SparkSession, sf: str) -> DataFrame:
    """Transcripts with speaker labels replaced by confirmed names."""
    t = load(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.col("role").alias("speaker"), "text")
    names = t.select("doc_id", F.col("speaker").alias("label")).distinct().select("doc_id", "label", F.concat(F.lit("Person "), F.col("doc_id") % 10).alias("name"), F.when(F.col("label") == "user", "high").otherwise("medium").alias("confidence"))
    return extraction.humanised(t, names)


def transcript_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Segments as transcript texts, with their numbers."""
    t = load(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("double").alias("pos"), F.concat(F.lit("["), "role", F.lit("] "), "text").alias("line"))
    stats = t.groupBy("doc_id").agg(F.count("*").alias("segments"), F.sum(F.size(T.words(F.col("line"))) - 1).alias("words"))
    return cleaning.transcript_text(t).select("doc_id", F.md5("text").alias("md5")).join(stats, "doc_id")


def speaker_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """The latest confirmed value over the base value."""
    e = load(spark, sf, "events").select("user_id", "event_type", F.col("event_id").alias("at"), F.concat("event_type", F.lit("-"), "event_id").alias("value"))
    base = e.where("at % 5 > 0").groupBy("user_id", "event_type").agg(F.min_by("value", "at").alias("value"))
    return extraction.overlay(base, e.where("at % 50 = 0"), ["user_id", "event_type"])


def _transcript(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the documents, with noise mixed in by line number."""
    lines = cleaning.lines_of(load(spark, sf, "documents"), "doc_id", "text")
    n = (F.col("doc_id") + F.col("pos")).cast("long")
    line = F.when(n % 11 == 0, "[0:01] Thank you for watching!").when(n % 7 == 0, "[0:02] [soft music]").when(n % 13 == 0, "[0:03] 東京は夜です").when(n % 17 == 0, "[1:00] (see attached)").otherwise(F.concat(F.lit("[0:09] "), "line"))
    return lines.withColumn("line", line)


def noise_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Lines by what they are."""
    text = noise.text_part(F.col("line"))
    rows = _transcript(spark, sf).select("doc_id", noise.known_phrase(text).alias("phrase"), noise.noise_marker(text).alias("marker"), noise.script(text).alias("script"))
    return rows.groupBy("phrase", "marker", "script").agg(F.count("*").alias("n"))


def script_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that stay in the leading script."""
    return cleaning.drop_foreign_script(_transcript(spark, sf)).groupBy("doc_id").agg(F.count("*").alias("n"))


def noise_collapse(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of markers collapsed, ends trimmed."""
    lines = cleaning.lines_of(load(spark, sf, "documents"), "doc_id", "text")
    n = (F.col("doc_id") + F.col("pos")).cast("long")
    lines = lines.withColumn("line", F.when(n % 10 < 6, "[0:01] (applause)").when(n % 3 == 0, "[Music]").otherwise("[0:02] words"))
    lines = dealt(lines, tasks(spark, sf, "documents", EACH), "doc_id")
    return cleaning.collapse_noise(cleaning.trim_end(cleaning.drop_commands(lines))).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("line").contains("collapsed")).alias("notes"))


def clean_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    """The whole cleaning, in its order."""
    return cleaning.clean_stats(_transcript(spark, sf), tasks(spark, sf, "documents", EACH))


def sentence_counts(spark: SparkSession, sf: str) -> DataFrame:
    """C20: sentences of each document."""
    return load(spark, sf, "documents").select("doc_id", cleaning.sentence_ends(F.coalesce("text", F.lit(""))).cast("long").alias("sentences"))


def recognition_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Word error rate of a turn against the turn before."""
    t = load(spark, sf, "conversations")
    nxt = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("said"))
    rows = cleaning.word_error_rate(t.select("conv_id", "turn", F.col("text").alias("heard")).join(nxt, ["conv_id", "turn"]), "said", "heard")
    return rows.select("conv_id", "turn", F.round("wer", 6).alias("wer"))


def topic_keywords(spark: SparkSession, sf: str) -> DataFrame:
    """Keyword overlap of each turn with the one before, and cues."""
    t = load(spark, sf, "conversations").select("conv_id", "turn", T.keywords(F.col("text")).alias("k"), T.contains_any(F.col("text"), T.DECISIVE_CUES).alias("decisive"))
    nxt = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("k").alias("before"))
    rows = t.join(nxt, ["conv_id", "turn"])
    union = F.size(F.array_union("k", "before"))
    return rows.select("conv_id", "turn", F.size("k").cast("long").alias("n"), F.when(union > 0, F.round(F.size(F.array_intersect("k", "before")) / union, 6)).otherwise(0.0).alias("overlap"), "decisive")


def recording_titles(spark: SparkSession, sf: str) -> DataFrame:
    """A title for each conversation, from a context or its first line, with the rule that gave or refused it."""
    t, kind = load(spark, sf, "conversations"), F.col("conv_id") % 8
    begin = F.when(kind == 0, "Okay, so. Let's talk about ").when(kind == 1, "[0:00] well, ").when(kind == 2, "I want to discuss the API and ").when(kind == 3, "This is just a test: ")
    first = begin.when(kind == 4, "Hello there\n").when(kind == 5, "東京は夜です\n").when(kind == 6, "[music] \n").otherwise("")
    lines = t.select("conv_id", F.col("turn").alias("pos"), F.concat(F.lit("["), "role", F.lit("] "), F.when(F.col("turn") == 0, first).otherwise(""), F.coalesce("text", F.lit(""))).alias("text"))
    about = F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit(" pricing  review of the Q"), F.col("conv_id"), F.lit(" deal. Second part"))).when(F.col("conv_id") % 5 == 1, "Voice  Memo")
    return named.titles(lines, t.select("conv_id", about.alias("context")).distinct(), "conv_id")


QUERIES = {f.__name__: f for f in (
    recording_titles, summary_intents, summary_insights, entity_links, memo_tags, speaker_names, transcript_texts, speaker_overlay, noise_flags, script_filter, noise_collapse, clean_transcripts, sentence_counts,
    recognition_errors, topic_keywords,
)}

_FIRST = "translate(text, chr(10), ' ')"
_INTENTS = rf"""WITH t AS (SELECT conv_id AS doc_id, turn, turn % 4 AS k, role, {_FIRST} AS f FROM conversations),
    i AS (SELECT doc_id, turn, k, CASE k WHEN 0 THEN trim('@' || role || ': ' || f || ' by friday 12)') WHEN 1 THEN trim('We decided: ' || f) WHEN 2 THEN trim('Maybe ' || f) ELSE trim('@user: ' || f || ' (due monday)') END AS item, role, f FROM t),
    p AS (SELECT doc_id, k AS place, CASE k WHEN 0 THEN 'action-item' WHEN 1 THEN 'decision' WHEN 2 THEN 'open-question' ELSE 'commitment' END AS kind,
        CASE WHEN k IN (0, 3) THEN trim(regexp_replace(trim(regexp_extract(item, '^@[^:]*:(.*)$', 1)), '\)+$', '')) ELSE item END AS what,
        CASE k WHEN 0 THEN role WHEN 3 THEN 'user' END AS who, CASE k WHEN 1 THEN 'decided' ELSE 'open' END AS status,
        CASE WHEN k IN (0, 3) THEN coalesce(nullif(trim(regexp_extract(lower(item), ' by ([\pL\pN -]*)', 1)), ''), nullif(trim(regexp_extract(lower(item), 'due ([\pL\pN -]*)', 1)), '')) END AS by_date FROM i)"""
_NAME = "CASE WHEN doc_id % 3 = 0 THEN translate(regexp_extract(text, '^([\\pL]+(?:[ -][\\pL]+)*)', 1), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE regexp_extract(text, '^([\\pL]+(?:[ -][\\pL]+)*)', 1) END"
_STOP = ", ".join(f"'{w}'" for w in T.KEYWORD_STOPWORDS)
_CUES = " OR ".join(f"contains(lower(text), '{c.replace(chr(39), chr(39) * 2)}')" for c in T.DECISIVE_CUES)

_LIST = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words)
_LINES = rf"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents),
    m AS (SELECT doc_id, pos, CASE WHEN (doc_id + pos) % 11 = 0 THEN '[0:01] Thank you for watching!' WHEN (doc_id + pos) % 7 = 0 THEN '[0:02] [soft music]' WHEN (doc_id + pos) % 13 = 0 THEN '[0:03] 東京は夜です'
        WHEN (doc_id + pos) % 17 = 0 THEN '[1:00] (see attached)' ELSE '[0:09] ' || raw END AS line FROM l), t AS (SELECT doc_id, pos, substring(line, instr(line, '] ') + 2) AS text FROM m),
    a AS (SELECT *, trim(regexp_replace(trim(lower(text), ' '), '[.!?,;:]+$', ''), ' ') AS p, regexp_replace(trim(text, ' '), '\.$', '') AS s, length(regexp_replace(text, '[^\pL]', '', 'g')) AS letters,
        length(regexp_replace(text, '[^A-Za-zÀ-ɏḀ-ỿ]|[^\pL]', '', 'g')) AS latin, length(regexp_replace(text, '[^一-鿿㐀-䶿぀-ヿ가-힯]|[^\pL]', '', 'g')) AS cjk FROM t),
    b AS (SELECT *, substring(s, 2, greatest(length(s) - 2, 0)) AS inn FROM a), c AS (SELECT *, list_filter(regexp_split_to_array(inn, '\s+'), lambda w: w <> '') AS w FROM b),
    flags AS (SELECT doc_id, pos, p <> '' AND (p IN ({_LIST(noise.PHRASES)}) OR {" OR ".join(f"starts_with(p, '{x}')" for x in noise.PHRASE_PREFIXES)} OR regexp_matches(p, '^(www\.|http://|https://)')) AS phrase,
        regexp_matches(s, '(?s)^(\[.*\]|\(.*\))$') AND NOT starts_with(trim(text, ' '), '[...]') AND NOT regexp_full_match(inn, '[0-9:]*') AND len(w) BETWEEN 1 AND 4 AND strlen(inn) <= 40 AND coalesce(lower(w[-1]) IN ({_LIST(noise.NOISE_WORDS)}), false) AS marker,
        CASE WHEN letters = 0 THEN NULL WHEN latin * 2 >= letters THEN 'latin' WHEN cjk * 2 >= letters THEN 'cjk' ELSE 'other' END AS script FROM c)"""

#: A title as it is shown, of an expression.
_SHOWN = lambda text: rf"""array_to_string(list_transform(list_filter(string_split(regexp_extract(trim({text}, '{named.PUNCTUATION.replace("'", "''")}'), '^[^.!?]*'), ' '), lambda w: w <> ''), lambda w, k:
    CASE WHEN regexp_matches(w, '[0-9]') OR length(regexp_replace(w, '[^A-Z]', '', 'g')) > 1 THEN w WHEN k > 1 AND lower(w) IN ({_LIST(named.SMALL_WORDS)}) THEN lower(w) ELSE upper(lower(w)[1]) || lower(w)[2:] END), ' ')"""  # noqa: E731
_TITLES = rf"""WITH t AS (SELECT conv_id, turn, '[' || role || '] ' || CASE WHEN turn > 0 THEN '' WHEN conv_id % 8 = 0 THEN 'Okay, so. Let''s talk about ' WHEN conv_id % 8 = 1 THEN '[0:00] well, ' WHEN conv_id % 8 = 2 THEN 'I want to discuss the API and '
        WHEN conv_id % 8 = 3 THEN 'This is just a test: ' WHEN conv_id % 8 = 4 THEN 'Hello there' || chr(10) WHEN conv_id % 8 = 5 THEN '東京は夜です' || chr(10) WHEN conv_id % 8 = 6 THEN '[music] ' || chr(10) ELSE '' END || coalesce(text, '') AS text FROM conversations),
    l AS (SELECT conv_id, turn, generate_subscripts(string_split(text, chr(10)), 1) AS k, unnest(string_split(text, chr(10))) AS raw FROM t),
    c AS (SELECT conv_id, turn, k, trim(regexp_replace(regexp_replace(raw, '^(?:{named.SPACE}*\[[^\]]*\])+', ''), '{named.SPACE}+', ' ', 'g'), ' ') AS line FROM l),
    f AS (SELECT conv_id, arg_min(line, [turn, k]) FILTER (line <> '' AND NOT starts_with(line, '[')) AS line, CASE WHEN conv_id % 5 = 0 THEN 'pricing review of the Q' || conv_id || ' deal. Second part' END AS context FROM c GROUP BY conv_id),
    b AS (SELECT *, trim(regexp_replace(regexp_replace(line, '(?i)^(?:(?:{"|".join(named.FILLERS)})(?:[,.!? ]+|$))+', ''), '(?i)^(?:{"|".join(named.LEAD_INS).replace("'", "''")})', ''), ' ') AS cand FROM f),
    w AS (SELECT *, list_filter(list_transform(string_split(lower(cand), ' '), lambda x: regexp_extract(x, '{named.KEPT.replace("'", "''")}(?:.*{named.KEPT.replace("'", "''")})?')), lambda x: x <> '') AS w FROM b),
    r AS (SELECT *, CASE WHEN context IS NOT NULL THEN 'context' WHEN line IS NULL THEN 'silent' WHEN len(w) <= 4 AND w[1] IN ({_LIST(named.GREETINGS)}) THEN 'greeting'
        WHEN {" OR ".join(f"starts_with(array_to_string(w, ' '), '{x}')" for x in named.PLAIN_BEGINNINGS)} OR len(list_filter(w, lambda x: x NOT IN ({_LIST(named.PLAIN_WORDS)}))) = 0 THEN 'plain'
        WHEN length(regexp_replace(cand, '{named.NOT_LATIN}', '', 'g')) * 2 < length(regexp_replace(cand, '[^\pL]', '', 'g')) THEN 'script' ELSE 'transcript' END AS rule FROM w),
    s AS (SELECT conv_id, rule, CASE rule WHEN 'context' THEN {_SHOWN("context")} WHEN 'transcript' THEN {_SHOWN("cand")} ELSE '{named.UNTITLED}' END AS title FROM r)
    SELECT conv_id, CASE WHEN length(title) > 60 THEN title[1:57] || '...' ELSE title END AS title, rule FROM s"""

ORACLE_SQL = {
    "recording_titles": _TITLES,
    "transcript_texts": """SELECT conv_id AS doc_id, md5(string_agg('[' || role || '] ' || text, chr(10) ORDER BY turn)) AS md5, count(*) AS segments, sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')))::BIGINT AS words FROM conversations GROUP BY 1""",
    "noise_flags": _LINES + " SELECT phrase, marker, script, count(*) AS n FROM flags GROUP BY 1, 2, 3",
    "script_filter": _LINES + """, n AS (SELECT doc_id, count(script) AS n, count(*) FILTER (script = 'latin') AS a, count(*) FILTER (script = 'cjk') AS b, count(*) FILTER (script = 'other') AS c FROM flags GROUP BY 1),
        d AS (SELECT doc_id, CASE WHEN n < 2 THEN NULL WHEN a >= 0.7 * n THEN 'latin' WHEN b >= 0.7 * n THEN 'cjk' WHEN c >= 0.7 * n THEN 'other' END AS main_script FROM n)
        SELECT doc_id, count(*) AS n FROM flags JOIN d USING (doc_id) WHERE script IS NULL OR main_script IS NULL OR script = main_script GROUP BY 1""",
    "summary_intents": _INTENTS + " SELECT * FROM p",
    "entity_links": f"""WITH n AS (SELECT {_NAME} AS name FROM documents), s AS (SELECT name, regexp_replace(regexp_replace(lower(name), '[^\\pL\\pN]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM n WHERE name <> '')
        SELECT slug, min(name) AS label, string_agg(DISTINCT lower(name), ' | ' ORDER BY lower(name)) AS aliases, count(*) AS n FROM (SELECT * FROM s) GROUP BY slug""",
    "memo_tags": """WITH t AS (SELECT conv_id, list_sort(list_distinct(list(role))) AS roles, count(*) AS n, max(turn) AS last FROM conversations GROUP BY 1)
        SELECT conv_id, array_to_string((['source-voice-memo'] || CASE WHEN n > 4 THEN ['has-actions'] ELSE [] END || list_transform(roles[1:3], lambda r: 'person-' || r) || ['topic-topic-' || (n % 5)] || ['project-project-' || last])[1:8], ',') AS tags,
            array_to_string(roles || CASE WHEN list_contains(roles, 'user') THEN [] ELSE ['User'] END || ['guest'] || CASE WHEN list_contains(roles, 'system') THEN [] ELSE ['SYSTEM'] END, ',') AS attendees FROM t""",
    "speaker_names": "SELECT conv_id AS doc_id, turn AS pos, '[' || CASE WHEN role = 'user' THEN 'Person ' || (conv_id % 10) ELSE role END || '] ' || text AS line FROM conversations",
    "speaker_overlay": """WITH b AS (SELECT user_id, event_type, arg_min(event_type || '-' || event_id, event_id) AS value FROM events WHERE event_id % 5 > 0 GROUP BY 1, 2),
        c AS (SELECT user_id, event_type, arg_max(event_type || '-' || event_id, event_id) AS confirmed FROM events WHERE event_id % 50 = 0 GROUP BY 1, 2)
        SELECT user_id, event_type, coalesce(confirmed, value) AS value, confirmed IS NOT NULL AS overridden FROM b FULL JOIN c USING (user_id, event_type)""",
    "topic_keywords": f"""WITH t AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\pL\\pN]+'), lambda w: strlen(w) >= 4 AND w NOT IN ({_STOP}))) AS k, ({_CUES}) AS decisive FROM conversations)
        SELECT a.conv_id, a.turn, len(a.k) AS n, CASE WHEN len(list_distinct(a.k || b.k)) > 0 THEN round(len(list_intersect(a.k, b.k)) / len(list_distinct(a.k || b.k)), 6) ELSE 0.0 END AS overlap, a.decisive
        FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1""",
}
