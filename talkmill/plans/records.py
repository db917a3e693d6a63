"""Named queries over records around meetings, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.functions import text as T
from talkmill.operators import cleaning, extraction, filters, identity, records, reports
from talkmill.plans import mapping as M
from talkmill.plans.mapping import AS_OF, SQL
from talkmill.sources import logs
from talkmill.tables import load


def boost_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Phrases to expect."""
    return records.boost_phrases(M.meetings(spark, sf), 320)


def recent_memos(spark: SparkSession, sf: str) -> DataFrame:
    """Memos of the last days before a moment."""
    rows = M.meetings(spark, sf).where((F.col("type") == "memo") & (F.col("date") >= F.lit("2001-07-15").cast("timestamp_ntz")) & filters.unrestricted())
    return filters.newest(rows, 50).select("path", "date_text")


def _jobs(spark: SparkSession, sf: str) -> DataFrame:
    state = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "click", "running").when(F.col("event_type") == "purchase", "transcribing").otherwise("complete")
    return load(spark, sf, "events").select(F.col("event_id").alias("job"), state.alias("state"), F.col("event_id").alias("created"), (F.col("event_id") % 9).alias("owner"), (F.col("event_id") % 4).alias("retries"))


def job_list(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs by state and age, and the next one."""
    jobs = _jobs(spark, sf)
    return records.job_list(jobs, 90).select("job", "state").unionByName(records.next_job(jobs).select("job", F.lit("next").alias("state")))


def job_recovery(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs of lost owners."""
    jobs = _jobs(spark, sf)
    rows = logs.recovered_jobs(jobs, jobs.where("owner < 6").select("owner"))
    return rows.groupBy("state", "retries", "owner").agg(F.count("*").alias("n"))


def calendar_match(spark: SparkSession, sf: str) -> DataFrame:
    """The calendar entry of a meeting."""
    m = M.meetings(spark, sf).select("meeting_id", "title", F.date_format("date", "yyyy-MM-dd").alias("day"), F.hour("date").alias("at"))
    entries = m.select(F.col("meeting_id").alias("entry"), F.regexp_replace("title", "priority", "on").alias("title"), "day", (F.col("at") + F.col("meeting_id") % 7).alias("at"))
    return records.calendar_match(m, entries)


def withheld_owners(spark: SparkSession, sf: str) -> DataFrame:
    """Owners withheld where speakers were not told apart."""
    items = M.items(spark, sf)
    labels = items.groupBy("meeting_id").agg(F.count("*").alias("n_people"), F.count_distinct("topic").alias("n_labels"))
    return records.withheld_owners(items, labels).groupBy("kind", "withheld").agg(F.count("*").alias("n"), F.count("who").alias("owned"))


def unanimous_voices(spark: SparkSession, sf: str) -> DataFrame:
    """Speakers that one profile fits in all segments."""
    votes = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("meeting"), (F.col("l_linenumber") % 3).alias("speaker"), (F.col("l_suppkey") % 4).alias("profile"), F.col("l_quantity").alias("similarity"))
    return records.unanimous_voices(votes, 20.0)


def knowledge_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Facts by person."""
    return records.facts(M.meetings(spark, sf), M.items(spark, sf)).groupBy("person", "kind").agg(F.count("*").alias("facts"), F.sum("n").alias("n"))


def text_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in chunks of whole lines."""
    return records.chunks(load(spark, sf, "documents"), 200)


def live_text(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as live text, with noise and foreign lines mixed in."""
    rows = records.live_texts(_live_lines(spark, sf))
    return rows.select("doc_id", F.length("text").cast("long").alias("chars"), F.md5("text").alias("md5"))


def _live_lines(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, pos, line): the lines of each turn, some with a label, a marker or another script."""
    t = load(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    lines = cleaning.lines_of(t, "doc_id", "text")
    n = (F.col("doc_id") + 3 * F.col("pos")).cast("long")
    line = F.when(n % 5 == 0, "[music]").when(n % 7 == 0, "[0:07] 東京は夜です").when(n % 11 == 0, F.concat(F.lit("[0:08] I'll send it, "), "line")).otherwise(F.concat(F.lit("[0:09] "), "line"))
    return lines.withColumn("line", line)


def live_commitments(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that announce a commitment."""
    rows = records.commitment_lines(_live_lines(spark, sf))
    return rows.groupBy("doc_id", "phrase").agg(F.count("*").alias("n"), F.min("text").alias("first_text"))


def index_sync(spark: SparkSession, sf: str) -> DataFrame:
    """What a refresh of the index would do."""
    d = load(spark, sf, "documents").select("doc_id", F.md5("text").alias("revision"))
    old = d.where("doc_id % 10 > 0").withColumn("revision", F.when(F.col("doc_id") % 7 == 0, "x").otherwise(F.col("revision")))
    return records.sync_counters(old, d.where("doc_id % 11 > 0"), "doc_id")


def evidence_cards(spark: SparkSession, sf: str) -> DataFrame:
    """Excerpts of documents that match some alias, and why."""
    aliases = {"licence": ("licensed under", "released under"), "secret": ("token = ",), "contact": ("@mail", "+1 (")}
    rows = load(spark, sf, "documents").select("doc_id", records.why_matched(F.col("text"), aliases).alias("why"), records.excerpt(F.col("text"), 120).alias("excerpt"))
    return rows.where("why <> ''")


def canonical_people(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions resolved to people by alias and support."""
    people = M.meetings(spark, sf).groupBy("person").agg(F.count("*").alias("support")).select("person", F.regexp_replace("person", "#0000", "-").alias("alias"), "support")
    people = people.unionByName(people.select("person", F.regexp_replace("alias", "[0-9]$", "").alias("alias"), "support"))
    mentions = people.select(F.translate(F.lower("alias"), "-", " ").alias("mention")).distinct()
    return identity.canonical(mentions, people)


def name_corrections(spark: SparkSession, sf: str) -> DataFrame:
    """Words corrected to the one name they are near to."""
    first = F.regexp_extract("text", r"^(\p{L}++(?: \p{L}++)*+)", 1)
    rows = load(spark, sf, "documents").select("doc_id", F.explode(F.split(first, " ")).alias("w")).where("w <> ''")
    return records.name_corrections(rows.where("doc_id % 2 = 1").select(F.col("w").alias("token")), rows.where("doc_id % 2 = 0").select(F.col("w").alias("name")).distinct())


def answer_scorecard(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and ratios of answers."""
    rows = load(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderstatus")).alias("truth"), F.when(F.col("o_orderkey") % 5 > 0, F.when(F.col("o_custkey") % 4 > 0, F.col("o_orderstatus")).otherwise("F")).alias("said"))
    return records.scorecard(rows, "truth", "said")


def provider_route(spark: SparkSession, sf: str) -> DataFrame:
    """The provider of the least score for each user."""
    privacy = F.when(F.col("provider") == "view", "on_device").when(F.col("provider") == "click", "local_service").otherwise("cloud")
    rows = load(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("provider")).agg((F.max("event_id") % 700).alias("ms"), F.min("event_id").alias("place"), (F.max("value") <= 400).alias("usable"))
    return records.routed(rows.withColumn("privacy", privacy), "user_id", 300)


def session_links(spark: SparkSession, sf: str) -> DataFrame:
    """The latest link of each session and kind."""
    e = load(spark, sf, "events")
    links = e.select(F.col("user_id").alias("session"), F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").alias("target"), F.col("event_id").alias("at"))
    return records.latest_links(e.where("user_id % 3 = 0").select(F.col("user_id").alias("session")), links)


def regenerated_items(spark: SparkSession, sf: str) -> DataFrame:
    """Regenerated items merged with edited ones."""
    rows = M.items(spark, sf).where("kind = 'action-item'").select("meeting_id", "what", "status", (F.col("l_quantity") % 2 == 0).alias("edited"), "l_quantity")
    merged = extraction.merged_items(rows.where("l_quantity > 10").select("meeting_id", "what", "status", "edited"), rows.where("l_quantity < 30").select("meeting_id", "what", F.lit("kept").alias("status"), "edited"), ["meeting_id", "what"])
    return merged.groupBy("status", "edited").agg(F.count("*").alias("n"))


def battle_card(spark: SparkSession, sf: str) -> DataFrame:
    """People, commitments and earlier research before a meeting."""
    meetings, items = M.meetings(spark, sf), M.all_items(spark, sf)
    people = reports.relationship_map(meetings, items, AS_OF, 8).select(F.lit("person").alias("section"), F.col("person").alias("text"))
    due = reports.top_commitments(meetings, items, 10).select(F.lit("commitment").alias("section"), F.col("what").alias("text"))
    past = reports.research(meetings, items, "blue").where("section = 'decision'").select(F.lit("research").alias("section"), "text")
    return people.unionByName(due).unionByName(past)


QUERIES = {f.__name__: f for f in (
    boost_phrases, recent_memos, job_list, job_recovery, calendar_match, withheld_owners, unanimous_voices, knowledge_facts, text_chunks, live_text, live_commitments, index_sync, evidence_cards,
    canonical_people, name_corrections, answer_scorecard, provider_route, session_links, regenerated_items, battle_card,
)}

_JOBS = """WITH jobs AS (SELECT event_id AS job, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'transcribing' ELSE 'complete' END AS state, event_id % 9 AS owner, event_id % 4 AS retries FROM events)"""
_STOP = ", ".join(f"'{w}'" for w in T.TITLE_STOPWORDS)
_KEYS = "list_filter(regexp_split_to_array(lower({0}), '[^\\pL\\pN]+'), lambda w: strlen(w) > 3 AND w NOT IN (" + _STOP + "))"
_COMMITS = ", ".join(f"'{c.replace(chr(39), chr(39) * 2)}'" for c in records.COMMITMENT_PHRASES)
_FOLD = "regexp_replace(translate(lower({0}), 'áàâäãåéèêëíìîïóòôöõúùûüçñýÿ', 'aaaaaaeeeeiiiiooooouuuucnyy'), '[^\\pL\\pN]', '', 'g')"
#: The distance in characters: the letters that are longer than a byte after folding get one-byte stand-ins, as DuckDB counts bytes.
_APART = "levenshtein(translate(tk, 'ßœæøð', '01234'), translate(key, 'ßœæøð', '01234'))"

ORACLE_SQL = {
    "boost_phrases": SQL + f""", m AS (SELECT * FROM meetings), p AS (SELECT person AS phrase, 0 AS tier, -count(*) AS a, max(date) AS b FROM m GROUP BY 1
            UNION ALL SELECT w, 1, 0, max(date) FROM (SELECT unnest({_KEYS.format('title')}) AS w, date FROM m) GROUP BY 1),
        k AS (SELECT *, row_number() OVER (PARTITION BY lower(phrase) ORDER BY tier, a, b DESC, phrase) AS r FROM p)
        SELECT row_number() OVER (ORDER BY tier, a, b DESC, phrase) AS place, phrase FROM k WHERE r = 1 QUALIFY place <= 320""",
    "recent_memos": SQL + "SELECT path, date_text FROM meetings WHERE type = 'memo' AND date >= TIMESTAMP '2001-07-15' AND coalesce(sensitivity, 'normal') <> 'restricted' ORDER BY date DESC, path LIMIT 50",
    "job_list": _JOBS + """, j AS (SELECT * FROM jobs), f AS (SELECT job, state FROM j ORDER BY CASE state WHEN 'running' THEN 0 WHEN 'queued' THEN 1 WHEN 'failed' THEN 2 ELSE 3 END, job DESC LIMIT 90),
        n AS (SELECT job, 'next' AS state FROM j WHERE state = 'queued' ORDER BY job LIMIT 1) SELECT * FROM f UNION ALL SELECT * FROM n""",
    "job_recovery": _JOBS + """, l AS (SELECT *, state NOT IN ('complete', 'needs_review', 'failed') AND owner >= 6 AS lost FROM jobs),
        r AS (SELECT CASE WHEN NOT lost THEN state WHEN retries + 1 > 2 THEN 'failed' ELSE 'queued' END AS state, retries + lost::INT AS retries, CASE WHEN NOT lost THEN owner END AS owner FROM l)
        SELECT state, retries, owner, count(*) AS n FROM r GROUP BY 1, 2, 3""",
    "calendar_match": SQL + f""", m AS (SELECT meeting_id, {_KEYS.format('title')} AS w, {_KEYS.format("regexp_replace(title, 'priority', 'on')")} AS e, date::DATE AS day, hour(date) AS h FROM meetings)
        SELECT a.meeting_id, b.meeting_id AS entry FROM m a JOIN m b ON a.day = b.day AND len(list_intersect(a.w, b.e)) > 0
        QUALIFY row_number() OVER (PARTITION BY a.meeting_id ORDER BY abs(a.h - b.h - b.meeting_id % 7), b.meeting_id) = 1""",
    "withheld_owners": SQL + """, l AS (SELECT meeting_id, count(*) > 1 AND count(DISTINCT topic) <= 1 AS hidden FROM items GROUP BY 1)
        SELECT kind, hidden AND who IS NOT NULL AS withheld, count(*) AS n, count(CASE WHEN NOT hidden THEN who END) AS owned FROM items JOIN l USING (meeting_id) GROUP BY 1, 2""",
    "unanimous_voices": """WITH v AS (SELECT l_orderkey AS meeting, l_linenumber % 3 AS speaker, l_suppkey % 4 AS profile, l_quantity AS s FROM lineitem),
        g AS (SELECT meeting, speaker, min(profile) AS profile FROM v GROUP BY 1, 2 HAVING min(profile) = max(profile) AND min(s) >= 20) SELECT * FROM g QUALIFY count(*) OVER (PARTITION BY meeting, profile) = 1""",
    "knowledge_facts": SQL + """, f AS (SELECT who AS person, kind, what, count(*) AS n FROM items WHERE who IS NOT NULL GROUP BY 1, 2, 3 UNION ALL
            SELECT person, 'presence', 'attended', count(*) FROM meetings WHERE person NOT IN (SELECT who FROM items WHERE who IS NOT NULL) GROUP BY 1)
        SELECT person, kind, count(*) AS facts, sum(n)::BIGINT AS n FROM f GROUP BY 1, 2""",
    "live_commitments": f"""WITH l AS (SELECT conv_id * 1000 + turn AS doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM conversations),
        m AS (SELECT doc_id, pos, CASE WHEN (doc_id + 3 * pos) % 5 = 0 THEN '[music]' WHEN (doc_id + 3 * pos) % 7 = 0 THEN '[0:07] 東京は夜です' WHEN (doc_id + 3 * pos) % 11 = 0 THEN '[0:08] I''ll send it, ' || line ELSE '[0:09] ' || line END AS line FROM l),
        p AS (SELECT doc_id, trim(list_last(string_split(line, ']'))) AS text, list_filter([{_COMMITS}], lambda c: contains(lower(line), c))[1] AS phrase FROM m)
        SELECT doc_id, phrase, count(*) AS n, min(text) AS first_text FROM p WHERE phrase IS NOT NULL AND strlen(text) > 10 GROUP BY 1, 2""",
    "battle_card": SQL + f""", people AS (SELECT person_id, person, count(*) AS n, max(date) AS last_seen FROM meetings GROUP BY 1, 2), breadth AS (SELECT person_id, count(DISTINCT topic) AS t FROM meetings JOIN items USING (meeting_id) GROUP BY 1),
        scored AS (SELECT person, n, round(n / (1 + round(greatest(floor(date_diff('second', last_seen, TIMESTAMP '{AS_OF}') / 3600) / 24.0, 0.0), 6) / 30) * least(coalesce(t, 0) / 3, 1.0), 6) AS score FROM people LEFT JOIN breadth USING (person_id)),
        p AS (SELECT 'person' AS section, person AS text FROM scored ORDER BY score DESC, n DESC, person LIMIT 8),
        c AS (SELECT 'commitment' AS section, what AS text FROM items JOIN meetings USING (meeting_id) WHERE status = 'open' AND kind IN ('commitment', 'action-item') ORDER BY date DESC, what, person, kind, path LIMIT 10),
        d AS (SELECT 'research' AS section, what AS text FROM items JOIN meetings USING (meeting_id) WHERE kind = 'decision' AND contains(lower(concat_ws(' ', topic, what)), 'blue') ORDER BY date DESC, path, what, due, l_quantity LIMIT 10)
        SELECT * FROM p UNION ALL SELECT * FROM c UNION ALL SELECT * FROM d""",
    "regenerated_items": SQL + """, a AS (SELECT meeting_id, what, status, l_quantity % 2 = 0 AS edited, l_quantity AS q FROM items WHERE kind = 'action-item'), f AS (SELECT *, count(*) OVER (PARTITION BY meeting_id, what) AS c FROM a WHERE q > 10),
        b AS (SELECT *, count(*) OVER (PARTITION BY meeting_id, what) AS c FROM a WHERE q < 30), u AS (SELECT f.meeting_id, f.what, b.edited FROM f JOIN b ON f.meeting_id = b.meeting_id AND f.what = b.what AND f.c = 1 AND b.c = 1),
        m AS (SELECT CASE WHEN u.edited THEN 'kept' ELSE f.status END AS status, coalesce(u.edited, false) AS edited FROM f LEFT JOIN u USING (meeting_id, what)
            UNION ALL SELECT 'kept', edited FROM b WHERE edited AND NOT EXISTS (SELECT 1 FROM f WHERE f.meeting_id = b.meeting_id AND f.what = b.what))
        SELECT status, edited, count(*) AS n FROM m GROUP BY 1, 2""",
    "index_sync": """WITH o AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE md5(text) END AS a FROM documents WHERE doc_id % 10 > 0), c AS (SELECT doc_id, md5(text) AS b FROM documents WHERE doc_id % 11 > 0)
        SELECT count(*) FILTER (a IS NULL) AS indexed, count(*) FILTER (a <> b) AS updated, count(*) FILTER (b IS NULL) AS removed, count(*) FILTER (a = b) AS same FROM o FULL JOIN c USING (doc_id)""",
    "evidence_cards": """WITH d AS (SELECT doc_id, text, lower(text) AS l FROM documents), w AS (SELECT doc_id, concat_ws('; ', CASE WHEN contains(l, 'licensed under') THEN 'licence: licensed under' WHEN contains(l, 'released under') THEN 'licence: released under' END,
            CASE WHEN contains(l, 'token = ') THEN 'secret: token = ' END, CASE WHEN contains(l, '@mail') THEN 'contact: @mail' WHEN contains(l, '+1 (') THEN 'contact: +1 (' END) AS why,
            CASE WHEN length(text) <= 120 THEN text ELSE regexp_extract(text[1:120], '(?s)^(.*\\S)\\s', 1) END AS excerpt FROM d) SELECT * FROM w WHERE why <> ''""",
    "canonical_people": SQL + f""", p AS (SELECT person, regexp_replace(person, '#0000', '-') AS alias, count(*) AS support FROM meetings GROUP BY 1), a AS (SELECT * FROM p UNION ALL SELECT person, regexp_replace(alias, '[0-9]$', ''), support FROM p),
        m AS (SELECT DISTINCT translate(lower(alias), '-', ' ') AS mention FROM a), e AS (SELECT lower(alias) AS k, person, sum(support) AS s, 1 AS tier FROM a GROUP BY 1, 2 UNION ALL SELECT {_FOLD.format('alias')}, person, sum(support), 0 FROM a GROUP BY 1, 2),
        f AS (SELECT mention, person, tier, s FROM m JOIN e ON (tier = 1 AND k = lower(mention)) OR (tier = 0 AND k = {_FOLD.format('mention')})),
        t AS (SELECT *, rank() OVER (PARTITION BY mention ORDER BY tier DESC, s DESC) AS r FROM f) SELECT mention, CASE WHEN min(person) FILTER (r = 1) = max(person) FILTER (r = 1) THEN min(person) FILTER (r = 1) END AS person FROM m LEFT JOIN t USING (mention) GROUP BY 1""",
    "name_corrections": f"""WITH d AS (SELECT doc_id, unnest(string_split(regexp_extract(text, '^([\\pL]+(?: [\\pL]+)*)', 1), ' ')) AS w FROM documents), n AS (SELECT DISTINCT w AS name, {_FOLD.format('w')} AS key FROM d WHERE doc_id % 2 = 0 AND w <> ''),
        t AS (SELECT DISTINCT w AS token, {_FOLD.format('w')} AS tk FROM d WHERE doc_id % 2 = 1 AND w <> '' AND w NOT IN (SELECT name FROM n)),
        c AS (SELECT token, name, {_APART} AS tier FROM t JOIN n ON tk = key OR (tk[1] = key[1] AND length(tk) >= 4 AND {_APART} <= CASE WHEN least(length(tk), length(key)) >= 6 THEN 2 ELSE 1 END)),
        b AS (SELECT *, rank() OVER (PARTITION BY token ORDER BY tier) AS r FROM c) SELECT token, min(name) AS name FROM b WHERE r = 1 GROUP BY 1 HAVING count(DISTINCT name) = 1""",
    "answer_scorecard": """WITH r AS (SELECT CASE WHEN o_orderkey % 7 > 0 THEN o_orderstatus END AS t, CASE WHEN o_orderkey % 5 > 0 THEN CASE WHEN o_custkey % 4 > 0 THEN o_orderstatus ELSE 'F' END END AS s FROM orders),
        c AS (SELECT count(*) FILTER (t = s) AS right_, count(*) FILTER (t <> s) AS wrong, count(*) FILTER (t IS NOT NULL AND s IS NULL) AS missed, count(*) FILTER (t IS NULL AND s IS NOT NULL) AS spurious FROM r)
        SELECT right_ AS "right", wrong, missed, spurious, round(right_ / (right_ + wrong + spurious), 6) AS precision, round(right_ / (right_ + wrong + missed), 6) AS recall FROM c""",
    "provider_route": """WITH r AS (SELECT user_id, event_type AS provider, max(event_id) % 700 AS ms, min(event_id) AS place, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 25 ELSE 250 END AS penalty FROM events GROUP BY 1, 2 HAVING max(value) <= 400)
        SELECT user_id, provider, (ms + penalty + greatest(ms - 300, 0))::BIGINT AS score FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ms + penalty + greatest(ms - 300, 0), place) = 1""",
    "session_links": "SELECT user_id AS session, event_type AS kind, arg_max(props::JSON ->> '$.k', event_id) AS target FROM events WHERE user_id % 3 = 0 GROUP BY 1, 2",
}
