"""Named queries over names, questions, voices and nudges, with SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.functions import text as T
from talkmill.operators import answers, extraction, filters, intervals, names, reports, retrieval, voices
from talkmill.plans import mapping as M
from talkmill.plans.mapping import SQL
from talkmill.plans.search import _PROVISIONS, _SEGMENTS, _segments
from talkmill.tables import load

OWN = {"licence": ("licensed under", "released under"), "contact": ("example.com", "+1 ("), "secret": ("token = ",)}


def search_snippets(spark: SparkSession, sf: str) -> DataFrame:
    """Line and word snippets of documents that match."""
    rows = load(spark, sf, "documents").where(F.lower("text").contains("license"))
    return rows.select("doc_id", answers.line_snippet(F.col("text"), "license").alias("line"), answers.token_snippet(F.col("text"), ("license",)).alias("words"))


def best_snippets(spark: SparkSession, sf: str) -> DataFrame:
    """Of documents that hold one of three terms, the 24 words that say most of them."""
    terms = ("license", "software", "you")
    rows = load(spark, sf, "documents").where(F.lower("text").contains("license"))
    return rows.select("doc_id", answers.best_snippet(F.col("text"), terms).alias("words"))


def exact_recheck(spark: SparkSession, sf: str) -> DataFrame:
    """The predicate of a full-text search, on one document, with a snippet."""
    rows = retrieval.matching(load(spark, sf, "documents").where("doc_id = 2"), "the")
    return rows.select("doc_id", answers.line_snippet(F.col("text"), "the").alias("line"))


def _vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as entries: the name, its brand and its type as forms."""
    p = load(spark, sf, "part")
    forms = F.posexplode(F.array(F.col("p_name"), F.concat_ws(" ", F.col("p_brand"), "p_name"), F.upper("p_type")))
    return p.select(F.col("p_partkey").alias("entry"), F.col("p_name").alias("canonical"), F.col("p_brand").alias("kind"), F.col("p_size").alias("priority"), forms.alias("place", "form"))


def query_expansions(spark: SparkSession, sf: str) -> DataFrame:
    """A query and the other forms of the entries that know it."""
    return answers.expansions(_vocabulary(spark, sf), "  Blue  bolt ")


def decode_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Forms by priority."""
    return answers.decode_phrases(_vocabulary(spark, sf), 120)


def _provisions(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents").select("doc_id", F.md5("text").alias("revision"))
    return retrieval.provisions(load(spark, sf, "documents")).withColumn("inferred", F.col("heading").isNull() & (F.col("ordinal") % 5 == 0)).join(d, "doc_id")


def provision_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Provisions of current revisions that hold concepts, a phrase and few sentences."""
    question = answers.interpreted('"the" with a license in three sentences', {"licence": ("license",)})
    current = load(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, "gone").otherwise(F.md5("text")).alias("revision"))
    rows, _ = answers.current_only(_provisions(spark, sf), current)
    found = answers.evidence(rows, answers.Question(("licence",), question.phrase, None), 400, {"licence": ("licensed", "released")})
    return found.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), F.length("text").cast("long").alias("chars"))


def withdrawn_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose revision is no longer current."""
    current = load(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, "gone").otherwise(F.md5("text")).alias("revision"))
    return answers.current_only(_provisions(spark, sf), current)[1]


def document_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold all concepts anywhere, with at most 64 places."""
    rows = answers.documents_with(_provisions(spark, sf), answers.Question(("contact", "secret"), anywhere=True), 3, OWN)
    return rows.select("doc_id", F.col("first_ordinal").cast("long").alias("first_ordinal"), "n", F.array_join("evidence", ",").alias("evidence"))


def capped_people(spark: SparkSession, sf: str) -> DataFrame:
    """People of meetings within caps of rows and bytes."""
    rows = reports.attendance(M.attendees(spark, sf)).select("meeting_id", "slug", "role")
    return answers.capped(rows, [F.col("meeting_id"), F.col("slug")], 2_000, 90_000)


def clean_names(spark: SparkSession, sf: str) -> DataFrame:
    """C14: names without roles and speaker labels, lists of people parted."""
    n = F.col("s_suppkey")
    base = F.concat(F.lit("Person "), n)
    text = F.when(n % 5 == 0, F.concat(base, F.lit(", tech lead"))).when(n % 5 == 1, F.concat(base, F.lit(" - the product manager speaker "), n)).when(n % 5 == 2, F.concat(base, F.lit(" & The Team"))).when(n % 5 == 3, F.concat(base, F.lit(" and Person x, Everyone"))).otherwise(F.concat(F.lit("Chen, "), base))
    rows = load(spark, sf, "supplier").select(n.alias("id"), F.posexplode(names.people_of(text)).alias("place", "raw"))
    return rows.select("id", F.col("place").cast("long").alias("place"), names.clean_name(F.col("raw")).alias("name"))


def user_folded(spark: SparkSession, sf: str) -> DataFrame:
    """The user's other names folded into the user, where the user took part."""
    rows = M.attendees(spark, sf).where("role <> 'attendee'").select("meeting_id", T.slugify(F.col("person")).alias("slug"), F.col("person").alias("label")).distinct()
    rows = rows.withColumn("aliases", F.array(F.lower("label")))
    out = names.folded_user(rows, "meeting_id", "Supplier 1", ("supplier 2", "Supplier-3"))
    return out.where("slug in ('supplier-1', 'supplier-2', 'supplier-3')").select("meeting_id", "slug", "label", F.array_join("aliases", "|").alias("aliases"))


def own_name(spark: SparkSession, sf: str) -> DataFrame:
    """The user's name spelt right where the user speaks of themselves, in conversations the user takes part in."""
    t = load(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.concat(F.lit("["), "role", F.lit("] "), F.when(F.col("turn") % 2 == 0, "Hey, this is Mats. ").otherwise("Matt is here. "), F.translate("text", "\n", " ")).alias("line"))
    return names.own_name_repaired(t, t.where("doc_id % 3 > 0").select("doc_id"), "Mat", ("Matt",))


def decision_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Topics inferred from decisions."""
    rows = M.items(spark, sf).where("kind = 'decision'").select(F.concat(F.lit("We will use the "), "what", F.lit(" in "), "topic").alias("text"))
    return rows.groupBy(extraction.inferred_topic(F.col("text")).alias("topic")).agg(F.count("*").alias("n"))


def sdk_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Meetings whose people or text name somebody, newest first; open actions of that name."""
    meetings, people = M.meetings(spark, sf), M.all_attendees(spark, sf)
    named = people.where(F.lower("person").contains("supplier 7")).select("meeting_id").distinct().withColumn("hit", F.lit(True))
    rows = meetings.join(named, "meeting_id", "left").where(F.col("hit") | F.lower("title").contains("supplier 7"))
    actions = M.all_items(spark, sf).where("kind = 'action-item' and status = 'open'").where(F.lower("who").contains("supplier 7")).join(rows.select("meeting_id", "path", "date"), "meeting_id")
    first = filters.newest(rows, 20).select(F.lit("meeting").alias("section"), "path", F.col("title").alias("text"))
    return first.unionByName(actions.orderBy(F.desc("date"), "path", "what", "due", "l_quantity").limit(20).select(F.lit("action").alias("section"), "path", F.col("what").alias("text")))


def dictation_history(spark: SparkSession, sf: str) -> DataFrame:
    """The newest dictations."""
    return filters.newest(M.meetings(spark, sf).where("type = 'dictation'"), 40).select("path", "date_text")


def topic_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Topics of matching meetings in the order in which they are first seen, newest meeting first."""
    rows = M.all_items(spark, sf).join(M.meetings(spark, sf).where(F.lower("title").contains("0012")).select("meeting_id", "date", "path"), "meeting_id")
    seen = rows.groupBy("topic").agg(F.min(F.struct((-F.unix_timestamp(F.col("date").cast("timestamp"))).alias("age"), "path", "topic")).alias("o"), F.count("*").alias("n")).orderBy("o").limit(15)
    return seen.select("topic", "n", F.col("o.path").alias("path"))


def attributed_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Speakers of lines, with the next and the dominant speaker where there is none."""
    s = _segments(spark, sf)
    points = s.select("conv_id", (F.col("conv_id") * 100 + F.col("turn")).alias("line"), (F.col("start") + (F.col("turn") * 7 + F.col("conv_id")) % 13 - 2).alias("at"))
    found = intervals.speaker_at(points, s.select("conv_id", "speaker", "start", "end"), "line", "at", ["conv_id"], reach=0.5)
    return voices.attributed(points.join(found, "line"), s, "conv_id").select("conv_id", "line", "speaker")


def solo_voices(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as windows of clips; which clips are refused and why."""
    v = load(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 3).alias("clip"), "vec_id", "embedding")
    clips = v.select("clip").distinct().select("clip", (F.col("clip") % 9).cast("double").alias("speech_seconds"), (F.col("clip") % 40 + 5).cast("double").alias("snr"), ((F.col("clip") % 11) / 150).alias("clipping"))
    rows = voices.solo_profiles(v.where("clip % 5 > 0 or vec_id % 3 = 0"), clips, least_likeness=0.02)
    return rows.groupBy("refused").agg(F.count("*").alias("n"), F.sum("windows").alias("windows"), F.count("embedding").alias("profiles"))


def energy_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Segments where one of two sources is loud."""
    e = load(spark, sf, "events").select("user_id", F.col("event_id").alias("i"), (F.col("event_id") * 0.5).alias("start"), F.col("value").cast("double").alias("rms"))
    rows = voices.active_segments(e, e.withColumn("rms", F.col("rms") / 3 + F.col("i") % 7), "user_id", 0.5, 60.0, 60.0)
    return rows.select("user_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "n")


def nudge_scores(spark: SparkSession, sf: str) -> DataFrame:
    """How useful, repeated and stale nudges are, against labelled opportunities."""
    e = load(spark, sf, "events").select(F.col("user_id").alias("fixture"), F.col("event_id").alias("i"), "event_type")
    none = F.lit(None).cast("long")
    labels = e.where("i % 9 = 0").select("fixture", F.lit("label").alias("kind"), F.concat(F.lit("o"), "i").alias("name"), F.when(F.col("i") % 2 == 0, F.col("event_type")).alias("opportunity"), (F.col("i") * 1000).alias("start_ms"), (F.col("i") * 1000 + 600_000).alias("end_ms"), F.lit("").alias("text"), none.alias("evidence_ms"), none.alias("delivered_ms"), F.lit(False).alias("stale"))
    said = e.where("i % 9 > 5").select("fixture", F.lit("nudge").alias("kind"), F.lit("").alias("name"), F.col("event_type").alias("opportunity"), none.alias("start_ms"), none.alias("end_ms"), F.concat(F.lit("text "), F.col("i") % 4).alias("text"), (F.col("i") * 1000).alias("evidence_ms"), (F.col("i") * 1000 + 200).alias("delivered_ms"), (F.col("i") % 13 == 0).alias("stale"))
    return voices.nudge_scores(labels.unionByName(said))


def speaker_labels(spark: SparkSession, sf: str) -> DataFrame:
    """The distinct speakers of a transcript's labelled lines."""
    t = load(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit("["), F.upper("role"), F.lit(" one 0:"), F.col("turn") + 10, F.lit("] "), F.translate("text", "\n[]", "   ")).alias("line"))
    body = t.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return body.select("conv_id", F.array_join(F.array_sort(T.speaker_labels(F.col("body"))), ",").alias("speakers"))


QUERIES = {f.__name__: f for f in (
    search_snippets, best_snippets, exact_recheck, query_expansions, decode_phrases, provision_evidence, withdrawn_documents, document_evidence, capped_people, clean_names, user_folded, own_name,
    decision_topics, sdk_profile, dictation_history, topic_projection, attributed_lines, solo_voices, energy_segments, nudge_scores, speaker_labels,
)}

_FORMS = """f AS (SELECT p_partkey AS entry, p_name AS canonical, p_brand AS kind, p_size AS priority, unnest([p_name, p_brand || ' ' || p_name, upper(p_type)]) AS form, unnest([0, 1, 2]) AS place FROM part)"""
_SUPPLIER = "CASE s_suppkey % 5 WHEN 0 THEN p || ', tech lead' WHEN 1 THEN p || ' - the product manager speaker ' || s_suppkey WHEN 2 THEN p || ' & The Team' WHEN 3 THEN p || ' and Person x, Everyone' ELSE 'Chen, ' || p END"

ORACLE_SQL = {
    "exact_recheck": "SELECT doc_id, CASE WHEN length(l) > 200 THEN l[1:200] || '...' ELSE l END AS line FROM (SELECT *, trim(list_filter(string_split(text, chr(10)), lambda x: contains(lower(x), 'the'))[1], ' ') AS l FROM documents) WHERE doc_id = 2 AND len(list_filter(regexp_split_to_array(lower(text), '[^\\pL\\pN]+'), lambda t: starts_with(t, 'the'))) > 0",
    "search_snippets": r"""WITH d AS (SELECT doc_id, text, trim(list_filter(string_split(text, chr(10)), lambda x: contains(lower(x), 'license'))[1], ' ') AS l, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents WHERE contains(lower(text), 'license')),
        a AS (SELECT *, list_position(list_transform(w, lambda x: contains(lower(x), 'license')), true) AS at_ FROM d), b AS (SELECT *, greatest(1, least(at_ - 8, len(w) - 23)) AS f FROM a)
        SELECT doc_id, CASE WHEN length(l) > 200 THEN l[1:200] || '...' ELSE l END AS line, CASE WHEN f > 1 THEN '…' ELSE '' END || array_to_string(w[f:f + 23], ' ') || CASE WHEN f + 23 < len(w) THEN '…' ELSE '' END AS words FROM b""",
    "best_snippets": r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents WHERE contains(lower(text), 'license')),
        t AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS x, unnest(list_prepend('.', w[:len(w) - 1])) AS before FROM d),
        f AS (SELECT doc_id, i, contains(lower(x), 'license')::INT AS a, contains(lower(x), 'software')::INT AS b, contains(lower(x), 'you')::INT AS c, right(before, 1) IN ('.', ':') AS begins FROM t),
        h AS (SELECT * FROM f WHERE a + b + c > 0), s AS (SELECT h.doc_id, h.i AS hit, max(f.i) AS p FROM h JOIN f ON f.doc_id = h.doc_id AND f.begins AND f.i BETWEEN h.i - 23 AND h.i GROUP BY 1, 2 HAVING max(f.i) < h.i),
        k AS (SELECT doc_id, i AS hit, i AS p, 0 AS bonus FROM h UNION ALL SELECT doc_id, hit, p, CASE p WHEN 0 THEN 120 ELSE 100 END FROM s),
        g AS (SELECT k.doc_id, hit, p, bonus, 999 * (max(a) + max(b) + max(c)) + sum(a + b + c) + bonus AS score, min(i) AS first, max(i) AS last FROM k JOIN h ON h.doc_id = k.doc_id AND h.i BETWEEN p AND p + 23 GROUP BY k.doc_id, hit, p, bonus),
        o AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, hit, bonus) = 1),
        r AS (SELECT doc_id, w, CASE WHEN bonus > 0 THEN p ELSE greatest(0, least(first - (24 - (last - first)) // 2, len(w) - 24)) END AS at_ FROM o JOIN d USING (doc_id))
        SELECT doc_id, CASE WHEN at_ > 0 THEN '…' ELSE '' END || array_to_string(w[at_ + 1:at_ + 24], ' ') || CASE WHEN at_ + 24 < len(w) THEN '…' ELSE '' END AS words FROM r""",
    "query_expansions": f"""WITH {_FORMS}, k AS (SELECT *, lower(form) AS k FROM f), h AS (SELECT DISTINCT entry FROM k WHERE k = 'blue bolt'), g AS (SELECT k, min(struct_pack(entry, place, form)) AS o FROM k WHERE entry IN (SELECT entry FROM h) AND k <> 'blue bolt' GROUP BY 1),
        r AS (SELECT -1 AS e, 0 AS p, 'Blue  bolt' AS form UNION ALL SELECT o.entry, o.place, o.form FROM g) SELECT row_number() OVER (ORDER BY e, p, form) AS place, form AS phrase FROM r QUALIFY place <= 8""",
    "decode_phrases": f"""WITH {_FORMS}, g AS (SELECT lower(form) AS k, min(struct_pack(p := -priority, kind, c := lower(canonical), place, form)) AS o FROM f GROUP BY 1)
        SELECT row_number() OVER (ORDER BY o) AS place, o.form AS phrase FROM g QUALIFY place <= 120""",
    "provision_evidence": f"""WITH {_PROVISIONS}, low AS (SELECT *, lower(concat_ws(' ', heading, text)) AS low FROM provisions WHERE doc_id % 7 > 0 AND NOT (heading IS NULL AND ordinal % 5 = 0))
        SELECT doc_id, ordinal, length(text) AS chars FROM low WHERE (contains(low, 'licensed') OR contains(low, 'released')) AND contains(low, 'the') ORDER BY doc_id, ordinal LIMIT 400""",
    "withdrawn_documents": f"WITH {_PROVISIONS} SELECT DISTINCT doc_id FROM provisions WHERE doc_id % 7 = 0",
    "document_evidence": f"""WITH {_PROVISIONS}, low AS (SELECT *, lower(concat_ws(' ', heading, text)) AS low FROM provisions), c AS (SELECT doc_id, ordinal, contains(low, 'example.com') OR contains(low, '+1 (') AS c, contains(low, 'token = ') AS s FROM low),
        h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS r FROM c WHERE c OR s)
        SELECT doc_id, min(ordinal) AS first_ordinal, count(*) AS n, string_agg(ordinal::VARCHAR, ',' ORDER BY ordinal) FILTER (r <= 3) AS evidence FROM h GROUP BY 1 HAVING bool_or(c) AND bool_or(s)""",
    "capped_people": SQL + """, r AS (SELECT meeting_id, lower(regexp_replace(person, '[^A-Za-z0-9]+', '-', 'g')) AS slug, max(CASE role WHEN 'attendee' THEN 3 WHEN 'speaker' THEN 2 ELSE 1 END) AS r FROM attendees GROUP BY 1, 2),
        n AS (SELECT meeting_id, slug, CASE r WHEN 3 THEN 'attendee' WHEN 2 THEN 'speaker' ELSE 'mentioned' END AS role FROM r ORDER BY meeting_id, slug LIMIT 2000),
        t AS (SELECT *, sum(strlen('{"meeting_id":' || meeting_id || ',"slug":"' || slug || '","role":"' || role || '"}')) OVER (ORDER BY meeting_id, slug) AS b FROM n) SELECT meeting_id, slug, role FROM t WHERE b <= 90000""",
    "clean_names": f"""WITH s AS (SELECT s_suppkey, 'Person ' || s_suppkey AS p FROM supplier), x AS (SELECT s_suppkey AS id, s_suppkey % 5 AS k, p FROM s)
        SELECT id, 0::BIGINT AS place, CASE WHEN k = 4 THEN 'Chen, ' || p ELSE p END AS name FROM x UNION ALL SELECT id, 1, NULL FROM x WHERE k = 2
        UNION ALL SELECT id, 1, 'Person x' FROM x WHERE k = 3 UNION ALL SELECT id, 2, NULL FROM x WHERE k = 3""",
    "user_folded": SQL + """, a AS (SELECT DISTINCT meeting_id, lower(regexp_replace(person, ' ', '-')) AS slug, person AS label FROM attendees WHERE role <> 'attendee'), h AS (SELECT meeting_id FROM a WHERE slug = 'supplier-1'),
        f AS (SELECT meeting_id, CASE WHEN slug IN ('supplier-2', 'supplier-3') AND meeting_id IN (SELECT meeting_id FROM h) THEN 'supplier-1' ELSE slug END AS new, slug, label FROM a)
        SELECT meeting_id, new AS slug, min(label) FILTER (new = slug) AS label, string_agg(DISTINCT lower(label), '|' ORDER BY lower(label)) AS aliases FROM f WHERE new IN ('supplier-1', 'supplier-2', 'supplier-3') GROUP BY 1, 2""",
    "own_name": """SELECT conv_id AS doc_id, turn AS pos, '[' || role || '] ' || CASE WHEN conv_id % 3 > 0 THEN CASE WHEN turn % 2 = 0 THEN 'Hey, this is Mat. ' ELSE 'Mat is here. ' END ELSE CASE WHEN turn % 2 = 0 THEN 'Hey, this is Mats. ' ELSE 'Matt is here. ' END END || translate(text, chr(10), ' ') AS line FROM conversations""",
    "decision_topics": SQL + """, w AS (SELECT list_filter(regexp_split_to_array('We will use the ' || what || ' in ' || topic, '\\s+'), lambda x: lower(x) NOT IN ('the', 'a', 'an', 'to', 'for', 'of', 'in', 'on', 'at', 'is', 'was', 'will', 'should', 'we', 'they', 'it')) AS w FROM items WHERE kind = 'decision')
        SELECT lower(array_to_string(w[1:4], ' ')) AS topic, count(*) AS n FROM w GROUP BY 1""",
    "sdk_profile": SQL + """, r AS (SELECT * FROM meetings m WHERE contains(lower(title), 'supplier 7') OR EXISTS (SELECT 1 FROM attendees a WHERE a.meeting_id = m.meeting_id AND contains(lower(person), 'supplier 7'))),
        a AS (SELECT 'meeting' AS section, path, title AS text FROM r ORDER BY date DESC, path LIMIT 20), b AS (SELECT 'action' AS section, path, what AS text FROM items JOIN r USING (meeting_id) WHERE kind = 'action-item' AND status = 'open' AND contains(lower(who), 'supplier 7') ORDER BY date DESC, path, what, due, l_quantity LIMIT 20)
        SELECT * FROM a UNION ALL SELECT * FROM b""",
    "dictation_history": SQL + "SELECT path, date_text FROM meetings WHERE type = 'dictation' ORDER BY date DESC, path LIMIT 40",
    "topic_projection": SQL + """, t AS (SELECT topic, min(struct_pack(age := -epoch(date)::BIGINT, path)) AS o, count(*) AS n FROM items JOIN meetings USING (meeting_id) WHERE contains(lower(title), '0012') GROUP BY 1) SELECT topic, n, o.path AS path FROM t ORDER BY o, topic LIMIT 15""",
    "attributed_lines": f"""WITH {_SEGMENTS}, p AS (SELECT conv_id, conv_id * 100 + turn AS line, start + (turn * 7 + conv_id) % 13 - 2 AS at_ FROM segments),
        g AS (SELECT line, speaker, CASE WHEN start <= at_ AND at_ < end_ THEN 0 WHEN start > at_ AND start - at_ <= 0.5 THEN 1 WHEN end_ <= at_ AND at_ - end_ <= 0.5 THEN 2 END AS c,
            CASE WHEN start <= at_ AND at_ < end_ THEN start WHEN start > at_ THEN start - at_ ELSE at_ - end_ END AS g FROM p JOIN segments USING (conv_id)),
        b AS (SELECT line, speaker FROM g WHERE c IS NOT NULL QUALIFY row_number() OVER (PARTITION BY line ORDER BY c, g, speaker) = 1), l AS (SELECT p.conv_id, p.line, p.at_, b.speaker FROM p LEFT JOIN b USING (line)),
        o AS (SELECT conv_id, speaker, sum(end_ - start) AS s FROM segments GROUP BY 1, 2), a AS (SELECT *, sum(s) OVER (PARTITION BY conv_id) AS al FROM o), d AS (SELECT conv_id, max(CASE WHEN s >= 0.6 * al THEN speaker END) AS dominant FROM a GROUP BY 1),
        n AS (SELECT *, row_number() OVER w AS place, count(speaker) OVER (PARTITION BY conv_id) AS known, (SELECT arg_min(m.speaker, struct_pack(m.at_, m.line)) FROM l m WHERE m.conv_id = l.conv_id AND m.speaker IS NOT NULL) AS ahead FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY at_, line))
        SELECT conv_id, line, CASE WHEN known = 0 THEN dominant WHEN place = 1 AND speaker IS NULL THEN ahead ELSE speaker END AS speaker FROM n JOIN d USING (conv_id)""",
    "energy_segments": """WITH e AS (SELECT user_id, event_id AS i, event_id * 0.5::DOUBLE AS start FROM events WHERE value > 60 OR value / 3 + event_id % 7 > 60), f AS (SELECT *, max(start + 0.5) OVER (PARTITION BY user_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
        r AS (SELECT *, sum(CASE WHEN before IS NULL OR start > before + 60 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start ROWS UNBOUNDED PRECEDING) AS run FROM f)
        SELECT user_id, round(min(start), 3) AS start, round(max(start + 0.5), 3) AS end, count(*) AS n FROM r GROUP BY user_id, run""",
    "speaker_labels": "SELECT conv_id, string_agg(DISTINCT upper(role[1]) || role[2:] || ' One', ',' ORDER BY upper(role[1]) || role[2:] || ' One') AS speakers FROM conversations GROUP BY 1",
}
