"""Named queries over documents, vectors, names and intervals, each with its SQL twin."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.operators import identity, intervals, retrieval
from talkmill.plans import mapping as M
from talkmill.session import shared_folder
from talkmill.sources.index import TermIndex
from talkmill.tables import load, tasks

#: Documents whose names a task pairs.
EACH = 5_000


def full_text_match(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with all terms of a query, the last as a prefix."""
    return retrieval.matching(load(spark, sf, "documents"), "the with erth").select("doc_id", "lang")


def stemmed_match(spark: SparkSession, sf: str) -> DataFrame:
    """R2: documents with the stems of a query's terms, the last as a prefix."""
    return retrieval.matching_stems(load(spark, sf, "documents"), "the er")


def bm25_rank(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 over whole documents."""
    return retrieval.bm25(load(spark, sf, "documents"), ["apache", "license", "released", "thing"])


def _index(spark: SparkSession, sf: str) -> tuple[TermIndex, DataFrame]:
    """An index of earlier documents, of which every seventh had other text and some are gone by now, brought up to date; and what that did."""
    index, now = TermIndex(spark, f"{shared_folder(spark)}/terms-{uuid.uuid4().hex}"), load(spark, sf, "documents").select("doc_id", "text")
    before = now.where("doc_id % 11 > 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("license thing "), "text")).otherwise(F.col("text")))
    index.sync(before.unionByName(now.where("doc_id % 13 = 0").withColumn("doc_id", -F.col("doc_id") - 1)))
    return index, index.sync(now)


def indexed_match(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with all terms of a query, the last as a prefix, from an index that was kept in step."""
    return _index(spark, sf)[0].matching("the with erth").withColumnRenamed("key", "doc_id")


def indexed_bm25(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 from an index that was kept in step."""
    return _index(spark, sf)[0].ranked(["apache", "license", "released", "thing"]).withColumnRenamed("key", "doc_id")


def index_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """What a sync of the index did."""
    return _index(spark, sf)[1]


def document_provisions(spark: SparkSession, sf: str) -> DataFrame:
    """Provisions counted by document."""
    rows = retrieval.provisions(load(spark, sf, "documents"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.count("heading").alias("headed"), F.sum(F.length("text")).alias("chars"))


def concept_provisions(spark: SparkSession, sf: str) -> DataFrame:
    """Provisions with some concepts and without others; concepts of this corpus."""
    own = {"licence": ("licensed under", "released under"), "apache": ("apache",), "contact": ("example.com",)}
    rows = retrieval.same_provision(retrieval.provisions(load(spark, sf, "documents")), ["licence"], ["apache"], own)
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("ordinal").cast("long").alias("first_ordinal"))


def concept_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold all concepts anywhere."""
    own = {"licence": ("licensed under", "released under"), "contact": ("example.com",), "secret": ("token = ", "+1 (")}
    return retrieval.in_document(retrieval.provisions(load(spark, sf, "documents")), ["contact", "secret"], concepts=own).withColumn("first_ordinal", F.col("first_ordinal").cast("long"))


def concept_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many provisions hold each of the eleven concepts, and in how many documents."""
    rows = retrieval.provisions(load(spark, sf, "documents").withColumn("text", F.regexp_replace("text", "(?i)licensed under", "governed by the laws, survival and assignment of")))
    return rows.select("doc_id", F.explode(retrieval.concepts_of(F.concat_ws(" ", "heading", "text"))).alias("concept")).groupBy("concept").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents"))


def boilerplate(spark: SparkSession, sf: str) -> DataFrame:
    """Edge lines that several documents of a source show."""
    return retrieval.running_boilerplate(load(spark, sf, "documents"), "source", "doc_id", "text")


def semantic_top_k(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest vectors to a query by cosine."""
    return retrieval.cosine_top_k(load(spark, sf, "embeddings"), [((i * 37) % 11 - 5) / 10 for i in range(64)], 40)


def voice_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Refined mean vectors by label."""
    rows = retrieval.profiles(load(spark, sf, "embeddings"), "label", least=0.05)
    return rows.select("label", F.col("dim").cast("long").alias("dim"), "n", F.round(retrieval.dot(F.col("mean"), F.col("mean")), 5).alias("length2"), F.round(F.get("mean", F.lit(0)), 5).alias("first"))


def voice_match(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest of the labels' plain means, with threshold and margin."""
    vectors = load(spark, sf, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), "embedding")
    nobody = vectors.select("label", "embedding", F.lit(0).cast("long").alias("n")).limit(0).withColumnRenamed("embedding", "mean")
    rows = retrieval.best_profile(vectors, retrieval.blended(nobody, vectors, "label"), "label", 0.2, 0.01)
    return rows.select("vec_id", "label", F.round("similarity", 4).alias("similarity"))


def blended_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Profiles of the first half of the vectors, with the others blended in; enrolments of each."""
    v = load(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    nobody = v.select("label", F.col("embedding").alias("mean"), F.lit(0).cast("long").alias("n")).limit(0)
    old = retrieval.blended(nobody, v.where("vec_id % 2 = 0"), "label")
    rows = retrieval.blended(old, v.where("vec_id % 2 = 1"), "label")
    return rows.select("label", "n", F.round(retrieval.dot(F.col("mean"), F.col("mean")), 6).alias("length2"))


def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    """Lexical hits, then the vector hits that the lexical ones lack."""
    lexical = retrieval.bm25(load(spark, sf, "documents"), ["license", "token"], k=30).select(F.col("doc_id").alias("id"), F.lit("lexical").alias("via"))
    semantic = retrieval.cosine_top_k(load(spark, sf, "embeddings"), [1.0] * 64, 30).select(F.col("vec_id").alias("id"), F.lit("semantic").alias("via"))
    return lexical.unionByName(semantic.join(lexical, "id", "left_anti"))


def _names(spark: SparkSession, sf: str) -> DataFrame:
    """Names made of the words that documents begin with, up to the first mark; of every third document one word."""
    name = F.regexp_extract("text", r"^(\p{L}++(?: \p{L}++)*+)", 1)
    rows = load(spark, sf, "documents").select("doc_id", name.alias("name")).where("name <> ''")
    return rows.select(F.when(F.col("doc_id") % 3 == 0, F.substring_index("name", " ", 1)).otherwise(F.col("name")).alias("name")).distinct()


def alias_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of names of which one shortens the other."""
    return identity.likely_pairs(_names(spark, sf), tasks(spark, sf, "documents", EACH))


def plausible_names(spark: SparkSession, sf: str) -> DataFrame:
    """Single names an edit or two apart, and spellings of one key."""
    return identity.plausible_pairs(_names(spark, sf).select(F.explode(F.split("name", " ")).alias("name")))


def alias_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Cliques of alike names, other components as pairs."""
    return identity.likely_clusters(_names(spark, sf), tasks(spark, sf, "documents", EACH)).select(F.array_join("members", " | ").alias("members"))


def cluster_score(spark: SparkSession, sf: str) -> DataFrame:
    """B-cubed precision and recall of one labelling against another."""
    return identity.b_cubed(load(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("cluster"), F.concat("o_orderstatus", F.col("o_custkey") % 50).alias("truth")))


def session_at(spark: SparkSession, sf: str) -> DataFrame:
    """The session of the user that covers an event and started last."""
    rows = load(spark, sf, "events").select("event_id", "user_id", F.timestamp_seconds(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")))).alias("t"))
    rows = rows.select("event_id", "user_id", F.unix_timestamp("t").alias("at"), (F.col("event_id") % 4).alias("m"))
    sessions = rows.where("m = 0").select("user_id", F.col("at").alias("start"), (F.col("at") + 7200 + (F.col("event_id") % 7) * 3600).alias("end"), F.col("event_id").alias("interval"))
    return intervals.latest_containing(rows.where("m > 0").select("event_id", "user_id", "at"), sessions, "event_id", "at", ["user_id"], 3600.0)


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    """(conv_id, turn, speaker, start, end): turns of a conversation as timed segments."""
    t = load(spark, sf, "conversations")
    start = F.col("turn") * 10.0 + (F.col("conv_id") % 5)
    return t.select("conv_id", "turn", (F.col("turn") % 3).alias("speaker"), start.alias("start"), (start + 3 + F.length("text") % 90 / 10).alias("end"))


def speaker_by_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """The speaker of the greatest overlap with each line."""
    s = _segments(spark, sf)
    lines = s.select("conv_id", (F.col("conv_id") * 100 + F.col("turn")).alias("line"), (F.col("start") - 2).alias("l_start"), (F.col("start") + 6).alias("l_end"))
    rows = intervals.by_overlap(lines, s.select("conv_id", "speaker", "start", "end"), "line", ["conv_id"], 20.0)
    return rows.withColumn("overlap", F.round("overlap", 4))


def speaker_at_time(spark: SparkSession, sf: str) -> DataFrame:
    """The speaker at a moment: inside a segment, else the next one near, else the last one near."""
    s = _segments(spark, sf)
    points = s.select("conv_id", (F.col("conv_id") * 100 + F.col("turn")).alias("line"), (F.col("start") + (F.col("turn") * 7 + F.col("conv_id")) % 13 - 1).alias("at"))
    return intervals.speaker_at(points, s.select("conv_id", "speaker", "start", "end"), "line", "at", ["conv_id"], reach=1.5)


def near_speech(spark: SparkSession, sf: str) -> DataFrame:
    """Moments with speech of somebody within a second."""
    s = _segments(spark, sf)
    points = s.select("conv_id", (F.col("conv_id") * 100 + F.col("turn")).alias("line"), (F.col("start") + (F.col("turn") * 7 + F.col("conv_id")) % 17 - 4).alias("l_start")).withColumn("l_end", F.col("l_start"))
    return intervals.overlapping(points, s.where("turn % 2 = 0").select("conv_id", "start", "end"), ["conv_id"], 20.0, slack=1.0).select("line").distinct()


def merged_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of segments with small gaps."""
    rows = intervals.merged(_segments(spark, sf), ["conv_id"], 0.75)
    return rows.select("conv_id", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"), "n")


def dominant_speakers(spark: SparkSession, sf: str) -> DataFrame:
    """Dominant speaker and number of speakers that count."""
    s = _segments(spark, sf)
    return intervals.dominant_speaker(s, ["conv_id"]).join(intervals.speaker_count(s, ["conv_id"], 8.0), "conv_id")


def turn_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows up to the next start, of eight seconds at most."""
    rows = intervals.windows_of(_segments(spark, sf).drop("end"), "conv_id", "start")
    return rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("end") - F.col("start")), 4).alias("seconds"))


def nearest_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles by nearest rank and by index, of values by kind."""
    return retrieval.nearest_ranks(load(spark, sf, "events"), "event_type", "value", (50, 95))


QUERIES = {f.__name__: f for f in (
    full_text_match, stemmed_match, bm25_rank, document_provisions, concept_provisions, concept_documents, concept_counts, boilerplate, semantic_top_k, voice_profiles, voice_match, blended_profiles, hybrid_search,
    indexed_match, indexed_bm25, index_refresh, alias_pairs, plausible_names, alias_clusters, cluster_score, session_at, speaker_by_overlap, speaker_at_time, near_speech, merged_turns, dominant_speakers, turn_windows, nearest_rank,
)}

_TERMS = "list_filter(regexp_split_to_array(translate(lower({0}), 'áàâäãåéèêëíìîïóòôöõúùûüçñ', 'aaaaaaeeeeiiiiooooouuuucn'), '[^\\pL\\pN]+'), lambda t: length(t) >= 2)"
_UNIT = "list_transform({0}, lambda x: x::DOUBLE / sqrt(list_sum(list_transform({0}, lambda y: y::DOUBLE * y::DOUBLE))))"
_HEADING = r"""CASE WHEN strlen(line) > 180 OR (line LIKE '%.' AND n > 12) THEN false ELSE
    (regexp_matches(lower(line), '^(section|article|schedule|exhibit) ') AND n <= 12) OR (regexp_matches(line, '^[0-9.]{0,12}[.)]\s*\S') AND n <= 12)
    OR (length(bare) >= 4 AND bare = regexp_replace(bare, '[^\p{Lu}]', '', 'g') AND n <= 12)
    OR (line LIKE '%.' AND length(bare) >= 4 AND n BETWEEN 1 AND 6 AND len(list_filter(regexp_split_to_array(line, '\s+'), lambda w: NOT regexp_matches(w, '^[^\pL]*\p{Lu}'))) = 0) END"""
_PROVISIONS = rf"""
    lines AS (SELECT doc_id, trim(unnest(string_split(coalesce(text, ''), chr(10))), ' ') AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
    sized AS (SELECT *, len(list_filter(regexp_split_to_array(line, '\s+'), lambda w: w <> '')) AS n, regexp_replace(line, '[^\pL]', '', 'g') AS bare FROM lines),
    headed AS (SELECT *, line <> '' AND ({_HEADING}) AS is_heading FROM sized),
    parted AS (SELECT *, sum(is_heading::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS part FROM headed),
    blocks AS (SELECT *, sum(CASE WHEN line = '' AND part = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM parted),
    grouped AS (SELECT doc_id, part, block, min(pos) AS pos, max(line) FILTER (is_heading) AS heading, coalesce(string_agg(line, ' ' ORDER BY pos) FILTER (NOT is_heading AND line <> ''), '') AS text FROM blocks GROUP BY ALL),
    provisions AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS ordinal, CASE WHEN text <> '' THEN heading END AS heading, CASE WHEN text = '' THEN heading ELSE text END AS text
        FROM grouped WHERE text <> '' OR heading IS NOT NULL)"""
_NAMES = """names AS (SELECT DISTINCT CASE WHEN doc_id % 3 = 0 THEN split_part(p, ' ', 1) ELSE p END AS name
    FROM (SELECT doc_id, regexp_extract(text, '^([\\pL]+(?: [\\pL]+)*)', 1) AS p FROM documents) WHERE p <> ''),
    parts AS (SELECT name, lower(name) AS low, string_split(lower(name), ' ') AS w FROM names),
    pairs AS (SELECT x.name AS a, y.name AS b FROM parts x JOIN parts y ON x.w[1] = y.w[1] AND x.name < y.name AND x.low <> y.low
        AND CASE WHEN len(x.w) >= 2 AND len(y.w) >= 2 THEN x.w[2] = y.w[2] ELSE len(x.w) <> len(y.w) END)"""
_FOLD = "translate(lower(name), 'áàâäãåéèêëíìîïóòôöõúùûüçñýÿ', 'aaaaaaeeeeiiiiooooouuuucnyy')"
_SEGMENTS = "segments AS (SELECT conv_id, turn, turn % 3 AS speaker, turn * 10.0::DOUBLE + conv_id % 5 AS start, turn * 10.0::DOUBLE + conv_id % 5 + 3 + length(text) % 90 / 10 AS end_ FROM conversations)"
_BM25 = """, q AS (SELECT doc_id, len(terms) AS size, unnest(list_filter(terms, lambda t: t IN ({0}))) AS term FROM t), tf AS (SELECT doc_id, size, term, count(*) AS tf FROM q GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), c AS (SELECT count(*) AS docs, avg(len(terms)) AS mean FROM t),
    ranked AS (SELECT doc_id, round(sum(ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score, count(*) AS matched FROM tf JOIN df USING (term), c GROUP BY 1)"""

ORACLE_SQL = {
    "full_text_match": f"WITH t AS (SELECT doc_id, lang, {_TERMS.format('text')} AS terms FROM documents) SELECT doc_id, lang FROM t WHERE list_contains(terms, 'the') AND list_contains(terms, 'with') AND len(list_filter(terms, lambda t: starts_with(t, 'erth'))) > 0",
    "bm25_rank": f"WITH t AS (SELECT doc_id, {_TERMS.format('text')} AS terms FROM documents)" + _BM25.format("'apache', 'license', 'released', 'thing'") + " SELECT * FROM ranked ORDER BY score DESC, doc_id LIMIT 25",
    "indexed_match": f"WITH t AS (SELECT doc_id, {_TERMS.format('text')} AS terms FROM documents) SELECT doc_id FROM t WHERE list_contains(terms, 'the') AND list_contains(terms, 'with') AND len(list_filter(terms, lambda t: starts_with(t, 'erth'))) > 0",
    "indexed_bm25": f"WITH t AS (SELECT doc_id, {_TERMS.format('text')} AS terms FROM documents)" + _BM25.format("'apache', 'license', 'released', 'thing'") + " SELECT * FROM ranked ORDER BY score DESC, doc_id LIMIT 25",
    "index_refresh": "SELECT count(*) FILTER (doc_id % 11 = 0) AS indexed, count(*) FILTER (doc_id % 11 > 0 AND doc_id % 7 = 0 AND text IS NOT NULL) AS updated, count(*) FILTER (doc_id % 13 = 0) AS removed, count(*) FILTER (doc_id % 11 > 0 AND (doc_id % 7 > 0 OR text IS NULL)) AS unchanged FROM documents",
    "document_provisions": f"WITH {_PROVISIONS} SELECT doc_id, count(*) AS n, count(heading) AS headed, sum(length(text))::BIGINT AS chars FROM provisions GROUP BY 1",
    "concept_provisions": f"WITH {_PROVISIONS} SELECT doc_id, count(*) AS n, min(ordinal) AS first_ordinal FROM (SELECT *, lower(concat_ws(' ', heading, text)) AS low FROM provisions) WHERE (contains(low, 'licensed under') OR contains(low, 'released under')) AND NOT contains(low, 'apache') GROUP BY 1",
    "concept_documents": f"""WITH {_PROVISIONS}, low AS (SELECT *, lower(concat_ws(' ', heading, text)) AS low FROM provisions),
        c AS (SELECT doc_id, ordinal, 'c' AS concept FROM low WHERE contains(low, 'example.com') UNION ALL SELECT doc_id, ordinal, 's' FROM low WHERE contains(low, 'token = ') OR contains(low, '+1 ('))
        SELECT doc_id, min(ordinal) AS first_ordinal, count(*) AS n FROM c GROUP BY 1 HAVING count(DISTINCT concept) = 2""",
    "concept_counts": "WITH " + _PROVISIONS.replace("FROM documents", "FROM (SELECT doc_id, regexp_replace(text, 'licensed under', 'governed by the laws, survival and assignment of', 'gi') AS text FROM documents)") + ", low AS (SELECT doc_id, lower(concat_ws(' ', heading, text)) AS low FROM provisions), c AS ("
        + " UNION ALL ".join(f"SELECT doc_id, '{c}' AS concept FROM low WHERE " + " OR ".join(f"contains(low, '{a}')" for a in own) for c, own in retrieval.CONCEPTS.items()) + ") SELECT concept, count(*) AS n, count(DISTINCT doc_id) AS documents FROM c GROUP BY 1",
    "boilerplate": """WITH l AS (SELECT source, doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS lines FROM documents),
        s AS (SELECT DISTINCT source, doc_id, unnest(list_transform(lines[1:3] || list_reverse(lines)[1:3], lambda x: regexp_replace(lower(x), '[0-9]+', '#', 'g'))) AS shape FROM l)
        SELECT source, shape, count(DISTINCT doc_id) AS pages FROM s WHERE shape <> '' GROUP BY 1, 2 HAVING count(DISTINCT doc_id) > 1""",
    "semantic_top_k": f"""WITH q AS (SELECT list_transform(range(64), lambda i: ((i * 37) % 11 - 5) / 10) AS q), u AS (SELECT vec_id, {_UNIT.format('embedding')} AS v, {_UNIT.format('q')} AS q FROM embeddings, q)
        SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: v[i] * q[i])), 6) AS similarity FROM u ORDER BY similarity DESC, vec_id LIMIT 40""",
    "voice_profiles": f"""WITH u AS (SELECT vec_id, label, {_UNIT.format('embedding')} AS v FROM embeddings), m AS (SELECT label, i, avg(v[i]) AS x FROM u, range(1, 65) r(i) GROUP BY ALL),
        c AS (SELECT label, list(x ORDER BY i) AS c FROM m GROUP BY 1), cu AS (SELECT label, {_UNIT.format('c')} AS c FROM c),
        s AS (SELECT vec_id, label, v, list_sum(list_transform(range(1, 65), lambda i: v[i] * c[i])) AS s FROM u JOIN cu USING (label)),
        k AS (SELECT * FROM (SELECT *, max(s) OVER (PARTITION BY label) AS best FROM s) WHERE s >= 0.05 OR (best < 0.05 AND s = best)),
        f AS (SELECT label, i, avg(v[i]) AS x, count(*) AS n FROM k, range(1, 65) r(i) GROUP BY ALL)
        SELECT label, 64::BIGINT AS dim, max(n) AS n, round(sum(x * x), 5) AS length2, round(max(x) FILTER (i = 1), 5) AS first FROM f GROUP BY 1""",
    "voice_match": f"""WITH e AS (SELECT * FROM embeddings), m AS (SELECT label, i, avg(embedding[i]) AS x FROM e, range(1, 65) r(i) GROUP BY ALL), c AS (SELECT label, list(x ORDER BY i) AS c FROM m GROUP BY 1),
        p AS (SELECT label, {_UNIT.format('c')} AS p FROM c), u AS (SELECT vec_id, {_UNIT.format('embedding')} AS v FROM e),
        s AS (SELECT vec_id, label, round(list_sum(list_transform(range(1, 65), lambda i: v[i] * p[i])), 6) AS s FROM u, p),
        b AS (SELECT vec_id, label, s, s - coalesce(lead(s) OVER w, -1) AS margin, row_number() OVER w AS r FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY s DESC, label))
        SELECT vec_id, CASE WHEN s >= 0.2 AND round(margin, 6) >= 0.01 THEN label END AS label, round(s, 4) AS similarity FROM b WHERE r = 1""",
    "blended_profiles": """WITH m AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x, count(*) AS n FROM embeddings, range(1, 65) r(i) GROUP BY ALL) SELECT label, max(n) AS n, round(sum(x * x), 6) AS length2 FROM m GROUP BY 1""",
    "hybrid_search": f"WITH t AS (SELECT doc_id, {_TERMS.format('text')} AS terms FROM documents)" + _BM25.format("'license', 'token'") + f""", lex AS (SELECT doc_id AS id FROM ranked ORDER BY score DESC, doc_id LIMIT 30),
        u AS (SELECT vec_id, {_UNIT.format('embedding')} AS v FROM embeddings), sem AS (SELECT vec_id AS id FROM (SELECT vec_id, round(list_sum(v) / 8, 6) AS s FROM u) ORDER BY s DESC, vec_id LIMIT 30)
        SELECT id, 'lexical' AS via FROM lex UNION ALL SELECT id, 'semantic' FROM sem WHERE id NOT IN (SELECT id FROM lex)""",
    "alias_pairs": f"WITH {_NAMES} SELECT a, b FROM pairs",
    "plausible_names": f"""WITH {_NAMES}, n AS (SELECT DISTINCT unnest(string_split(name, ' ')) AS name FROM names), k AS (SELECT name, {_FOLD} AS f, regexp_replace({_FOLD}, '[^\\pL\\pN]', '', 'g') AS key FROM n WHERE name <> ''),
        p AS (SELECT x.name AS a, y.name AS b, CASE WHEN x.key = y.key THEN CASE WHEN length(x.key) >= 3 THEN 'separator_variant' END
            WHEN strlen(x.f) = length(x.f) AND strlen(y.f) = length(y.f) AND x.f[1] = y.f[1] AND levenshtein(x.f, y.f) <= CASE WHEN least(length(x.f), length(y.f)) >= 6 THEN 2 ELSE 1 END THEN 'phonetic_edit' END AS reason
            FROM k x JOIN k y ON x.name < y.name AND x.key <> '' AND y.key <> '') SELECT * FROM p WHERE reason IS NOT NULL""",
    "alias_clusters": f"""WITH RECURSIVE {_NAMES}, both_ AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
        reach AS (SELECT a AS node, a AS far FROM both_ UNION SELECT r.node, e.b FROM reach r JOIN both_ e ON r.far = e.a), comp AS (SELECT node, min(far) AS component FROM reach GROUP BY 1),
        sized AS (SELECT component, count(*) AS nodes, string_agg(node, ' | ' ORDER BY node) AS members FROM comp GROUP BY 1), e AS (SELECT component, count(*) AS edges FROM pairs JOIN comp ON a = node GROUP BY 1),
        rated AS (SELECT *, edges = nodes * (nodes - 1) / 2 AS clique FROM sized JOIN e USING (component))
        SELECT members FROM rated WHERE clique UNION ALL SELECT a || ' | ' || b FROM pairs JOIN comp ON a = node JOIN rated USING (component) WHERE NOT clique""",
    "cluster_score": """WITH r AS (SELECT o_custkey AS cluster, o_orderstatus || (o_custkey % 50) AS truth FROM orders), b AS (SELECT cluster, truth, count(*) AS n FROM r GROUP BY 1, 2),
        x AS (SELECT *, sum(n) OVER (PARTITION BY cluster) AS c, sum(n) OVER (PARTITION BY truth) AS t FROM b), w AS (SELECT cluster, sum(n) AS c, sum(n * n) AS same FROM b GROUP BY 1)
        SELECT round(sum(n * n / c) / sum(n), 6) AS precision, round(sum(n * n / t) / sum(n), 6) AS recall, (SELECT ((sum(c * c) - sum(same)) / 2)::BIGINT FROM w) AS wrong_pairs FROM x""",
    "session_at": """WITH e AS (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS at_ FROM events), s AS (SELECT user_id, at_ AS start, at_ + 7200 + (event_id % 7) * 3600 AS end_, event_id AS interval FROM e WHERE event_id % 4 = 0)
        SELECT e.event_id, (SELECT s.interval FROM s WHERE s.user_id = e.user_id AND s.start <= e.at_ AND e.at_ <= s.end_ ORDER BY s.start DESC, s.interval DESC LIMIT 1) AS interval FROM e WHERE event_id % 4 > 0""",
    "speaker_by_overlap": f"""WITH {_SEGMENTS}, l AS (SELECT conv_id, conv_id * 100 + turn AS line, start - 2 AS ls, start + 6 AS le FROM segments),
        o AS (SELECT line, speaker, sum(least(le, end_) - greatest(ls, start)) AS o FROM l JOIN segments s USING (conv_id) WHERE s.start < le AND s.end_ > ls GROUP BY 1, 2)
        SELECT line, speaker, round(o, 4) AS overlap FROM o QUALIFY row_number() OVER (PARTITION BY line ORDER BY o DESC, speaker) = 1""",
    "speaker_at_time": f"""WITH {_SEGMENTS}, p AS (SELECT conv_id, conv_id * 100 + turn AS line, start + (turn * 7 + conv_id) % 13 - 1 AS at_ FROM segments),
        g AS (SELECT line, speaker, CASE WHEN start <= at_ AND at_ < end_ THEN 0 WHEN start > at_ AND start - at_ <= 1.5 THEN 1 WHEN end_ <= at_ AND at_ - end_ <= 1.5 THEN 2 END AS c,
            CASE WHEN start <= at_ AND at_ < end_ THEN start WHEN start > at_ THEN start - at_ ELSE at_ - end_ END AS g FROM p JOIN segments USING (conv_id)),
        b AS (SELECT line, speaker FROM g WHERE c IS NOT NULL QUALIFY row_number() OVER (PARTITION BY line ORDER BY c, g, speaker) = 1) SELECT line, speaker FROM p LEFT JOIN b USING (line)""",
    "near_speech": f"""WITH {_SEGMENTS}, p AS (SELECT conv_id, conv_id * 100 + turn AS line, start + (turn * 7 + conv_id) % 17 - 4 AS at_ FROM segments)
        SELECT DISTINCT line FROM p JOIN segments s USING (conv_id) WHERE s.turn % 2 = 0 AND s.start < at_ + 1 AND s.end_ > at_ - 1""",
    "merged_turns": f"""WITH {_SEGMENTS}, f AS (SELECT *, max(end_) OVER (PARTITION BY conv_id ORDER BY start, end_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM segments),
        r AS (SELECT *, sum(CASE WHEN before IS NULL OR start > before + 0.75 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY start, end_ ROWS UNBOUNDED PRECEDING) AS run FROM f)
        SELECT conv_id, round(min(start), 4) AS start, round(max(end_), 4) AS end, count(*) AS n FROM r GROUP BY conv_id, run""",
    "dominant_speakers": f"""WITH {_SEGMENTS}, o AS (SELECT conv_id, speaker, sum(end_ - start) AS s FROM segments GROUP BY 1, 2), a AS (SELECT *, sum(s) OVER (PARTITION BY conv_id) AS al FROM o)
        SELECT conv_id, max(CASE WHEN s >= 0.6 * al THEN speaker END) AS speaker, count(*) FILTER (s >= 8) AS n FROM a GROUP BY 1""",
    "turn_windows": f"""WITH {_SEGMENTS}, w AS (SELECT conv_id, start, least(coalesce(lead(start) OVER (PARTITION BY conv_id ORDER BY start), start + 8), start + 8) AS e FROM segments)
        SELECT conv_id, count(*) AS n, round(sum(e - start), 4) AS seconds FROM w WHERE e > start GROUP BY 1""",
    "nearest_rank": """WITH r AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
        SELECT event_type, max(v) FILTER (r = ceil(n * 50 / 100)) AS p50, max(v) FILTER (r = ceil(n * 95 / 100)) AS p95, max(v) FILTER (r = ceil((n - 1) * 50 / 100) + 1) AS i50, max(v) FILTER (r = ceil((n - 1) * 95 / 100) + 1) AS i95 FROM r GROUP BY 1""",
}
