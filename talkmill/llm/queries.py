"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.llm import chat, licenses, lines, manifest, packing, passages, pii, quality, setjoin, simhash, spelling, tiling, topk
from talkmill.tables import load


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document; rows of fold 1 are held out from all that is learnt."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    rows = quality.scored(docs, quality.train(docs, load(spark, sf_dir, "labels")))
    return rows.select("doc_id", F.coalesce(quality.fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold benchmark items: each pair with its coverage."""
    found = tiling.contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.drop("row")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences found in every document."""
    return licenses.licenses(load(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(load(spark, sf_dir, "documents"), radius=2, shingle=3)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and places of the personal data in every document."""
    rows = pii.spans(load(spark, sf_dir, "documents").select("doc_id", "text"))
    base = ("email", "ip", "card", "phone")
    return rows.select(
        "doc_id",
        *(pii.count_of(k).alias(f"n_{k}") for k in base),
        F.sha2(pii.spans_text(base), 256).alias("base_sha256"),
        pii.spans_text().alias("spans"),
        pii.scores_text().alias("scores"),
    )


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of documents that repeat passages of documents with smaller ids."""
    return passages.repeated_passages(load(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line counts and the hash of the kept text of every document."""
    rows = lines.dedup_lines(load(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=20, min_docs=3)
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best other vectors for each vector whose id is divisible by 100."""
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt, completions and loss spans of a pair from every conversation with a reply."""
    pairs = chat.preference_pairs(*chat.stale_replies(load(spark, sf_dir, "conversations")))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias(c)
    return pairs.select("pair_id", "segment", "n_prompt_turns", "prompt", "chosen", "rejected", spans("chosen_spans"), spans("rejected_spans"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in the sequences."""
    return packing.packed(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and the root that its leaf, perhaps tampered with, gives with the proof."""
    return manifest.verified(manifest.manifest(load(spark, sf_dir, "documents")))


def op12_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document among those whose sets of three-word shingles are alike."""
    return setjoin.similar_sets(load(spark, sf_dir, "documents"), n=3, percent=90)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its near words, its form and the end of its path of forms."""
    return spelling.variants(load(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_decontamination": op2_decontamination,
    "op3_licenses": op3_licenses,
    "op4_simhash": op4_simhash,
    "op5_pii": op5_pii,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_top_k": op8_top_k,
    "op9_chat": op9_chat,
    "op10_packing": op10_packing,
    "op11_merkle": op11_merkle,
    "op12_set_join": op12_set_join,
    "op13_spelling": op13_spelling,
}


_SCORE = {k.name: (round(100 * k.prior), round(100 * k.boost), k.near) for k in pii.KINDS}
_NEAR = "lower(substring(t, greatest(s.at - 40, 0)::BIGINT + 1, least(s.at, 40)::BIGINT) || ' ' || substring(t, (s.at + length(s.m) + 1)::BIGINT, 40))"


def _found_sql(kind: str, pattern: str, valid: str) -> str:
    """A list of structs of text (kind:start:end) and score (in hundredths) of the matches m (and start at) that are valid."""
    return f"""
        list_transform(list_filter(list_transform(range(1, len(regexp_extract_all(t, '{pattern}')) + 1), lambda i: {{
            'm': regexp_extract_all(t, '{pattern}')[i],
            'at': list_sum(list_transform(regexp_split_to_array(t, '{pattern}')[1:i], lambda x: length(x)))
                  + coalesce(list_sum(list_transform(regexp_extract_all(t, '{pattern}')[1:i - 1], lambda x: length(x))), 0)
        }}), lambda s: {valid}), lambda s: {{'text': '{kind}:' || s.at::BIGINT || ':' || (s.at + length(s.m))::BIGINT,
            'score': {_SCORE[kind][0]} + CASE WHEN regexp_matches({_NEAR}, '(?:^|[^a-z0-9])(?:{"|".join(_SCORE[kind][2])})(?:[^a-z0-9]|$)') THEN {_SCORE[kind][1]} ELSE 0 END}})"""


_DIGITS = "regexp_replace(s.m, '[^0-9]', '', 'g')"
_ALONE = "NOT regexp_matches(CASE WHEN s.at > 0 THEN substring(t, s.at::BIGINT, 1) ELSE '' END || substring(t, (s.at + length(s.m) + 1)::BIGINT, 1), '[A-Za-z0-9]')"
_LUHN = f"""list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i:
    CASE WHEN (length({_DIGITS}) - i) % 2 = 0 THEN {_DIGITS}[i]::INT
         WHEN {_DIGITS}[i]::INT > 4 THEN 2 * {_DIGITS}[i]::INT - 9 ELSE 2 * {_DIGITS}[i]::INT END)) % 10 = 0"""
_CODE = "replace(s.m, ' ', '')"
_MOD97 = f"""list_reduce(list_prepend(0, list_transform(range(1, length({_CODE}) + 1), lambda i:
    ascii((substring({_CODE}, 5) || {_CODE}[1:4])[i])::INT)),
    lambda a, c: CASE WHEN c > 57 THEN (a * 100 + c - 55) % 97 ELSE (a * 10 + c - 48) % 97 END) = 1"""

def _crc_sql(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of a text of code points below 256: a byte, then eight shifts."""
    return f"""(4294967295 - list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({text}, ''), lambda c:
        (CASE WHEN unicode(c) < 128 THEN [] ELSE [195, -1, -1, -1, -1, -1, -1, -1, -1] END)
        || [CASE WHEN unicode(c) < 128 THEN unicode(c) ELSE unicode(c) - 64 END::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda r, c: CASE WHEN c >= 0 THEN xor(r, c) WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END))"""


_FIELD = lambda c: f"coalesce(octet_length(encode(({c})::VARCHAR)) || ':' || ({c})::VARCHAR, '-')"
_LEAF = lambda n: f"sha256({' || '.join(map(_FIELD, ('doc_id', 'source', 'lang', n, 'text')))})"


def _path_sql(nodes: str) -> str:
    """One level up for rows (at, level, i, n, node, proof) of a path through a table of nodes."""
    return f"""p.level + 1, p.i // 2, (p.n + 1) // 2,
        sha256(CASE WHEN p.i % 2 = 1 THEN s.hash ELSE '' END || p.node || CASE WHEN p.i % 2 = 0 THEN coalesce(s.hash, '') ELSE '' END), p.proof || coalesce(s.hash, '')
        FROM p LEFT JOIN {nodes} s ON s.tree = p.tree AND s.level = p.level AND s.i = xor(p.i, 1) WHERE p.n > 1"""


ORACLE_SQL: dict[str, str] = {
    "op5_pii": f"""
        WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS (
            SELECT doc_id,
                {_found_sql("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+", "true")} AS email,
                {_found_sql("ip", "[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+", "regexp_full_match(s.m, '0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])([.]0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}')")} AS ip,
                {_found_sql("card", "[0-9](?:[ -]?[0-9])+", f"CASE WHEN length({_DIGITS}) BETWEEN 16 AND 19 THEN {_LUHN} ELSE false END")} AS card,
                {_found_sql("phone", "[+][0-9][ ().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 8 AND 15")} AS phone,
                {_found_sql("iban", pii.ACCOUNT, f"{_ALONE} AND {_MOD97}")} AS iban,
                {_found_sql("ssn", "[0-9]{3}-[0-9]{2}-[0-9]{4}", f"{_ALONE} AND NOT regexp_matches(s.m, '^(000|666|9)|-00-|-0000$') AND regexp_matches({_NEAR}, '(?:^|[^a-z0-9])(?:ssn|social|security)(?:[^a-z0-9]|$)')")} AS ssn
            FROM docs
        )
        SELECT doc_id, len(email) AS n_email, len(ip) AS n_ip, len(card) AS n_card, len(phone) AS n_phone,
               sha256(coalesce(array_to_string(list_transform(email || ip || card || phone, lambda s: s.text), ','), '')) AS base_sha256,
               coalesce(array_to_string(list_transform(email || ip || card || phone || iban || ssn, lambda s: s.text), ','), '') AS spans,
               coalesce(array_to_string(list_transform(email || ip || card || phone || iban || ssn, lambda s: s.score::VARCHAR), ','), '') AS scores
        FROM found
    """,
    "op7_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, row_number() OVER () AS r, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS at
            FROM documents
        ), keyed AS (
            SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM lines
        ), often AS (
            SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20
            GROUP BY key HAVING count(DISTINCT doc_id) >= 3
        )
        SELECT k.doc_id, count(*) AS n_lines,
               count(*) FILTER (o.key IS NOT NULL AND o.last <> k.doc_id) AS n_dropped,
               sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.at) FILTER (o.key IS NULL OR o.last = k.doc_id), '')) AS kept_sha256
        FROM keyed k LEFT JOIN often o USING (key) GROUP BY k.doc_id
    """,
    "op8_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   list_sum(list_transform(range(1, len(c.v) + 1), lambda i: c.v[i] * q.v[i]))::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 100 = 0
        ), ranked AS (
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
            FROM pairs
        )
        SELECT * FROM ranked WHERE rank <= 10
    """,
    "op9_chat": """
        WITH r AS (
            SELECT conv_id, max(turn) AS last, arg_min(coalesce(text, ''), turn) AS first_text
            FROM conversations WHERE role = 'assistant' AND turn IS NOT NULL AND conv_id IS NOT NULL GROUP BY conv_id
        ), own AS (
            SELECT c.conv_id, c.turn, coalesce(c.role, 'unknown') AS role, coalesce(c.text, '') AS text, c.turn = r.last AS is_last, r.first_text
            FROM conversations c JOIN r USING (conv_id) WHERE c.turn < r.last OR (c.turn = r.last AND c.role = 'assistant')
        ), sides AS (
            SELECT conv_id, turn, role, text, 1 AS c, 0 AS r FROM own
            UNION ALL SELECT conv_id, turn, role, CASE WHEN is_last THEN first_text ELSE text END, 0, 1 FROM own
        ), turns AS (SELECT conv_id, turn, role, text, max(c) = 1 AS c, max(r) = 1 AS r FROM sides GROUP BY conv_id, turn, role, text),
        cuts AS (SELECT conv_id, min(turn) AS cut FROM turns WHERE c <> r GROUP BY conv_id),
        parted AS (
            SELECT conv_id, turn, role, text, floor(turn / 1024)::BIGINT AS segment, turn < cut AS shared, c, r,
                   '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS m
            FROM turns JOIN cuts USING (conv_id)
        ), placed AS (
            SELECT *, sum(length(m)) FILTER (c) OVER w AS c_end, sum(length(m)) FILTER (r) OVER w AS r_end
            FROM parted WINDOW w AS (PARTITION BY conv_id, segment, shared ORDER BY turn, role, text)
        )
        SELECT conv_id AS pair_id, segment, count(*) FILTER (shared) AS n_prompt_turns,
               coalesce(string_agg(m, '' ORDER BY turn, role, text) FILTER (shared AND c), '') AS prompt,
               coalesce(string_agg(m, '' ORDER BY turn, role, text) FILTER (NOT shared AND c), '') AS chosen,
               coalesce(string_agg(m, '' ORDER BY turn, role, text) FILTER (NOT shared AND r), '') AS rejected,
               coalesce(string_agg((c_end - length(text) - 8)::BIGINT || ':' || c_end::BIGINT, ',' ORDER BY turn, role, text) FILTER (NOT shared AND c AND role = 'assistant'), '') AS chosen_spans,
               coalesce(string_agg((r_end - length(text) - 8)::BIGINT || ':' || r_end::BIGINT, ',' ORDER BY turn, role, text) FILTER (NOT shared AND r AND role = 'assistant'), '') AS rejected_spans
        FROM placed GROUP BY conv_id, segment
    """,
    "op11_merkle": f"""
        WITH RECURSIVE own AS (
            SELECT doc_id, coalesce('=' || lang, '') AS tree, {_LEAF("n_chars")} AS leaf,
                   CASE WHEN {_crc_sql("doc_id::VARCHAR")} % 7 = 0 THEN {_LEAF("n_chars + 1")} END AS tampered
            FROM documents
        ), leaves AS (
            SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM own
        ), nodes AS (
            SELECT tree, 0 AS level, i, n, leaf AS hash FROM leaves
            UNION ALL
            SELECT tree, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(hash, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY tree, level, n, i // 2
        ), subroots AS (
            SELECT tree AS lang, '' AS tree, hash, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1
        ), tops AS (
            SELECT tree, 0 AS level, i, n, hash FROM subroots
            UNION ALL
            SELECT tree, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(hash, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY tree, level, n, i // 2
        ), lower_path AS (
            SELECT tree, i AS at, 0 AS level, i, n, coalesce(tampered, leaf) AS node, '' AS proof FROM leaves
            UNION ALL
            SELECT p.tree, p.at, {_path_sql("nodes").replace("FROM p ", "FROM lower_path p ")}
        ), upper_path AS (
            SELECT s.tree, p.tree AS lang, p.at, s.hash AS subroot, 0 AS level, s.i, s.n, p.node, p.proof FROM lower_path p JOIN subroots s ON s.lang = p.tree WHERE p.n = 1
            UNION ALL
            SELECT p.tree, p.lang, p.at, p.subroot, {_path_sql("tops").replace("FROM p ", "FROM upper_path p ")}
        )
        SELECT l.doc_id, l.leaf, p.subroot, r.hash AS root, sha256(p.proof) AS proof_sha256, p.node AS folded_root, p.node = r.hash AS verified
        FROM leaves l JOIN upper_path p ON p.n = 1 AND p.lang = l.tree AND p.at = l.i, (SELECT hash FROM tops WHERE n = 1) r
    """,
    "op12_set_join": r"""
        WITH RECURSIVE parted AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
            FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS own
            FROM parted
        ), members AS (SELECT doc_id, len(own) AS n, unnest(own) AS gram FROM sets),
        links AS (
            SELECT a.doc_id AS u, b.doc_id AS v FROM members a JOIN members b ON a.gram = b.gram AND a.doc_id < b.doc_id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
        ), both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
        reached AS (
            SELECT u, v FROM both_ways UNION SELECT r.u, b.v FROM reached r JOIN both_ways b ON r.v = b.u
        )
        SELECT s.doc_id, len(s.own) AS n_shingles, least(s.doc_id, coalesce(min(r.v), s.doc_id)) AS component_id
        FROM sets s LEFT JOIN reached r ON r.u = s.doc_id GROUP BY s.doc_id, s.own
    """,
    "op13_spelling": f"""
        WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents),
        counted AS (
            SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS n
            FROM runs WHERE length(r) >= 7 GROUP BY ALL
        ), hashed AS (SELECT *, {_crc_sql("doc_id || ':' || r")} AS h FROM counted),
        garbled AS (SELECT CASE WHEN h % 31 = 0 THEN substring(r, 1, h % length(r)) || substring(r, h % length(r) + 2) ELSE r END AS word, n AS k FROM hashed),
        words AS (SELECT word, sum(k)::BIGINT AS n FROM garbled WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
        cut AS (
            SELECT word, i, substring(word, 1, i) || substring(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)
        ), near AS (
            SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
            UNION SELECT c.word, w.word FROM cut c JOIN words w ON c.rest = w.word
            UNION SELECT w.word, c.word FROM cut c JOIN words w ON c.rest = w.word
        ), best AS (
            SELECT a.word, count(*) OVER v AS n_near, b.word AS form, b.n AS form_n, row_number() OVER (v ORDER BY b.n DESC, b.word) AS r
            FROM near JOIN words a ON near.word = a.word JOIN words b ON near.near = b.word WINDOW v AS (PARTITION BY a.word)
        ), forms AS (
            SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.form_n >= 10 * w.n THEN b.form END AS form, CASE WHEN b.form_n >= 10 * w.n THEN b.form_n END AS form_n
            FROM words w LEFT JOIN best b ON w.word = b.word AND b.r = 1
        ), paths AS (
            SELECT word, word AS root FROM forms
            UNION ALL SELECT p.word, f.form FROM paths p JOIN forms f ON p.root = f.word WHERE f.form IS NOT NULL
        )
        SELECT f.word, f.form, p.root, f.n, f.n_near, f.form_n
        FROM forms f JOIN paths p ON p.word = f.word JOIN forms e ON e.word = p.root AND e.form IS NULL
    """,
}
