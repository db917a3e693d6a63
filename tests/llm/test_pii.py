"""Spans against Python's regular expressions with the plain patterns."""

import re

from talkmill.llm.pii import redacted, spans
from talkmill.tables import load

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(d) <= 19 and luhn(d or "0"), "phone": 8 <= len(d) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def base(row):
    return [(s.kind, s.start, s.end) for s in row.spans if s.kind in PLAIN]


def test_whole_table(spark):
    docs = load(spark, "/root/testdata/sf0.01", "documents")
    got = spans(docs).collect()
    assert all(base(r) == plain(r.text) for r in got)
    kinds = {s.kind for r in got for s in r.spans}
    assert {"email", "phone"} <= kinds
    assert all(r.text[s.start : s.end] == s.match for r in got for s in r.spans)


def test_edges(spark):
    texts = [
        None, "", "a@b.c%d@e.f x@y", "é😀 write to jo.hn@mail.example.com.", "1.2.3.4.5.6.7.8 999.1.1.1 001.02.3.255 1..2.3.4.5",
        "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111111", "+1 (555) 010-9999) +12 +1((((((( +49 30 123456-", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
        "IBAN DE89 3704 0044 0532 0130 00, xGB82WEST12345698765432, GB82WEST12345698765432!", "ssn 123-45-6789; 123-45-6789" + " " * 60 + "123-45-6789",
        "a" * 50_000, "9" * 50_000, "1.2." * 10_000, "a@b." * 5_000 + "com", "1.1.1.1 " * 3_000, "+" * 9_000 + "(" * 9_000,
    ]
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(texts)], "doc_id long, text string, spans string, _x int")
    got = {r.doc_id: r for r in spans(docs).collect()}
    for i, t in enumerate(texts):
        assert base(got[i]) == plain(t), i
    assert [(s.kind, s.match) for s in got[8].spans] == [("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432")]
    assert [s.start for s in got[9].spans if s.kind == "ssn"] == [4, 17]
    assert {s.score for s in got[3].spans} == {1.0}
    assert spans(docs.limit(0)).count() == 0
    more = ["pay GB82 WEST 1234 5698 7654 32 PLEASE PAY", "NO93 8601 1117 947 OK", "DE89370400440532013001", "ship to 1.2.3.4 in a hotel", "the IP is 1.2.3.4", "social 123-45-6789", "antisocial 123-45-6789"]
    found = {r.doc_id: r.spans for r in spans(spark.createDataFrame(list(enumerate(more)), "doc_id long, text string")).collect()}
    assert [s.match for i in range(3) for s in found[i] if s.kind == "iban"] == ["GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947"]
    assert [round(s.score, 2) for i in (3, 4) for s in found[i]] == [0.6, 0.8] and [len(found[i]) for i in (5, 6)] == [1, 0]
    clash = docs.withColumnsRenamed({"_x": "_hit_email"}).withColumn("_text", docs["doc_id"]).withColumn("_row", docs["doc_id"])
    assert spans(clash).select("_hit_email", "_text", "_row", "doc_id").first() == (1, 0, 0, 0)
    clean = redacted(spans(docs.where("doc_id in (3, 9)"))).orderBy("doc_id").collect()
    assert clean[0].text == "é😀 write to [email]." and clean[1].text.startswith("ssn [ssn]; [ssn] ")
