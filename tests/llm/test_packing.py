"""Pieces against the tokenizer run on whole texts."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from talkmill.llm.packing import Encoder, packed
from talkmill.tables import load

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text):
    return np.array(Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [2], "<u4")


def held(rows, ids):
    """Every id lies in one piece; lengths are powers of two; a sequence is one piece."""
    rows = sorted(rows, key=lambda r: r.start)
    at = 0
    for r in rows:
        assert r.start == at and r.length & (r.length - 1) == 0 and r.length <= 4096 and r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes()) and r.offset == 0
        at += r.length
    assert at == len(ids)


def test_whole_table(spark):
    docs = load(spark, "/root/testdata/sf0.01", "documents")
    got = packed(docs, PATH).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    tokenizer = Tokenizer.from_file(PATH)
    own = {}
    for r in got:
        own.setdefault(r.doc_id, []).append(r)
    for d in docs.collect():
        held(own[d.doc_id], np.array(tokenizer.encode(d.text or "", add_special_tokens=False).ids + [2], "<u4"))


def test_table_that_is_cleared():
    small = Encoder(PATH, 2, limit=3)
    for text in ("one two three four five six one", "Seven, eight! nine? ten; one two", "one two one"):
        assert small([text]) == [ids_of(text).tobytes()]


def test_random_unicode_texts():
    """Words of any code points, marks in any order, all kinds of blanks: the same ids as the tokenizer's on the whole text."""
    rng, encode, tokenizer = random.Random(5), Encoder(PATH, 2), Tokenizer.from_file(PATH)
    blanks = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    marks = [chr(c) for c in (*range(0x300, 0x370), *range(0x1DC0, 0x1E00), 0x3099, 0x1161, 0x11A8)]
    usual = "aAbBzZ09'.,-_%stSreİıßΣσς\u0130Ωﬁǅ"
    point = lambda: chr(rng.choice((rng.randrange(0x20, 0x3000), rng.randrange(0x3000, 0xD800), rng.randrange(0xE000, 0x110000))))
    texts = []
    for _ in range(100_000):
        texts.append("".join(rng.choice((rng.choice(usual), rng.choice(usual), rng.choice(blanks), rng.choice(marks), point())) for _ in range(rng.randrange(1, 12))))
    whole = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    for at in range(0, len(texts), 100):
        for t, got, want in zip(texts[at : at + 100], encode(texts[at : at + 100]), whole[at : at + 100]):
            assert got == np.array([*want.ids, 2], "<u4").tobytes(), ascii(t)


def test_random_ascii_words():
    rng, encode, tokenizer = random.Random(6), Encoder(PATH, 2, limit=2_000), Tokenizer.from_file(PATH)
    assert encode.pattern
    usual = "aAbtTsSrRvVmMlLdDeE09.,-_ " + 5 * chr(39) + "".join(map(chr, range(1, 128)))
    texts = ["".join(rng.choice(usual) for _ in range(rng.randrange(1, 20))) for _ in range(60_000)]
    for at in range(0, len(texts), 100):
        own = texts[at : at + 100]
        for x, got, want in zip(own, encode(own), tokenizer.encode_batch_fast(own, add_special_tokens=False)):
            assert got == np.array([*want.ids, 2], "<u4").tobytes(), ascii(x)


def test_every_code_point():
    """Each code point alone, inside a word and beside a blank."""
    encode, tokenizer = Encoder(PATH, 2), Tokenizer.from_file(PATH)
    texts = [f"a{c} {c}b {c}" for c in map(chr, (*range(1, 0xD800), *range(0xE000, 0x20000)))]
    for at in range(0, len(texts), 500):
        own = texts[at : at + 500]
        for t, got, want in zip(own, encode(own), tokenizer.encode_batch_fast(own, add_special_tokens=False)):
            assert got == np.array([*want.ids, 2], "<u4").tobytes(), ascii(t)


def test_edges(spark):
    texts = [None, "", " ", "a<|endoftext|>b", "x\x1cy\x1dz w", "é é ́ \xa0q\x85r s​t　u", "word " * 20_000, "a" * 9_000, "it's don'T 12ab3", "x''s 'sss ''' a_b %%%*** ½² ªº ǅ İx ß ﬁ Ⅳ", "word\u200bx y\u0301 \u0301z \ufeffq \u0130stanbul \u03a3\u03a3", "<|startoftext|> <|end oftext|>"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    got = packed(docs, PATH).collect()
    for i, t in enumerate(texts):
        held([r for r in got if r.doc_id == i], ids_of(t))
    assert packed(docs.limit(0), PATH).count() == 0
    same = spark.createDataFrame([(None, "a b"), (None, "a b"), (7, "c")], "doc_id long, text string")
    assert packed(same, PATH).where("doc_id is null").selectExpr("sum(length)").first()[0] == 6
