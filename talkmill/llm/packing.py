"""Packing by power-of-two decomposition.

A document's ids are cut into pieces of the sequence length, then into the binary digits of what is
left, largest first. Pieces of equal length form a bucket. Each piece is a sequence of its own, so no
sequence crosses documents and none needs padding: every length is a power of two.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Texts that are encoded together.
GROUP = 100


def binary_lengths(n: int, longest: int) -> list[int]:
    """Lengths that sum to n: whole `longest` (a power of two) first, then the binary digits of the rest."""
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if n % longest >> b & 1]


class Encoder:
    """Ids of whole texts by a tokenizer that never joins characters across white space.

    All ids come from the tokenizer. It is asked once for each word, and a bounded table remembers the word's ids, as
    little-endian 32-bit numbers. New words are encoded together, as one text; the offsets of the tokens tell the words apart.
    Words of ASCII are parted by the tokenizer's own pattern first, if its classes mean no more there than A-Z and 0-9: their
    parts are fewer than the words, and the tokens that end a part tell them apart.
    """

    #: Separators that str.split() knows and the tokenizer does not.
    ODD = ("\x1c", "\x1d", "\x1e", "\x1f")

    def __init__(self, path: str, end_id: int, limit: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a worker for each core; idle threads would spin
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.end, self.known, self.parts = np.array([end_id], "<u4").tobytes(), {}, {}
        self.special = tuple(x.content for x in self.tokenizer.get_added_tokens_decoder().values())
        if self._whole("to be") != self._whole("to") + self._whole("be"):
            raise ValueError(f"{path}: this tokenizer's ids depend on the blanks around a word")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.pattern = self._ascii_pattern()

    def _ascii_pattern(self) -> re.Pattern | None:
        """The tokenizer's pattern over lower-case ASCII; none if it has no such pattern, or if a probe of all pairs of characters tells otherwise."""
        steps = (json.loads(self.tokenizer.to_str()).get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        source = (steps[0].get("pattern") or {}).get("Regex", "")
        if not source or not self.ends.any():
            return None
        pattern = re.compile(source.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9"))
        points = [chr(c) for c in range(33, 127)]
        probe = [f"a{x}{y}{x}b'{y}s{x}9" for x in points for y in points]
        for word in probe:
            if pattern.findall(word.lower()) != [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(word))]:
                return None
        return pattern

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Adds new words to the table."""
        plain = [w for w in words if w.isascii()] if self.pattern else []
        if plain:
            cut = [self.pattern.findall(w.lower()) for w in plain]
            if len(self.parts) > self.limit:
                self.parts.clear()
            if new := list({p for own in cut for p in own}.difference(self.parts)):
                ids = np.array(self.tokenizer.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, "<u4")
                stops = ((np.nonzero(self.ends[ids])[0] + 1) * 4).tolist()
                if len(stops) == len(new):
                    raw = ids.tobytes()
                    self.parts.update(zip(new, map(raw.__getitem__, map(slice, [0, *stops], stops))))
                else:
                    self.parts.update((p, self._whole(p)) for p in new)
            parts = self.parts
            self.known.update((w, b"".join([parts[p] for p in own])) for w, own in zip(plain, cut))
            words = [w for w in words if not w.isascii()]
        if not words:
            return
        found = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        start = np.cumsum([0, *map(len, words)]) + np.arange(len(words) + 1)
        first = np.fromiter((o[0] for o in found.offsets), np.int64, len(found.ids))
        cut = np.searchsorted(first, start)
        if (cut[1:] > cut[:-1]).all() and (first[cut[:-1]] == start[:-1]).all():
            raw, cut = np.array(found.ids, "<u4").tobytes(), (cut * 4).tolist()
            self.known.update(zip(words, map(raw.__getitem__, map(slice, cut[:-1], cut[1:]))))
        else:
            self.known.update((w, self._whole(w)) for w in words)

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, with the end id."""
        texts = [t or "" for t in texts]
        plain = [not any(c in t for c in self.ODD) and not any(x in t for x in self.special) for t in texts]
        words = [t.split() if p else None for t, p in zip(texts, plain)]
        if len(self.known) > self.limit:
            self.known.clear()
        if new := list({w for own in words if own for w in own}.difference(self.known)):
            self._learn(new)
        known = self.known
        return [(self._whole(t) if own is None else b"".join(map(known.__getitem__, own))) + self.end for t, own in zip(texts, words)]


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    return Encoder(path, end_id)


def passing_encoder(path: str, end_id: int, words: int) -> Encoder:
    """An encoder that goes with its task and remembers about so many words."""
    return Encoder(path, end_id, words)


def pieces(documents: DataFrame, tokenizer_path: str, end_id: int = 2, longest: int = 4096, words: int | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) for each piece of documents(doc_id, text).

    A null or empty text is its end id alone. Rows stay apart, repeated ids too; a null doc_id stays
    null. No rows give no rows; further columns are not read. `tokenizer_path` must exist on the executors.
    A worker keeps its encoder for later tasks, unless `words` says how many words a task's own encoder may remember: then
    nothing of it is left in the worker for the stages of a longer job.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer_path, end_id) if words is None else passing_encoder(tokenizer_path, end_id, words)
        for b in batches:
            out: list[tuple[int | None, int, int, int, int]] = []
            texts = b["text"].tolist()
            for at in range(0, len(texts), GROUP):
                for doc, ids in zip(b["doc_id"].iloc[at : at + GROUP], encode(texts[at : at + GROUP])):
                    n, start = len(ids) // 4, 0
                    doc = None if pd.isna(doc) else int(doc)
                    for length in binary_lengths(n, longest):
                        out.append((doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n))
                        start += length
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"]).astype({"doc_id": "Int64"})

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(each, SCHEMA)


def packed(documents: DataFrame, tokenizer_path: str, end_id: int = 2, longest: int = 4096, words: int | None = None) -> DataFrame:
    """`pieces` with sequence_id, offset and bucket (the length's binary logarithm).

    Sequence ids order by bucket: four bits of bucket, then the partition and the row within it, so
    no shuffle or count is needed to make them unique.
    """
    cut = pieces(documents, tokenizer_path, end_id, longest, words)
    bucket = F.floor(F.log2(F.col("length") + F.lit(0.5))).cast("long")
    return cut.withColumn("bucket", bucket).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.shiftleft(F.col("bucket"), 59).bitwiseOR(F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"), "bucket",
    )
