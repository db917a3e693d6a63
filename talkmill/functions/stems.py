"""Word stems by Porter's published algorithm (1980)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings and what they become, in the order in which they are tried.
SECOND = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
THIRD = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")



def _shape(word: str) -> str:
    """v for each vowel and c for each consonant; y is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in "aeiou" or (c == "y" and i > 0 and out[-1] == "c") else "c"
    return out


def _measure(word: str) -> int:
    """How often vowels are followed by consonants."""
    return len(re.findall("v+c+", _shape(word)))


def _short_end(word: str) -> bool:
    """Ends consonant, vowel, consonant other than w, x and y."""
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters, or with other characters than a-z, are their own."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    w = re.sub("sses$", "ss", word) if word.endswith("sses") else re.sub("ies$", "i", word) if word.endswith("ies") else re.sub("(?<!s)s$", "", word)
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    elif (cut := re.match("(.*)(?:ed|ing)$", w)) and "v" in _shape(cut[1]):
        w = cut[1]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _short_end(w):
            w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for endings in (SECOND, THIRD):
        end, new = next((e for e in sorted(endings, key=lambda e: -len(e[0])) if w.endswith(e[0])), ("", ""))
        if end and _measure(w[: -len(end)]):
            w = w[: -len(end)] + new
    end = next((e for e in sorted(FOURTH, key=lambda e: -len(e)) if w.endswith(e)), "")
    if end and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[-4] in "st"):
        w = w[: -len(end)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short_end(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


def stems(word: Column) -> Column:
    """The stem of each word; meant for distinct words, not for running text."""

    @F.pandas_udf("string")
    def of(words: pd.Series) -> pd.Series:
        return words.map(stem, na_action="ignore")

    return of(word)
