"""Tokens, the Porter stemmer and the full-text query language."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tokens(text: Column) -> Column:
    """Runs of letters or digits in lower case, by built-in expressions; null gives an empty array."""
    return F.coalesce(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != ""), F.array().cast("array<string>"))


_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Lower case without diacritics, as full-text indexes fold Latin letters."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


def words(text: str | None) -> list[str]:
    return _WORD.findall(fold(text)) if text else []


def _consonant(w: str, i: int) -> bool:
    c = w[i]
    return c not in "aeiou" and (c != "y" or i == 0 or not _consonant(w, i - 1))


def _measure(stem: str) -> int:
    shape = re.sub(r"(.)\1+", r"\1", "".join("c" if _consonant(stem, i) else "v" for i in range(len(stem))))
    return shape.count("vc")


def _has_vowel(stem: str) -> bool:
    return any(not _consonant(stem, i) for i in range(len(stem)))


def _short(w: str) -> bool:
    n = len(w)
    return n >= 3 and _consonant(w, n - 1) and not _consonant(w, n - 2) and _consonant(w, n - 3) and w[-1] not in "wxy"


# The suffix tables of Porter's published algorithm.
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _longest(w: str, suffixes) -> str | None:
    return max((s for s in suffixes if w.endswith(s)), key=len, default=None)


@lru_cache(maxsize=200_000)
def porter(w: str) -> str:
    """The stem of a word of ASCII letters; others are returned as they are."""
    if len(w) <= 2 or not (w.isascii() and w.isalpha()):
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = next((s for s in ("ed", "ing") if w.endswith(s) and _has_vowel(w[: -len(s)])), None)
        if cut:
            w = w[: -len(cut)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) >= 2 and w[-1] == w[-2] and _consonant(w, len(w) - 1) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short(w):
                w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        s = _longest(w, table)
        if s and _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + table[s]
    s = _longest(w, _STEP4)
    if s:
        stem = w[: -len(s)]
        if _measure(stem) > 1 and (s != "ion" or stem.endswith(("s", "t"))):
            w = stem
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def stem_tokens(text: str | None) -> list[str]:
    return [porter(w) for w in words(text)]


def stems(text: Column) -> Column:
    """Stemmed tokens; Arrow batches, for the stemmed index only."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(stem_tokens)

    return run(text)


def phrases(query: Column) -> Column:
    """The phrases of each query, in Arrow batches; none of a null one."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda q: parse_query(q) if q else [])

    return run(query)


def match_expressions(query: Column) -> Column:
    """The match expression of each query, in Arrow batches."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(match_expression)

    return run(query)


_PHRASE = re.compile(r'"([^"]*)(?:"|$)|([^" ]+)')


def parse_query(q: str) -> list[str]:
    """Phrases of a search: what stands between quotes, or else between blanks and quotes; a last quote left open runs to the end. Several give the whole as one phrase first, then each one."""
    parts = [x for pair in _PHRASE.findall(q) if (x := pair[0] or pair[1])]
    return parts if len(parts) < 2 else [" ".join(parts), *parts]


def match_expression(q: str) -> str:
    """The query as a match expression of quoted phrases joined by OR; doubled quotes inside."""
    parts = parse_query(q)
    return " OR ".join('"' + p.replace('"', '""') + '"' for p in parts) if parts else '""'
