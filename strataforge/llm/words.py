"""Word streams: the one definition of a word, and fast hashing of words in Arrow batches."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import xxhash

#: A word is a maximal run of letters or digits.
WORD = re.compile(r"[^\W_]+")
#: Soft hyphen, zero-width and directional marks, byte-order mark.
INVISIBLE = re.compile("[­͏؜᠋-᠎​-‏‪-‮⁠-⁤︀-️﻿]")


def canonical(text: str) -> str:
    """Compatibility form without invisible characters, in lower case."""
    if text.isascii():
        return text.lower()
    if not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    return INVISIBLE.sub("", text).lower()


def split_words(text: str | None, fold: bool = True) -> list[str]:
    if not text:
        return []
    return WORD.findall(canonical(text) if fold else text.lower())


class Hasher:
    """64-bit word hashes with a bounded memo; the memo only saves time."""

    def __init__(self, most: int = 1 << 20):
        self.memo: dict[str, int] = {}
        self.most = most

    def __call__(self, words: list[str]) -> np.ndarray:
        memo = self.memo
        if len(memo) > self.most:
            memo.clear()
        try:
            return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for w in set(words):
                if w not in memo:
                    memo[w] = xxhash.xxh3_64_intdigest(w)
            return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser, vectorised."""
    with np.errstate(over="ignore"):
        h = h ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        return h
