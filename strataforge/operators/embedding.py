"""Embedding of chunks in bounded requests, and the guard of an index's model and dimension."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most texts and most characters of one embedding request.
MOST_TEXTS, MOST_CHARS = 100, 50_000


class TooLarge(ValueError):
    """Raised by an embedder for a request beyond its size."""


def hash_embedder(dimension: int = 256) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic offline embedder: words are hashed to signed positions, earlier words weigh more; unit vectors, all zero for no word."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(dimension)
            for i, w in enumerate(re.findall(r"[^\W_]+", t.lower())):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=16).digest(), "little")
                for k in range(4):
                    part = h >> (32 * k)
                    v[part % dimension] += (1.0 if part & (1 << 31) else -1.0) / (1 + i / 8)
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out

    return embed


def requests(texts: list[str], most_texts: int = MOST_TEXTS, most_chars: int = MOST_CHARS) -> Iterator[list[str]]:
    """Consecutive texts in requests within both limits; a longer text has one to itself."""
    now: list[str] = []
    size = 0
    for t in texts:
        if now and (len(now) == most_texts or size + len(t) > most_chars):
            yield now
            now, size = [], 0
        now.append(t)
        size += len(t)
    if now:
        yield now


def embed_safely(embed: Callable[[list[str]], list[list[float]]], texts: list[str]) -> list[list[float]]:
    """A request that is too large is halved until it fits; a single text that is too large is tried once more by its first half."""
    try:
        return embed(texts)
    except TooLarge:
        if len(texts) == 1:
            return embed([texts[0][: len(texts[0]) // 2]])
        half = len(texts) // 2
        return embed_safely(embed, texts[:half]) + embed_safely(embed, texts[half:])


def embedding_text(title: Column, url: Column, path: Column, content: Column) -> Column:
    """What is embedded for a chunk: title, URL and path in tags, then the content."""
    e = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(F.lit("<title>"), e(title), F.lit("</title>\n<url>"), e(url), F.lit("</url>\n<path>"), F.coalesce(F.array_join(path, " / "), F.lit("")), F.lit("</path>\n"), e(content))


def embed_column(df: DataFrame, text: str, into: str, dimension: int, make: Callable[[], Callable[[list[str]], list[list[float]]]] | None = None) -> DataFrame:
    """`df` with `into`: array<float> of `dimension` values, shorter vectors padded with zeros, longer ones refused; null for a null text. `make` builds an embedder in each task."""
    make = make or (lambda: hash_embedder(dimension))

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = make()
        for s in batches:
            have = [t for t in s if t is not None]
            found = iter([v for r in requests(have) for v in embed_safely(embed, r)])
            out = [None if t is None else fit(next(found), dimension) for t in s]
            yield pd.Series(out, dtype=object)

    return df.withColumn(into, run(text))


def fit(v: list[float], dimension: int, truncate: bool = False) -> list[float]:
    """A vector of the index's dimension: padded with zeros, or cut where the model allows that."""
    if len(v) > dimension and not truncate:
        raise ValueError(f"a vector of {len(v)} values does not fit an index of {dimension}")
    return [*v[:dimension], *[0.0] * (dimension - len(v))]


def check_model(manifest: dict[str, str], model: str, dimension: int) -> bool:
    """Whether stored vectors can stay: the same model and dimension, or none stored yet. Otherwise all have to be made again."""
    return manifest.get("embedding_model", model) == model and int(manifest.get("embedding_dimension", dimension)) == dimension


def invalidate(chunks: DataFrame, column: str = "embedding") -> DataFrame:
    return chunks.withColumn(column, F.lit(None).cast(dict(chunks.dtypes)[column]))
