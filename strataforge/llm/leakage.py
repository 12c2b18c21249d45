"""Evaluation passages inside a corpus: CGK random-walk embedding, bit-sampling LSH, exact edit check.

Every window of `window` words of an item passage, and of every document, is walked by the CGK embedding: at step j
the current word is written out and the read position advances by a random bit that depends on (j, word). Windows at
edit distance e get embeddings at Hamming distance O(e^2), whatever the edits are. Each repetition samples positions of
the embedding into one 64-bit key; windows that share a key in any repetition are candidates, and every candidate is
verified by word-level edit distance. Equal windows share every key, so at `max_edits=0` one repetition has recall 1; its sample is then
all positions, which is an exact window key. Passages shorter than the window are searched in windows of `least_window` words with edits in proportion.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Hasher, mix, split_words

PAD = 0x7F4A7C159E3779B9


@dataclass(frozen=True)
class LeakParams:
    """`repetitions` and `samples` set the recall at `max_edits` > 0 (README); `broadcast_windows` bounds what each task is sent."""

    window: int = 8
    least_window: int = 0  # window of passages shorter than `window`; 0: they are not searched
    max_edits: int = 0
    repetitions: int = 1
    samples: int = 0  # 0: every position of the embedding
    broadcast_windows: int = 2_000_000
    seed: int = 17


def window_keys(hashes: np.ndarray, starts: np.ndarray, p: LeakParams, rep: int) -> np.ndarray:
    """The LSH key of each window hashes[s : s + window]."""
    w, steps = p.window, 3 * p.window
    rng = np.random.default_rng(p.seed + rep)
    seeds = rng.integers(1, 1 << 31, steps)
    keep = set(rng.choice(steps, p.samples, replace=False).tolist()) if p.samples else set(range(steps))
    at = np.zeros(len(starts), np.int64)
    key = np.full(len(starts), rep + 1, np.uint64)
    pad, prime, turn = np.uint64(PAD), np.uint64(0x9E3779B185EBCA87), np.uint64(29)
    padded = np.append(hashes, pad)
    with np.errstate(over="ignore"):
        for j in range(steps):
            bits = (mix(padded, int(seeds[j])) >> np.uint64(63)).astype(np.int64)
            src = np.where(at < w, starts + at, len(hashes))
            if j in keep:
                key = (key ^ padded[src]) * prime
                key ^= key >> turn
            at += bits[src]
    return key


def _starts(lengths: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of every full window over concatenated texts, and the text each belongs to."""
    n = np.maximum(lengths - w + 1, 0)
    owner = np.repeat(np.arange(len(lengths)), n)
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.zeros(0, np.int64)
    inside = np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n) if len(n) else n
    return np.repeat(begin, n) + inside, owner


def edit_distance_at_most(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Banded word-level Levenshtein distance of a against the best-aligned prefix of b."""
    if most == 0:
        return len(b) >= len(a) and bool((a == b[: len(a)]).all())
    prev = np.arange(len(b) + 1)
    for i, x in enumerate(a, 1):
        cur = np.minimum(prev[:-1] + (b != x), prev[1:] + 1)
        row = np.concatenate([[i], cur])
        row = np.minimum.accumulate(row - np.arange(len(row))) + np.arange(len(row))
        if row.min() > most:
            return False
        prev = row
    return int(prev[max(0, len(a) - most) : len(a) + most + 1].min()) <= most


def _encode(texts: pd.Series, hasher: Hasher, pads: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts laid end to end, each with `pads` signs after it that equal no word, and their lengths with these."""
    words = [split_words(t) for t in texts]
    lengths = np.array([len(x) + pads for x in words], np.int64)
    if not pads:
        flat = [w for ws in words for w in ws]
        return hasher(flat) if flat else np.zeros(0, np.uint64), lengths
    end = np.full(pads, PAD, np.uint64)
    return np.concatenate([x for ws in words for x in (hasher(ws), end)]) if words else np.zeros(0, np.uint64), lengths


def _item_windows(items: DataFrame, item_id: str, passages: list[str], p: LeakParams, shorter_than: int = 0) -> DataFrame:
    """item_id, key, words: one row for each window, repetition and passage column; of passages `shorter_than` so many words alone, where that is given."""
    long = items.select(F.col(item_id).alias("item_id"), F.explode(F.array(*[F.col(c).cast("string") for c in passages])).alias("passage"))

    def make(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for pdf in it:
            h, lengths = _encode(pdf["passage"], hasher)
            starts, owner = _starts(lengths, p.window)
            if shorter_than:
                short = lengths[owner] < shorter_than
                starts, owner = starts[short], owner[short]
            span = [h[s : s + p.window].astype(np.int64) for s in starts]
            for rep in range(p.repetitions):
                yield pd.DataFrame({"item_id": pdf["item_id"].to_numpy()[owner], "key": window_keys(h, starts, p, rep).astype(np.int64), "words": pd.Series(span, dtype=object)})

    return long.where(F.col("passage").isNotNull()).mapInPandas(make, f"item_id {dict(items.dtypes)[item_id]}, key bigint, words array<bigint>")


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, passages: list[str], params: LeakParams = LeakParams()) -> DataFrame:
    """(doc_id, item_id) of every document holding, within `max_edits`, a window of an item's passage; each pair once.

    A null or empty text, or one shorter than the window less the edits, matches nothing; repeated rows yield one pair; a pair is
    reported for every item that shares the passage. Columns other than those named are ignored. The item windows are sent to the tasks
    while they are at most `broadcast_windows`; beyond that both sides' keys are joined by shuffle instead.
    """
    p = params
    found = _find(docs, items, doc_id, text, item_id, passages, p, 0)
    if 0 < p.least_window < p.window:
        short = replace(p, window=p.least_window, max_edits=p.max_edits * p.least_window // p.window)
        found = found.unionByName(_find(docs, items, doc_id, text, item_id, passages, short, p.window))
    return found.distinct()


def _find(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, passages: list[str], p: LeakParams, shorter_than: int) -> DataFrame:
    kind, item_kind = dict(docs.dtypes)[doc_id], dict(items.dtypes)[item_id]
    windows = _item_windows(items, item_id, passages, p, shorter_than)
    corpus = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).where(F.length("text") >= 2 * (p.window - p.max_edits) - 1)
    sample = windows.limit(p.broadcast_windows + 1).toPandas()
    if len(sample) <= p.broadcast_windows:
        order = np.argsort(sample["key"].to_numpy(), kind="stable")
        keys = sample["key"].to_numpy()[order]
        ids = sample["item_id"].to_numpy()[order]
        grams = np.array([np.asarray(x, np.int64) for x in sample["words"]], np.int64).reshape(-1, p.window)[order]
        sent = docs.sparkSession.sparkContext.broadcast((keys, ids, grams))

        def scan(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            keys, ids, grams = sent.value
            hasher = Hasher()
            for pdf in it:
                for lo in range(0, len(pdf), 512):
                    yield _scan_batch(pdf.iloc[lo : lo + 512], hasher, keys, ids, grams, p)

        found = corpus.mapInPandas(scan, f"doc_id {kind}, item_id {item_kind}")
    else:
        found = _join_keys(corpus, windows, kind, p)
    return found


def _scan_batch(pdf: pd.DataFrame, hasher: Hasher, keys: np.ndarray, ids: np.ndarray, grams: np.ndarray, p: LeakParams) -> pd.DataFrame:
    h, lengths = _encode(pdf["text"], hasher, p.max_edits)
    starts, owner = _starts(lengths, p.window)
    ends = np.cumsum(lengths)
    hits: set[tuple[int, int]] = set()
    if len(keys) and len(starts):
        for rep in range(p.repetitions):
            k = window_keys(h, starts, p, rep).astype(np.int64)
            left, right = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
            for i in np.nonzero(right > left)[0]:
                o = owner[i]
                span = h[starts[i] : min(starts[i] + p.window + p.max_edits, ends[o])].view(np.int64)
                for j in range(left[i], right[i]):
                    if (o, ids[j]) not in hits and edit_distance_at_most(grams[j], span, p.max_edits):
                        hits.add((o, ids[j]))
    docs = pdf["doc_id"].to_numpy()
    return pd.DataFrame({"doc_id": [docs[o] for o, _ in hits], "item_id": [i for _, i in hits]})


def _join_keys(corpus: DataFrame, windows: DataFrame, kind: str, p: LeakParams) -> DataFrame:
    """The same candidates by a shuffle join of keys, for item sets too large to send to every task."""

    def emit(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for pdf in it:
            for lo in range(0, len(pdf), 128):
                part = pdf.iloc[lo : lo + 128]
                h, lengths = _encode(part["text"], hasher, p.max_edits)
                starts, owner = _starts(lengths, p.window)
                ends = np.cumsum(lengths)[owner] if len(owner) else np.zeros(0, np.int64)
                spans = [h[s : min(s + p.window + p.max_edits, e)].astype(np.int64) for s, e in zip(starts, ends, strict=True)]
                for rep in range(p.repetitions):
                    yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[owner], "key": window_keys(h, starts, p, rep).astype(np.int64), "span": pd.Series(spans, dtype=object)})

    near = corpus.mapInPandas(emit, f"doc_id {kind}, key bigint, span array<bigint>").join(windows, "key")
    if p.max_edits == 0:
        return near.where(F.col("span") == F.col("words")).select("doc_id", "item_id")

    @F.pandas_udf("boolean")
    def close(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([edit_distance_at_most(np.asarray(x), np.asarray(y), p.max_edits) for x, y in zip(a, b, strict=True)])

    return near.where(close("words", "span")).select("doc_id", "item_id")
