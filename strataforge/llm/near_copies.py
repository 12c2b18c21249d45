"""Near-copies of texts: segment popcounts, a grid over bands of segments, Manhattan bound, exact Jaccard check.

A text is its set of word shingles, read as a sparse bit fingerprint: bit h(s) for every shingle s. The fingerprint is cut
into segments and embedded as the vector of their bit counts. The Manhattan distance of two such vectors is at most the
size of the symmetric difference, so Jaccard >= t needs a distance of at most (1 - t) / (1 + t) * (|A| + |B|): a lower bound
that drops most candidates before shingles are compared.

One grid over the whole vector prunes little at t = 0.6 (the allowed distance is half the text), so the join runs on bands:
a band is a slice of the hash space holding about `per_band` bits of a text, itself cut into segments, and its vector of counts is
the grid cell. Two near-copies have, in each band, the same counts with probability around exp(-changed bits in it), so over
`bands` bands they meet in a cell almost surely (tests and the README give the measured recall). Texts meet only in size
classes whose bounds keep any qualifying pair together. Bands say little of sets of a few shingles; those meet in a cell for each shingle, which
misses no pair. Equal texts are joined once, as a class; other texts with equal shingle sets have equal cells and are linked.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .words import Hasher, mix, split_words


#: Words whose shingles are hashed together; their arrays stay in a core's cache.
SHINGLED_WORDS = 1 << 15


@dataclass(frozen=True)
class CopyParams:
    """Words a shingle, least Jaccard similarity, least words a text; the rest sets recall against work."""

    shingle: int = 5
    similarity: float = 0.8
    least_words: int = 5
    bands: int = 96
    per_band: float = 5.0
    least_bits: int = 3  # cells of fewer bits would hold unrelated texts that share a stock phrase
    few_shingles: int = 8  # sets up to this size are joined by shingle
    band_segments: int = 256
    entries_per_part: int = 1_500_000  # cell entries sorted together in one task
    hot_cell: int = 3_000  # texts in one cell beyond which its pairs are made by a shuffle join instead
    broadcast_ids: int = 1_000_000  # texts with candidates whose ids are sent to every task; beyond it they are joined by shuffle
    seed: int = 23


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of n words; one hash of all words where there are fewer."""
    if len(words) < n:
        return np.zeros(0, np.uint64) if not len(words) else np.unique(_fold([words[i : i + 1] for i in range(len(words))]))
    return np.unique(_fold([words[i : len(words) - n + 1 + i] for i in range(n)]))


def _fold(columns: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(columns[0]), np.uint64)
    with np.errstate(over="ignore"):
        for i, c in enumerate(columns):
            out = mix(out * np.uint64(31) + c, i + 1)
    return out


def size_class(n: np.ndarray, similarity: float) -> np.ndarray:
    """Class c holds sizes with 1 / similarity ** c <= n; qualifying pairs are at most one class apart."""
    return np.floor(np.log(np.maximum(n, 1)) / -math.log(similarity) + 1e-9).astype(np.int64)


def cells(shingles: np.ndarray, owner: np.ndarray, texts: int, level: int, p: CopyParams) -> tuple[np.ndarray, np.ndarray]:
    """(owner, key) of every band with enough bits, of texts of one class: the band's number and its segments' bit counts, hashed.

    `owner` numbers the text of each shingle. A sum of mixed segment numbers stands for a band's counts, so no counts are laid out.
    """
    top = p.similarity ** -(level + 1)  # most bits of a text in this class
    slices = max(1, round(top / p.per_band))
    owners, keys = [], []
    for turn in range(max(1, math.ceil(p.bands / slices))):
        h = mix(shingles, p.seed + 7919 * turn)
        band = (((h >> np.uint64(32)) * np.uint64(slices)) >> np.uint64(32)).astype(np.int64)
        some = min(slices, p.bands - turn * slices)
        who = owner
        if some < slices:
            used = band < some
            h, band, who = h[used], band[used], owner[used]
        at = who * some + band
        n = np.bincount(at, minlength=texts * some)
        total = np.zeros(texts * some, np.uint64)
        with np.errstate(over="ignore"):
            np.add.at(total, at, mix(h & np.uint64(p.band_segments - 1), 99))
            full = np.nonzero(n >= p.least_bits)[0]
            key = mix(total[full] + n[full].astype(np.uint64), 1000 * level + turn) ^ mix((full % some).astype(np.uint64), 7)
        owners.append(full // some)
        keys.append(key)
    return np.concatenate(owners), np.concatenate(keys)


def popcounts(shingles: np.ndarray) -> np.ndarray:
    """Bit counts, at most 255 each, of 2**i segments, about one for two bits. Neighbouring segments add up to those of the next smaller 2**i."""
    m = max(6, math.ceil(math.log2(max(len(shingles), 1) / 2)))
    where = mix(shingles, 5) >> np.uint64(64 - m)
    return np.minimum(np.bincount(where.astype(np.int64), minlength=1 << m), 255).astype(np.uint8)


def manhattan(a: np.ndarray, b: np.ndarray) -> int:
    """Distance of two popcount vectors, the longer folded to the shorter's segments."""
    a, b = a.astype(np.int32), b.astype(np.int32)
    while len(a) > len(b):
        a = a.reshape(-1, 2).sum(axis=1)
    while len(b) > len(a):
        b = b.reshape(-1, 2).sum(axis=1)
    return int(np.abs(a - b).sum())


def _shingles(texts: list[str], hasher: Hasher, p: CopyParams) -> list[np.ndarray | None]:
    """The shingle set of each text; None for those with too few words. Runs are hashed for many texts at once."""
    out: list[np.ndarray | None] = [None] * len(texts)
    some: list[tuple[int, np.ndarray]] = []
    held = 0
    for i, t in enumerate(texts):
        words = split_words(t, fold=False)
        if len(words) < p.least_words:
            continue
        if len(words) < p.shingle:
            out[i] = shingle_set(hasher(words), p.shingle)
            continue
        some.append((i, hasher(words)))
        held += len(words)
        if held > SHINGLED_WORDS:
            _shingle_sets(some, p.shingle, out)
            some, held = [], 0
    _shingle_sets(some, p.shingle, out)
    return out


def _shingle_sets(some: list[tuple[int, np.ndarray]], n: int, out: list[np.ndarray | None]) -> None:
    """Put the `shingle_set` of every (place, words) into its place; none has less than n words."""
    if not some:
        return
    words = np.concatenate([w for _, w in some])
    runs = _fold([words[i : len(words) - n + 1 + i] for i in range(n)])
    ends = np.cumsum([len(w) for _, w in some])
    starts = ends - [len(w) for _, w in some]
    fresh = np.ones(len(runs), bool)
    for lo, hi in zip(starts, ends - n + 1, strict=True):
        runs[lo:hi].sort()
    fresh[1:] = runs[1:] != runs[:-1]
    fresh[starts] = True
    for (i, _), lo, hi in zip(some, starts, ends - n + 1, strict=True):
        out[i] = runs[lo:hi][fresh[lo:hi]]


def _emit_cells(it: Iterator[pd.DataFrame], parts: int, p: CopyParams) -> Iterator[pd.DataFrame]:
    """A record for each batch and part: codes of its texts, and of each entry the text's number (with the home flag) and 48 bits of the cell."""
    hasher = Hasher()
    for whole in it:
        for lo in range(0, len(whole), 16384):
            pdf = whole.iloc[lo : lo + 16384].drop_duplicates("code")
            kept = [(c, s) for c, s in zip(pdf["code"], _shingles(pdf["text"].tolist(), hasher, p), strict=True) if s is not None]
            if not kept:
                continue
            codes = np.array([c for c, _ in kept], np.int64)
            sizes = np.array([len(s) for _, s in kept])
            flat, owner = np.concatenate([s for _, s in kept]), np.repeat(np.arange(len(kept)), sizes)
            level = size_class(sizes, p.similarity)
            few = np.nonzero((sizes <= p.few_shingles / p.similarity + 1e-9)[owner])[0]
            who, cell = [owner[few].astype(np.uint16) | np.uint16(1 << 15)], [mix(flat[few], p.seed)]
            for c in np.unique(np.concatenate([level, level + 1])):
                for home in (True, False):  # as host of its own class and as guest of the next
                    inside = (level == c - (not home)) & (sizes > p.few_shingles)
                    if inside.any():
                        number = np.cumsum(inside) - 1
                        on = inside[owner]
                        o, k = cells(flat[on], number[owner[on]], int(inside.sum()), int(c), p)
                        who.append(np.nonzero(inside)[0][o].astype(np.uint16) | np.uint16(home << 15))
                        cell.append(k)
            who, cell = np.concatenate(who), np.concatenate(cell)
            part = (cell % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            who, cell, cut = who[order], cell[order] >> np.uint64(16), np.searchsorted(part[order], np.arange(parts + 1))
            out = []
            for i in range(parts):
                w, k = who[cut[i] : cut[i + 1]], cell[cut[i] : cut[i + 1]]
                if len(w):
                    used, number = np.unique(w & np.uint16(0x7FFF), return_inverse=True)
                    out.append((i, codes[used].tobytes(), (number.astype(np.uint16) | (w & np.uint16(0x8000))).tobytes(), k.astype(np.uint32).tobytes(), (k >> np.uint64(32)).astype(np.uint16).tobytes()))
            yield pd.DataFrame(out, columns=["part", "codes", "who", "low", "high"]).astype({"part": "int32"})


def _pairs_of_part(pdf: pd.DataFrame, p: CopyParams) -> pd.DataFrame:
    """Distinct pairs of texts that share a cell; the members of hot cells as they are (kind 1)."""
    code, home, cell = [], [], []
    for codes, who, low, high in zip(pdf["codes"], pdf["who"], pdf["low"], pdf["high"], strict=True):
        w = np.frombuffer(who, np.uint16)
        code.append(np.frombuffer(codes, np.int64)[w & np.uint16(0x7FFF)])
        home.append(w >> np.uint16(15))
        cell.append(np.frombuffer(low, np.uint32).astype(np.int64) | (np.frombuffer(high, np.uint16).astype(np.int64) << 32))
    code, home, cell = np.concatenate(code), np.concatenate(home).astype(bool), np.concatenate(cell)
    order = np.lexsort((code, cell))
    code, home, cell = code[order], home[order], cell[order]
    fresh = np.ones(len(code), bool)
    fresh[1:] = (code[1:] != code[:-1]) | (cell[1:] != cell[:-1])  # a text may come from several batches
    code, home, cell = code[fresh], home[fresh], cell[fresh]
    size = np.diff(np.append(starts := np.flatnonzero(np.diff(cell, prepend=cell[:1] - 1)), len(cell)))
    run = np.repeat(size, size)
    hot = run > p.hot_cell
    out = [pd.DataFrame({"kind": 1, "a": cell[hot], "b": code[hot], "home": home[hot]})]
    busy = np.nonzero((run > 1) & ~hot)[0]
    last = np.repeat(starts + size, size)
    found = np.zeros((0, 2), np.int64)
    step = 1
    while len(busy):
        busy = busy[busy + step < last[busy]]
        on = busy[home[busy] | home[busy + step]]
        found = np.concatenate([found, np.stack([code[on], code[on + step]], axis=1)])
        if len(found) > 4_000_000:
            found = np.unique(found, axis=0)
        step += 1
    found = pd.DataFrame(found, columns=["a", "b"]).drop_duplicates()
    out.append(found.assign(kind=0, home=True)[["kind", "a", "b", "home"]])
    return pd.concat(out).astype({"kind": "int32"})


def near_copies(df: DataFrame, item_id: str, text: str, params: CopyParams = CopyParams()) -> tuple[DataFrame, DataFrame]:
    """(members, links): every text's class of exact copies, and similar classes.

    members (id, code): one row an id; `code` is the 64-bit hash of the text that names its class. links (code_a, code_b,
    similarity), code_a < code_b: classes whose Jaccard similarity is at least `params.similarity`, computed exactly. Null texts and those
    with fewer than `least_words` words have no links; those shorter than a shingle use single words; re-delivered ids count once;
    other columns are ignored; an empty table gives empty results. Copies of a text meet only as one code, and no link is dropped for
    the size of a cell: pairs of hot cells are made by a shuffle join with skew handling.
    """
    p = params
    raw = df.select(F.col(item_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")).where(F.col("text").isNotNull() & F.col("id").isNotNull())
    coded = raw.select("id", F.xxhash64("text").alias("code"), "text")
    members = cut_lineage(coded.select("id", "code").dropDuplicates(["id"]))
    parts = max(1, math.ceil(members.count() * 2 * p.bands / p.entries_per_part))
    blobs = coded.select("code", "text").mapInPandas(lambda it: _emit_cells(it, parts, p), "part int, codes binary, who binary, low binary, high binary")
    found = cut_lineage(blobs.repartition(parts, "part").groupBy("part").applyInPandas(lambda pdf: _pairs_of_part(pdf, p), "kind int, a bigint, b bigint, home boolean"))
    hot = found.where("kind = 1")
    x, y = hot.alias("x"), hot.alias("y")
    more = x.join(y, F.col("x.a") == F.col("y.a")).where((F.col("x.b") < F.col("y.b")) & (F.col("x.home") | F.col("y.home"))).select(F.col("x.b").alias("code_a"), F.col("y.b").alias("code_b"))
    few = found.where("kind = 0").select(F.least("a", "b").alias("code_a"), F.greatest("a", "b").alias("code_b"))
    return members, _verified(few.unionByName(more).distinct(), coded, members, p)


def _verified(pairs: DataFrame, coded: DataFrame, members: DataFrame, p: CopyParams) -> DataFrame:
    """Manhattan bound on the popcounts, then exact Jaccard similarity. Only texts with a candidate are read again, one row a class."""
    t = p.similarity
    pairs = cut_lineage(pairs)
    counts = cut_lineage(_of_texts(pairs, coded, members, p, lambda s: popcounts(s).tobytes()))

    @F.pandas_udf("int")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([manhattan(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) for x, y in zip(a, b, strict=True)])

    @F.pandas_udf("double")
    def jaccard(na: pd.Series, nb: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        both = np.array([len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(a, b, strict=True)], np.int64)
        return pd.Series(both / np.maximum(na.to_numpy() + nb.to_numpy() - both, 1))

    def with_both(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
        side = lambda s: bodies.select(*[F.col(c).alias(f"{c}_{s}") for c in ("code", "n", "body")])
        return pairs.join(side("a"), "code_a").join(side("b"), "code_b")

    most = (1 - t) / (1 + t) * (F.col("n_a") + F.col("n_b")) + 1e-6
    near = with_both(pairs, counts).where(F.abs(F.col("n_a") - F.col("n_b")) <= most).where(distance("body_a", "body_b") <= most)
    near = cut_lineage(near.select("code_a", "code_b"))
    exact = with_both(near, _of_texts(near, coded, members, p, lambda s: s.tobytes()))
    return exact.select("code_a", "code_b", jaccard("n_a", "n_b", "body_a", "body_b").alias("similarity")).where(F.col("similarity") >= t - 1e-12)


def _of_texts(pairs: DataFrame, coded: DataFrame, members: DataFrame, p: CopyParams, body: Callable[[np.ndarray], bytes]) -> DataFrame:
    """(code, n, body) of the texts in pairs, each read from the least id that holds it, so texts themselves are not shuffled."""
    codes = pairs.select(F.explode(F.array("code_a", "code_b")).alias("code")).distinct()
    ids = cut_lineage(members.join(codes, "code", "left_semi").groupBy("code").agg(F.min("id").alias("id")).select("id"))
    few = ids.count() <= p.broadcast_ids

    def measure(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for pdf in it:
            sets = _shingles(pdf["text"].tolist(), hasher, p)
            yield pd.DataFrame({"code": pdf["code"], "n": np.array([len(s) for s in sets], np.int32), "body": [body(s) for s in sets]})

    read = coded.join(F.broadcast(ids) if few else ids, "id", "left_semi").select("code", "text")
    return read.mapInPandas(measure, "code bigint, n int, body binary").dropDuplicates(["code"])


def expand_pairs(members: DataFrame, links: DataFrame, usable: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of ids, within classes whose code is in `usable` and across linked ones; as many rows as there are such pairs."""
    m = members.select("code", "id")
    same = m.join(usable.select("code"), "code", "left_semi")
    own = same.alias("x").join(same.alias("y"), F.col("x.code") == F.col("y.code")).where(F.col("x.id") < F.col("y.id")).select(F.col("x.id").alias("id_a"), F.col("y.id").alias("id_b"))
    left = links.join(m.select(F.col("code").alias("code_a"), F.col("id").alias("p")), "code_a").join(m.select(F.col("code").alias("code_b"), F.col("id").alias("q")), "code_b")
    return own.unionByName(left.select(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b")))


def copied_codes(df: DataFrame, members: DataFrame, text: str, params: CopyParams) -> DataFrame:
    """(code) of texts stored under several ids that have at least `least_words` words."""
    many = members.groupBy("code").agg(F.count("*").alias("n")).where("n > 1").select("code")
    body = df.select(F.xxhash64(F.col(text).cast("string")).alias("code"), F.col(text).cast("string").alias("text")).where(F.col("text").isNotNull())
    words = F.size(F.regexp_extract_all(F.lower("text"), F.lit("([\\p{L}\\p{N}]+)"), F.lit(1)))
    return body.join(many, "code", "left_semi").where(words >= params.least_words).select("code").distinct()


def groups(members: DataFrame, links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(id, group_id, links): connected groups named by the least code in them, and the number of classes linked to the id's own.

    Label propagation with pointer jumping over classes; every round is a shuffle join, its lineage cut.
    """
    ends = links.select(F.explode(F.array(F.struct(F.col("code_a").alias("u"), F.col("code_b").alias("v")), F.struct(F.col("code_b").alias("u"), F.col("code_a").alias("v")))).alias("e")).select("e.u", "e.v")
    ends = cut_lineage(ends)
    degree = ends.groupBy("u").agg(F.count("*").alias("links"))
    label = cut_lineage(ends.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("g")))
    for _ in range(most_rounds):
        near = ends.join(label.select(F.col("u").alias("v"), "g"), "v").groupBy("u").agg(F.min("g").alias("h"))
        low = label.join(near, "u").select("u", F.col("g").alias("was"), F.least("g", "h").alias("g"))
        jump = low.join(label.select(F.col("u").alias("g"), F.col("g").alias("j")), "g", "left").select("u", "was", F.least("g", F.coalesce("j", "g")).alias("g"))
        jump = cut_lineage(jump)
        label = jump.select("u", "g")
        if jump.where("g < was").isEmpty():
            break
    else:
        raise RuntimeError(f"groups not settled after {most_rounds} rounds")
    return members.join(label.select(F.col("u").alias("code"), "g"), "code", "left").join(degree.select(F.col("u").alias("code"), "links"), "code", "left").select("id", F.coalesce("g", "code").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
