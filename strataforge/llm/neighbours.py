"""All-nearest-neighbours by shifted space-filling curves.

Each of `curves` curves projects the unit vectors on a random orthonormal basis of `dims` directions and orders them along a Hilbert curve of cells. Cells are cut at
shifted quantiles of each projection, so a crowded topic is spread over as many cells as it has rows. The order is cut at quantiles of the key into fine buckets of about `window` rows. A
block of buckets, with the first bucket of the next block, goes to one task, which compares each bucket with itself and with the next one by a matrix product
and keeps the `k` best of every row. The curves' answers are merged. Search runs on vectors rounded to 8 bits a value, packed with the ids into one record for
each block and Arrow batch; what comes out is ranked by similarities computed again from the stored vectors. Rows with equal vectors are searched once and share the answer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


@dataclass(frozen=True)
class CurveParams:
    """A row meets about 2 x window rows on each side on every curve. Recall at these values is given in the README."""

    k: int = 10
    slack: int = 6
    size: int = 64
    curves: int = 18
    dims: int = 10
    bits: int = 6
    fit_rows: int = 10_000  # rows, chosen by hash, from which the quantiles of the projections are taken; every row is indexed
    window: int = 2048
    block: int = 12  # fine buckets a task takes together
    least: float = -1.0  # neighbours less similar than this are not wanted
    merge_rows: int = 200_000  # candidate lists merged in one task
    broadcast_ids: int = 1_000_000  # ids of pairs sent to every task to pick their vectors; beyond it they are joined by shuffle
    seed: int = 11


#: For pairs of 0.9 and more, which most curves keep close together: fewer curves and smaller windows.
CLOSE = CurveParams(curves=10, window=1024, least=0.9)


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of integer cells (rows x dims, each < 2**bits <= 256)."""
    axis = [cells[:, i].astype(np.uint8) for i in range(cells.shape[1])]
    for level in range(bits - 1, 0, -1):
        low = np.uint8((1 << level) - 1)
        for i in range(len(axis)):
            on = -((axis[i] >> np.uint8(level)) & np.uint8(1))  # all ones where the bit is set
            if i:
                swap = (axis[0] ^ axis[i]) & low & ~on
                axis[0] = axis[0] ^ swap ^ (on & low)
                axis[i] = axis[i] ^ swap
            else:
                axis[0] = axis[0] ^ (on & low)
    for i in range(1, len(axis)):
        axis[i] = axis[i] ^ axis[i - 1]
    flip = np.zeros_like(axis[0])
    for level in range(bits - 1, 0, -1):
        flip ^= -((axis[-1] >> np.uint8(level)) & np.uint8(1)) & np.uint8((1 << level) - 1)
    key = np.zeros(len(axis[0]), np.uint64)
    for level in range(bits - 1, -1, -1):
        for a in axis:
            key = (key << np.uint64(1)) | (((a ^ flip) >> np.uint8(level)) & np.uint8(1))
    return key


def projected(unit: np.ndarray, curve: int, p: CurveParams) -> np.ndarray:
    basis = np.linalg.qr(np.random.default_rng([p.seed, curve]).normal(size=(p.size, p.size)))[0][:, : p.dims]
    return unit @ basis.astype(np.float32)


def cell_cuts(sample: np.ndarray, p: CurveParams) -> np.ndarray:
    """(curves, dims, 2**bits - 1): cell borders at quantiles of the sample's projections, shifted by a random part of a cell on each axis of each curve."""
    most = (1 << p.bits) - 1
    out = np.zeros((p.curves, p.dims, most), np.float32)
    if len(sample):
        for c in range(p.curves):
            z = projected(sample, c, p)
            shift = np.random.default_rng([p.seed, c, 1]).uniform(0, 1, p.dims)
            for d in range(p.dims):
                out[c, d] = np.quantile(z[:, d], (np.arange(most) + shift[d]) / most)
    return out


def curve_keys(unit: np.ndarray, ids: np.ndarray, curve: int, cuts: np.ndarray, p: CurveParams) -> np.ndarray:
    """Sort keys on one curve; the low bits spread rows that share a cell on every axis, so no cell is too large for a bucket."""
    z = projected(unit, curve, p)
    cells = np.stack([np.searchsorted(cuts[curve, d], z[:, d]) for d in range(p.dims)], axis=1).astype(np.uint8)
    spread = 62 - p.dims * p.bits
    noise = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - spread)) if spread > 0 else np.uint64(0)
    return ((hilbert_key(cells, p.bits) << np.uint64(spread)) | noise).astype(np.int64)


def usable(df: DataFrame, item_id: str, vector: str, size: int = 64) -> DataFrame:
    """(id, vec): rows with a vector of `size` values, none null or NaN, not all zero."""
    v = F.col(vector).cast("array<float>")
    good = v.isNotNull() & (F.size(v) == size) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(item_id).cast("bigint").alias("id"), v.alias("vec")).where(good & F.col("id").isNotNull())


def _unit(vecs: pd.Series, size: int) -> np.ndarray:
    x = np.concatenate(vecs.to_numpy()).reshape(-1, size).astype(np.float64) if len(vecs) else np.zeros((0, size))
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _rounded(unit: np.ndarray) -> list[bytes]:
    """Each unit vector in 8 bits a value, its largest value at 127."""
    top = np.abs(unit).max(axis=1, keepdims=True)
    return [x.tobytes() for x in np.rint(unit / top * 127).astype(np.int8)]


def _restored(body: bytes, size: int) -> np.ndarray:
    x = np.frombuffer(body, np.int8).reshape(-1, size).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), np.float32(1e-9))


def nearest(df: DataFrame, item_id: str, vector: str, params: CurveParams = CurveParams()) -> DataFrame:
    """(id, rank, neighbour, similarity): the k most similar other vectors of each usable one, nearest first, found approximately.

    Rows with a null, wrong-length, non-finite or all-zero vector neither search nor are found; re-delivered
    ids count once; ties go to the smaller id; a table with fewer rows gives fewer neighbours; other columns are ignored.
    Equal vectors form a class: it is searched once, and the classes' first members are handed out, so k neighbours
    come out for every row however large a class is. Similarities and ranks are exact over the k + `slack` candidates found.
    """
    p = params
    found = candidates(df, item_id, vector, replace(p, k=p.k + p.slack)).select("id", "neighbour")
    exact = exact_similarity(found, usable(df, item_id, vector, p.size).dropDuplicates(["id"]), "id", "neighbour", p.broadcast_ids)
    # Equal vectors differ by rounding alone; ten digits settle ties by id.
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.round("similarity", 10)), "neighbour"))
    return exact.withColumn("rank", place).where(F.col("rank") <= p.k).select("id", "rank", "neighbour", "similarity")


def candidates(df: DataFrame, item_id: str, vector: str, params: CurveParams) -> DataFrame:
    """(id, rank, neighbour, similarity) as in `nearest`, by the rounded vectors."""
    p = params
    ready = usable(df, item_id, vector, p.size)
    # Two independent 64-bit hashes stand for a vector, so classes are found without moving vectors.
    rows = cut_lineage(ready.select("id", F.xxhash64("vec").alias("c1"), F.xxhash64(F.lit(7), "vec").alias("c2")).dropDuplicates(["id"]))
    classes = cut_lineage(_classes(rows, p.k))
    small = ready.mapInPandas(lambda it: _round_rows(it, p), "id bigint, q binary")
    reps = small.join(classes.select(F.col("rep").alias("id")), "id", "left_semi").dropDuplicates(["id"])
    n = classes.count()
    drawn = F.pmod(F.xxhash64(F.lit(p.seed), "id"), F.lit(max(1, n // p.fit_rows))) == 0
    some = ready.where(drawn).join(classes.select(F.col("rep").alias("id")), "id", "left_semi").select("vec").limit(2 * p.fit_rows).toPandas()
    cuts = df.sparkSession.sparkContext.broadcast(cell_cuts(_unit(some["vec"], p.size), p))
    keyed = cut_lineage(reps.mapInPandas(lambda it: _with_keys(it, cuts.value, p), "id bigint, q binary, keys array<bigint>"))
    fine = max(1, round(n / p.window))
    edges = np.zeros((p.curves, 0), np.int64)
    if fine > 1:
        shares = [i / fine for i in range(1, fine)]
        per = keyed.select(F.posexplode("keys").alias("curve", "key")).groupBy("curve").agg(F.percentile_approx("key", shares, min(1_000_000, 20 * fine)).alias("e"))
        edges = np.array([r["e"] for r in per.orderBy("curve").collect()], np.int64)  # curves x n / window values
    sent = df.sparkSession.sparkContext.broadcast(edges)
    blobs = keyed.mapInPandas(lambda it: _emit_blocks(it, sent.value, fine, p), "curve int, block int, fine binary, ids binary, q binary")
    # About one block a partition, however many rows there are.
    blobs = blobs.repartition(max(1, math.ceil(fine / p.block) * p.curves), "curve", "block")
    best = blobs.groupBy("curve", "block").applyInPandas(lambda pdf: _search(pdf, p), "id bigint, ids binary, sims binary")
    parts = max(1, math.ceil(n * p.curves / p.merge_rows))
    merged = best.repartition(parts, "id").mapInPandas(lambda it: _merge(it, p.k), "rep bigint, other bigint, sim double")
    return _hand_out(merged, classes, rows, p.k)


def _round_rows(it: Iterator[pd.DataFrame], p: CurveParams) -> Iterator[pd.DataFrame]:
    for pdf in it:
        yield pd.DataFrame({"id": pdf["id"], "q": _rounded(_unit(pdf["vec"], p.size))})


def _with_keys(it: Iterator[pd.DataFrame], cuts: np.ndarray, p: CurveParams) -> Iterator[pd.DataFrame]:
    for pdf in it:
        unit, ids = _restored(b"".join(pdf["q"]), p.size), pdf["id"].to_numpy()
        keys = np.stack([curve_keys(unit, ids, c, cuts, p) for c in range(p.curves)], axis=1)
        yield pd.DataFrame({"id": ids, "q": pdf["q"], "keys": list(keys)})


def _emit_blocks(it: Iterator[pd.DataFrame], edges: np.ndarray, fine: int, p: CurveParams) -> Iterator[pd.DataFrame]:
    """One record for each curve and block of a batch. A block's first bucket also goes to the block before it."""
    for pdf in it:
        ids, keys = pdf["id"].to_numpy(), np.stack(pdf["keys"].to_numpy())
        q = np.frombuffer(b"".join(pdf["q"]), np.int8).reshape(-1, p.size)
        out = []
        for c in range(p.curves):
            f = np.searchsorted(edges[c], keys[:, c], "right") if fine > 1 else np.zeros(len(ids), np.int64)
            block = f // p.block
            guest = np.nonzero((f % p.block == 0) & (f > 0))[0]
            row, to = np.concatenate([np.arange(len(f)), guest]), np.concatenate([block, block[guest] - 1])
            order = np.argsort(to, kind="stable")
            row, to = row[order], to[order]
            at = np.flatnonzero(np.diff(to, prepend=-1))
            for s, e in zip(at, np.append(at[1:], len(to)), strict=True):
                mine = row[s:e]
                out.append((c, to[s], f[mine].astype(np.int32).tobytes(), ids[mine].tobytes(), q[mine].tobytes()))
        yield pd.DataFrame(out, columns=["curve", "block", "fine", "ids", "q"]).astype({"curve": "int32", "block": "int32"})


def _search(pdf: pd.DataFrame, p: CurveParams) -> pd.DataFrame:
    """The k best of every row of a block, from each bucket against itself and the next."""
    fine = np.frombuffer(b"".join(pdf["fine"]), np.int32)
    order = np.argsort(fine, kind="stable")
    fine, ids = fine[order], np.frombuffer(b"".join(pdf["ids"]), np.int64)[order]
    x = _restored(b"".join(pdf["q"]), p.size)[order]
    block = int(pdf["block"].iloc[0])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for f in np.unique(fine[fine // p.block == block]):
        lo, mid, hi = np.searchsorted(fine, [f, f + 1, f + 2])
        for s in range(lo, mid, 512):
            e = min(s + 512, mid)
            sims = x[s:e] @ x[lo:hi].T
            sims[np.arange(e - s), np.arange(s - lo, e - lo)] = -2
            a, b, v = best_rows(sims, p.k, p.least - 0.02)
            found.append((ids[s + a], ids[lo + b], v))
            if hi > mid:
                a, b, v = best_rows(np.ascontiguousarray(sims[:, mid - lo :].T), p.k, p.least - 0.02)
                found.append((ids[mid + a], ids[s + b], v))
    if not found:
        return pd.DataFrame({"id": np.zeros(0, np.int64), "ids": [], "sims": []})
    a, b, v = best_of(*(np.concatenate(z) for z in zip(*found, strict=True)), p.k)
    at = np.flatnonzero(np.diff(a, prepend=a[0] - 1)) if len(a) else np.zeros(0, np.int64)
    ends = np.append(at[1:], len(a))
    return pd.DataFrame({"id": a[at], "ids": [b[i:j].tobytes() for i, j in zip(at, ends, strict=True)], "sims": [v[i:j].astype(np.float32).tobytes() for i, j in zip(at, ends, strict=True)]})


def best_rows(sims: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of values above `least` among which are the k largest of each row.

    The k-th largest maximum over column groups is at most the k-th largest value, so a pass over the groups'
    maxima gives each row a threshold that few values pass.
    """
    rows, cols = sims.shape
    group = 16
    high = np.float32(max(least, -1.5))
    if high > 0.7:
        a, b = np.nonzero(sims >= high)
        if len(a) <= 2 * k * rows:  # few pass, whatever k is; in a crowded topic the k best are kept as below
            return a, b, sims[a, b]
    tops = sims[:, : cols // group * group].reshape(rows, -1, group).max(axis=2) if cols > 4 * k * group else sims
    if tops.shape[1] <= k:
        floor = np.full((rows, 1), high)
    else:
        floor = np.maximum(np.partition(tops, tops.shape[1] - k, axis=1)[:, tops.shape[1] - k, None], high)
    a, b = np.nonzero(sims >= floor)
    return a, b, sims[a, b]


def best_of(rep: np.ndarray, other: np.ndarray, sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs, the k most similar of each rep, ordered; ties go to the smaller id."""
    order = np.lexsort((other, rep))
    rep, other, sim = rep[order], other[order], sim[order]
    first = np.ones(len(rep), bool)
    first[1:] = (rep[1:] != rep[:-1]) | (other[1:] != other[:-1])
    rep, other, sim = rep[first], other[first], sim[first]
    order = np.lexsort((other, -sim, rep))
    rep, other, sim = rep[order], other[order], sim[order]
    keep = np.arange(len(rep)) - np.searchsorted(rep, rep, "left") < k
    return rep[keep], other[keep], sim[keep]


def _merge(it: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """The k best over all curves; a partition holds all lists of its ids, about `merge_rows` of them."""
    parts = [x for x in it if len(x)]
    if parts:
        pdf = pd.concat(parts)
        rep = np.repeat(pdf["id"].to_numpy(), [len(x) // 8 for x in pdf["ids"]])
        sim = np.frombuffer(b"".join(pdf["sims"]), np.float32).astype(np.float64)
        rep, other, sim = best_of(rep, np.frombuffer(b"".join(pdf["ids"]), np.int64), sim, k)
        yield pd.DataFrame({"rep": rep, "other": other, "sim": sim})


def _classes(rows: DataFrame, k: int) -> DataFrame:
    """(rep, members, c1, c2): classes of equal vectors with their k + 1 smallest ids, salted against hot classes.

    The rank limit runs before the shuffle, so a class reaches a task as at most salts x (k + 1) ids.
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    first = salted.withColumn("n", F.row_number().over(Window.partitionBy("c1", "c2", "salt").orderBy("id"))).where(F.col("n") <= k + 1)
    return first.groupBy("c1", "c2").agg(F.slice(F.sort_array(F.collect_list("id")), 1, k + 1).alias("members")).select(F.col("members")[0].alias("rep"), "members", "c1", "c2")


def _hand_out(merged: DataFrame, classes: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Neighbours of classes to neighbours of rows: a class's own members come first, at similarity 1."""
    own = classes.where(F.size("members") > 1).select("rep", F.col("members").alias("near"), F.lit(1.0).alias("sim"))
    others = merged.join(classes.select(F.col("rep").alias("other"), F.col("members").alias("near")), "other").select("rep", "near", F.least("sim", F.lit(1.0)).alias("sim"))
    # At most k + 1 lists of at most k + 1 ids each for a class.
    lists = own.unionByName(others).select("rep", "sim", F.explode("near").alias("near"))
    per = lists.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct((-F.col("sim")).alias("far"), "near"))).alias("c"))
    short = per.select("rep", F.slice("c", 1, k + 1).alias("c"))
    single = classes.where(F.size("members") == 1).select("rep", F.col("rep").alias("id"))
    many = classes.where(F.size("members") > 1).select("rep", "c1", "c2")
    members = single.unionByName(rows.join(many, ["c1", "c2"]).select("rep", "id"))
    top = F.slice(F.filter("c", lambda x: x["near"] != F.col("id")), 1, k)
    return members.join(short, "rep").select("id", F.posexplode(top).alias("rank", "x")).select("id", (F.col("rank") + 1).alias("rank"), F.col("x.near").alias("neighbour"), (-F.col("x.far")).alias("similarity"))


def exact_similarity(pairs: DataFrame, vectors: DataFrame, a: str, b: str, broadcast_ids: int) -> DataFrame:
    """`pairs` with `similarity` computed in double precision from the stored vectors (id, vec)."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    pairs = cut_lineage(pairs)
    ids = pairs.select(F.explode(F.array(a, b)).alias("id")).distinct()
    few = ids.count() <= broadcast_ids
    wanted = vectors.join(F.broadcast(ids) if few else ids, "id", "left_semi")
    va, vb = wanted.select(F.col("id").alias(a), F.col("vec").alias("va")), wanted.select(F.col("id").alias(b), F.col("vec").alias("vb"))
    both = pairs.drop("similarity").join(va, a).join(vb, b)
    return both.withColumn("similarity", dot(F.col("va"), F.col("vb")) / F.sqrt(dot(F.col("va"), F.col("va")) * dot(F.col("vb"), F.col("vb")))).drop("va", "vb")


def similar_pairs(df: DataFrame, item_id: str, vector: str, params: CurveParams = CLOSE) -> DataFrame:
    """(id_a, id_b, similarity), id_a < id_b: pairs of at least `params.least` of which one is among the k nearest of the other.

    Similarities and ranks are exact over the candidates the curves found. Unusable rows and ties are as in `nearest`.
    """
    p = params
    # Some more than k are searched: rounding may reorder near ties, which exact similarities settle.
    near = candidates(df, item_id, vector, replace(p, k=p.k + p.slack))
    pairs = near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
    exact = exact_similarity(pairs, usable(df, item_id, vector, p.size).dropDuplicates(["id"]), "id_a", "id_b", p.broadcast_ids).where(F.col("similarity") >= p.least - 1e-9)
    ends = F.array(F.struct(F.col("id_a").alias("u"), F.col("id_b").alias("v")), F.struct(F.col("id_b").alias("u"), F.col("id_a").alias("v")))
    place = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("similarity"), "v"))
    kept = exact.select("similarity", F.explode(ends).alias("e")).select("similarity", "e.u", "e.v").withColumn("n", place).where(F.col("n") <= p.k)
    return kept.groupBy(F.least("u", "v").alias("id_a"), F.greatest("u", "v").alias("id_b")).agg(F.max("similarity").alias("similarity"))
