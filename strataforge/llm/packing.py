"""Filling containers of fixed capacity: shortest-pack-first over the length histogram.

Only the histogram of lengths (at most `capacity` entries) reaches the driver. Lengths are placed longest first, all
items of a length together, each time into the packing pattern with the most room left; a pattern used only in part is
split. The patterns are then joined back to the documents by the rank of a document within its length.
"""

from __future__ import annotations

import base64
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


@dataclass(frozen=True)
class PackParams:
    """`vocabulary` is a tiktoken rank file; ranks within a length are counted in salts of about `rows_per_salt` rows."""

    vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    pattern: str = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    rows_per_salt: int = 500_000
    most_salts: int = 256


@lru_cache(maxsize=4)
def _encoder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, doc_id: str, text: str, params: PackParams = PackParams()) -> DataFrame:
    """(doc_id, n_tokens) by the given public vocabulary; null and empty texts have 0 tokens. Stored estimates are not used."""
    kind = dict(docs.dtypes)[doc_id]
    path, pattern = params.vocabulary, params.pattern

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoder(path, pattern)
        for pdf in it:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": [len(enc.encode_ordinary(t.encode("utf-8", "replace").decode())) if t else 0 for t in pdf["text"]]})

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInPandas(count, f"doc_id {kind}, n_tokens bigint")


@dataclass
class Plan:
    """Tiles of rank space: items of `length` with rank in [rank, rank + count) go to containers first, first + 1, ..."""

    containers: int = 0
    tiles: list[tuple[int, int, int, int]] = field(default_factory=list)  # length, rank, count, first container


def plan(histogram: dict[int, int], capacity: int) -> Plan:
    """Shortest-pack-first: longest lengths first, each item into the open pack with the most room.

    Packs alike are kept as runs (room, first container, count), so the work depends on the number of lengths, not of
    items. Where no open pack has room, new containers take as many items of the length as they hold.
    """
    open_runs: list[tuple[int, int, int]] = []  # (-room, first container, count): a heap, the shortest packs on top
    out = Plan()
    for length in sorted((x for x in histogram if x > 0), reverse=True):
        left, rank = histogram[length], 0
        while left and open_runs and -open_runs[0][0] >= length:
            room, first, count = heapq.heappop(open_runs)
            used = min(count, left)
            if used < count:
                heapq.heappush(open_runs, (room, first + used, count - used))
            if -room > length:
                heapq.heappush(open_runs, (room + length, first, used))
            out.tiles.append((length, rank, used, first))
            rank, left = rank + used, left - used
        if not left:
            continue
        each = capacity // length
        whole, odd = divmod(left, each)
        first = out.containers
        out.containers += whole + (odd > 0)
        for turn in range(each):  # the last of the new containers gets `odd` items, the others `each`
            count = whole + (turn < odd)
            if count:
                out.tiles.append((length, rank, count, first))
                rank += count
        for at, count, items in ((first, whole, each), (first + whole, int(odd > 0), odd)):
            if count and capacity - items * length > 0:
                heapq.heappush(open_runs, (items * length - capacity, at, count))
    return out


def pack(sizes: DataFrame, capacity: int, params: PackParams = PackParams()) -> DataFrame:
    """container_id, doc_id, part_no, token_start, n_tokens from (doc_id, n_tokens).

    Every document comes out once, whole, unless it has more than `capacity` tokens: then full containers are cut off its
    front and the rest is placed like a document. Documents without tokens go to container 0. Repeated ids are placed as often as given;
    null sizes count as 0; an empty table gives no rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    n = F.coalesce("n_tokens", F.lit(0)).cast("bigint")
    base = sizes.select("doc_id", n.alias("n_tokens"))
    rows = base.where(F.col("n_tokens") > 0).withColumn("rest", F.when(F.col("n_tokens") > capacity, F.col("n_tokens") % capacity).otherwise(F.col("n_tokens"))).withColumn("full", F.expr(f"case when n_tokens > {capacity} then n_tokens div {capacity} else 0 end"))
    totals = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("full"), F.lit(0)).alias("full")).first()
    salts = min(params.most_salts, max(1, math.ceil(totals["n"] / params.rows_per_salt)))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("rest", "salt").agg(F.count("*").alias("n")).toPandas().sort_values(["rest", "salt"])  # <= capacity x most_salts rows
    histogram = {int(k): int(v) for k, v in counts.groupby("rest")["n"].sum().items() if k > 0}
    done = plan(histogram, capacity)
    counts["offset"] = counts.groupby("rest")["n"].cumsum() - counts["n"]
    groups, offsets = (counts["rest"] * params.most_salts + counts["salt"]).to_numpy(np.int64), counts["offset"].to_numpy(np.int64)  # sorted, as counts are
    tiles = np.array(sorted(done.tiles), np.int64).reshape(-1, 4)
    sent = sizes.sparkSession.sparkContext.broadcast((groups, offsets, tiles))
    ranked = salted.where("rest > 0").withColumn("rank", F.row_number().over(Window.partitionBy("rest", "salt").orderBy("doc_id")) - 1)
    kind = dict(sizes.dtypes)["doc_id"]
    most = params.most_salts
    schema = f"container_id bigint, doc_id {kind}, part_no int, token_start bigint, n_tokens bigint"

    def place(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups, offsets, tiles = sent.value
        starts = tiles[:, 0] * (1 << 42) + tiles[:, 1]
        for pdf in it:
            rest = pdf["rest"].to_numpy()
            rank = pdf["rank"].to_numpy() + offsets[np.searchsorted(groups, rest * most + pdf["salt"].to_numpy())]
            i = np.searchsorted(starts, rest * (1 << 42) + rank, "right") - 1
            yield pd.DataFrame({"container_id": tiles[i, 3] + rank - tiles[i, 1], "doc_id": pdf["doc_id"], "part_no": pdf["full"].astype("int32"), "token_start": pdf["full"] * capacity, "n_tokens": rest})

    placed = ranked.select("doc_id", "rest", "full", "salt", "rank").mapInPandas(place, schema)
    out = placed.unionByName(base.where("n_tokens <= 0").select(F.lit(0).cast("bigint").alias("container_id"), "doc_id", F.lit(0).alias("part_no"), F.lit(0).cast("bigint").alias("token_start"), F.lit(0).cast("bigint").alias("n_tokens")))
    if totals["full"]:
        # Full containers follow the planned ones; each oversized document gets its own range of them.
        big = _running(rows.where("full > 0").select("doc_id", "full"), salts)
        out = out.unionByName(big.select(F.explode(F.sequence(F.lit(0), (F.col("full") - 1).cast("int"))).alias("part_no"), "doc_id", "first").select((F.lit(done.containers) + F.col("first") + F.col("part_no")).alias("container_id"), "doc_id", "part_no", (F.col("part_no").cast("bigint") * capacity).alias("token_start"), F.lit(capacity).cast("bigint").alias("n_tokens")))
    return out


def _running(big: DataFrame, salts: int) -> DataFrame:
    """doc_id, full, first: `first` is the running sum of `full` before the row, over salted groups."""
    s = big.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(max(salts, 16))).cast("int"))
    sums = s.groupBy("salt").agg(F.sum("full").alias("n"))
    before = sums.select("salt", (F.sum("n").over(Window.orderBy("salt")) - F.col("n")).alias("base"))  # at most most_salts rows
    w = Window.partitionBy("salt").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return s.join(F.broadcast(before), "salt").select("doc_id", "full", (F.col("base") + F.coalesce(F.sum("full").over(w), F.lit(0))).alias("first"))


def pack_windows(docs: DataFrame, windows: DataFrame, doc_id: str, text: str, params: PackParams = PackParams()) -> DataFrame:
    """`pack` for every context window: window_name first. Texts are tokenised once for all windows (a fixed, small table)."""
    sizes = cut_lineage(token_counts(docs, doc_id, text, params))
    out: DataFrame | None = None
    for w in windows.orderBy("window_name").collect():
        part = pack(sizes, w["capacity_tokens"], params).select(F.lit(w["window_name"]).alias("window_name"), "*")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = pack(sizes.limit(0), 1, params).select(F.lit("").alias("window_name"), "*")
    return out


def utilisation(packed: DataFrame, windows: DataFrame) -> DataFrame:
    """Per window: containers, tokens, capacity used as a share, and documents placed."""
    per = packed.where("n_tokens > 0").groupBy("window_name").agg(F.countDistinct("container_id").alias("containers"), F.sum("n_tokens").alias("tokens"), F.sum(F.when(F.col("part_no") == 0, 1).otherwise(0)).alias("documents"))
    return per.join(F.broadcast(windows), "window_name").select("window_name", "containers", "tokens", "documents", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("used"))
