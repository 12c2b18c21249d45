"""Full-text and vector ranking, fused by reciprocal ranks, then grouped into results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fulltext import tokens
from ..session import cut_lineage

#: Column weights of the full-text index and the constants of its ranking.
WEIGHTS = {"content": 10.0, "title": 1.0, "url": 5.0, "path": 1.0}
K1, B = 1.2, 0.75
#: Fixed value: the constant of reciprocal rank fusion.
RRF = 60


def weighted(terms: Column, weight: float) -> Column:
    return F.transform(terms, lambda x: F.struct(x.alias("t"), F.lit(float(weight)).alias("w")))


def occurrences(docs: DataFrame, key: str, weights: dict[str, float], terms: DataFrame | None = None, by: Callable[[Column], Column] = tokens) -> DataFrame:
    """(key, term, w): one row for each occurrence in the weighted fields of a row; `by` cuts a field into terms.

    With `terms` (term) only those are kept, before anything is shuffled, so texts stay where they are. Re-delivered rows of a key count once: an occurrence is
    told by its key and position.
    """
    all_terms = F.concat(*[weighted(F.coalesce(by(F.col(c)), F.array().cast("array<string>")), w) for c, w in weights.items()])
    rows = docs.select(key, F.posexplode(all_terms).alias("pos", "x")).select(key, "pos", F.col("x.t").alias("term"), F.col("x.w").alias("w"))
    return (rows if terms is None else rows.join(terms, "term", "left_semi")).dropDuplicates([key, "pos"]).select(key, "term", "w")


def lengths(docs: DataFrame, key: str, fields: list[str], by: Callable[[Column], Column] = tokens) -> DataFrame:
    """(key, len): terms of a row over its fields, one row a key."""
    total = sum((F.coalesce(F.size(by(F.col(c))), F.lit(0)) for c in fields[1:]), F.coalesce(F.size(by(F.col(fields[0]))), F.lit(0)))
    return docs.select(key, total.alias("len")).dropDuplicates([key])


def bm25(found: DataFrame, sizes: DataFrame, queries: DataFrame, key: str, k: int | None = 20) -> DataFrame:
    """(query_id, key, score): BM25 of rows for queries (query_id, term: one row a distinct query term), the k best of each.

    `found` are the `occurrences` of at least all query terms, `sizes` the `lengths` of all rows, which the statistics are over. A row
    matches if it holds any term. idf below zero counts as 1e-6. Ties go to the smaller key.
    """
    tf = found.join(queries.select("term").distinct(), "term", "left_semi").groupBy(key, "term").agg(F.sum("w").alias("f")).join(sizes, key)
    stats = sizes.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.crossJoin(F.broadcast(stats)).select(  # one row of statistics
        "term", "avg_len", F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6)).alias("idf")
    )
    part = F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    scored = tf.join(idf, "term").select(key, "term", part.alias("s")).join(queries.select("query_id", "term"), "term").groupBy("query_id", key).agg(F.round(F.sum("s"), 9).alias("score"))
    return scored if k is None else top(scored, "score", k, key)


def top(scored: DataFrame, by: str, k: int, key: str, ascending: bool = False) -> DataFrame:
    """The k best of each query_id; the limit runs before the shuffle."""
    order = F.asc(by) if ascending else F.desc(by)
    w = Window.partitionBy("query_id").orderBy(order, key)
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).drop("place")


def knn(rows: DataFrame, queries: DataFrame, key: str, k: int, group: str | None = None, block: int = 2048, sent_queries: int = 32_768) -> DataFrame:
    """(query_id, key, distance): the k nearest rows by L2 distance for each query vector, exact.

    rows: key, e (array<double>) and `group`; queries: query_id, e and `group` (only rows of the same group compete then). One scan of the rows serves
    `sent_queries` query vectors; they are met in blocks of `block`, so a matrix is bounded, and a partition keeps its k best of each query before anything is
    shuffled. Vectors of another length than the query's never match. Ties go to the smaller key.
    """
    spark = rows.sparkSession
    kind, qkind = dict(rows.dtypes)[key], dict(queries.dtypes)["query_id"]
    columns = ["query_id", "e"] + ([group] if group else [])
    ranked = cut_lineage(queries.select(*columns).withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(1_000_000))))
    parts = max(1, -(-ranked.count() // sent_queries))
    out: DataFrame | None = None
    for b in range(parts):
        mine = ranked.where(F.col("part") % parts == b).drop("part").toPandas()  # about `sent_queries` vectors
        if not len(mine):
            continue
        sent = spark.sparkContext.broadcast((mine["query_id"].to_numpy(), np.array(mine["e"].tolist(), np.float64), mine[group].to_numpy() if group else None))

        def near(it: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            ids, q, g = sent.value
            q2 = (q * q).sum(axis=1)
            held: list[tuple[np.ndarray, ...]] = []
            for pdf in it:
                pdf = pdf[pdf["e"].map(len) == q.shape[1]]
                if not len(pdf):
                    continue
                for value in np.unique(pdf[group].to_numpy()) if group else [None]:
                    own = pdf if group is None else pdf[pdf[group] == value]
                    at = np.arange(len(ids)) if group is None else np.nonzero(g == value)[0]
                    x, names = np.array(own["e"].tolist(), np.float64), own[key].to_numpy()
                    x2 = (x * x).sum(axis=1)
                    for lo in range(0, len(at), block):
                        some = at[lo : lo + block]
                        d2 = q2[some][:, None] + x2[None, :] - 2 * q[some] @ x.T
                        m = min(k + 8, d2.shape[1])  # some more than k: rounding may reorder near ties, which exact distances settle
                        best = np.argpartition(d2, m - 1, axis=1)[:, :m].ravel()
                        row = np.repeat(some, m)
                        exact = np.concatenate([np.sqrt(((q[row[i : i + 65_536]] - x[best[i : i + 65_536]]) ** 2).sum(axis=1)) for i in range(0, len(row), 65_536)])
                        held.append((row, names[best], np.round(exact, 9)))
                if sum(len(h[0]) for h in held) > 8 * k * len(ids):
                    held = [_least(held, k)]
            if held:
                row, names, far = _least(held, k)
                yield pd.DataFrame({"query_id": ids[row], key: names, "distance": far})

        part = rows.mapInPandas(near, f"query_id {qkind}, {key} {kind}, distance double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"query_id {qkind}, {key} {kind}, distance double")
    return top(out, "distance", k, key, ascending=True)


def _least(held: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """The k entries of each query with the least distance, ties by the smaller key."""
    row, names, far = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((names, far, row))
    row, names, far = row[order], names[order], far[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], names[kept], far[kept]


def ranked(arm: DataFrame, by: str, key: str, name: str, ascending: bool = False) -> DataFrame:
    order = F.asc(by) if ascending else F.desc(by)
    return arm.select("query_id", key, F.row_number().over(Window.partitionBy("query_id").orderBy(order, key)).alias(name))


def fuse(text: DataFrame, vector: DataFrame, key: str, k: int | None = 10, text_weight: float = 1.0, vector_weight: float = 1.0) -> DataFrame:
    """(query_id, key, text_rank, vector_rank, score): reciprocal rank fusion of two ranked arms; a row missing from an arm gets nothing for it."""
    both = ranked(text, "score", key, "text_rank").join(ranked(vector, "distance", key, "vector_rank", ascending=True), ["query_id", key], "full_outer")
    part = lambda w, r: F.coalesce(F.lit(float(w)) / (F.lit(float(RRF)) + F.col(r)), F.lit(0.0))
    scored = both.withColumn("score", F.round(part(text_weight, "text_rank") + part(vector_weight, "vector_rank"), 12))
    return scored if k is None else top(scored, "score", k, key)


def cluster_hits(hits: DataFrame, most_gap: int = 3) -> DataFrame:
    """`hits` (query_id, url, sort_order, ...) with `cluster`: a new one within a query's URL where sort_order jumps by more than `most_gap`."""
    w = Window.partitionBy("query_id", "url").orderBy("sort_order", "id")
    jump = (F.col("sort_order") - F.lag("sort_order").over(w) > most_gap).cast("int")
    return hits.withColumn("cluster", F.sum(F.coalesce(jump, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def group_results(hits: DataFrame) -> DataFrame:
    """One result a cluster: its best score, its first chunk's type, its chunks in order."""
    return hits.groupBy("query_id", "url", "cluster").agg(
        F.max("score").alias("score"),
        F.min_by("content_type", F.struct(-F.col("score"), "id")).alias("content_type"),
        F.transform(F.sort_array(F.collect_list(F.struct("sort_order", "id"))), lambda x: x["id"]).alias("ids"),
    )
