"""Retrieval quality: ranked lists against graded relevance, means, regressions, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RECALL, NDCG, HIT = (3, 5, 10), (5, 10), (1, 3, 5)
#: Relative tolerances for headline metrics and for those of one intent.
HEADLINE, PER_INTENT = 0.05, 0.10


def evaluation_url(url: Column) -> Column:
    """A URL as judgements name it: without fragment, query, one last slash, then a `.md` or `.html` ending."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), "/$", ""), r"\.(md|html)$", "")


def metrics_per_query(ranked: DataFrame, judged: DataFrame) -> DataFrame:
    """query_id with mrr, recall_k, ndcg_k, hit_k. ranked: query_id, url, rank from 1; judged: query_id, url, grade (> 0 is relevant).

    A URL counts at its best rank and grade only. Queries without a relevant judgement are left out; those without results score 0.
    """
    best = ranked.groupBy("query_id", "url").agg(F.min("rank").alias("rank"))
    rel = judged.where("grade > 0").groupBy("query_id", "url").agg(F.max("grade").alias("grade"))
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "url"))
    ideal = rel.withColumn("n", place)
    discounted = lambda at, k: F.sum(F.when(F.col(at) <= k, gain / F.log2(F.col(at) + 1.0)).otherwise(0.0))
    want = ideal.groupBy("query_id").agg(F.count("*").alias("relevant"), *[discounted("n", k).alias(f"i{k}") for k in NDCG])
    got = best.join(rel, ["query_id", "url"]).groupBy("query_id").agg(
        F.min("rank").alias("first"), *[F.count_if(F.col("rank") <= k).alias(f"f{k}") for k in RECALL], *[discounted("rank", k).alias(f"d{k}") for k in NDCG]
    )
    j = want.join(got, "query_id", "left")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 9)
    return j.select(
        "query_id",
        zero(1.0 / F.col("first")).alias("mrr"),
        *[zero(F.col(f"f{k}") / F.col("relevant")).alias(f"recall_{k}") for k in RECALL],
        *[zero(F.col(f"d{k}") / F.col(f"i{k}")).alias(f"ndcg_{k}") for k in NDCG],
        *[F.coalesce((F.col("first") <= k).cast("int"), F.lit(0)).cast("bigint").alias(f"hit_{k}") for k in HIT],
    )


def regression(current: Column, base: Column, tolerance: float) -> Column:
    """'improved', 'regressed' or 'steady' by relative change; from a base of 0 any change is one."""
    delta = F.when(base == 0, F.when(current == 0, 0.0).otherwise(F.signum(current) * float("inf"))).otherwise((current - base) / F.abs(base))
    return F.when(delta < -tolerance, "regressed").when(delta > tolerance, "improved").otherwise("steady")


def deterministic_sample(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The n rows with the least SHA-256 of their joined keys."""
    return df.orderBy(F.sha2(F.concat_ws("::", *[F.col(k).cast("string") for k in keys]), 256), *keys).limit(n)
