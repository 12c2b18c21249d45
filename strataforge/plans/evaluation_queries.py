"""Retrieval metrics over the stored hits: vector ranks against grades from full-text scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import evaluation
from . import tables
from .catalogue import HITS_SQL, query

URL_SQL = "regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', ''), '\\.(md|html)$', '')"
METRICS_SQL = f"""with h as (select query_id, hit_id, {URL_SQL} as u, vec_score, fts_score from {HITS_SQL} where url is not null),
r as (select query_id, u, min(rk) as rank from (select *, row_number() over (partition by query_id order by vec_score desc, hit_id) as rk from h where vec_score is not null) group by all),
g as (select query_id, u, max(case when fts_score >= 4 then 3 when fts_score >= 2 then 2 when fts_score >= 1 then 1 else 0 end) as grade from h where fts_score is not null group by all having grade > 0),
i as (select *, row_number() over (partition by query_id order by grade desc, u) as n from g),
w as (select query_id, count(*) as relevant, sum(case when n <= 5 then (pow(2, grade) - 1) / log2(n + 1) else 0 end) as i5, sum(case when n <= 10 then (pow(2, grade) - 1) / log2(n + 1) else 0 end) as i10 from i group by 1),
f as (select query_id, min(rank) as first, count(*) filter (rank <= 3) as f3, count(*) filter (rank <= 5) as f5, count(*) filter (rank <= 10) as f10,
sum(case when rank <= 5 then (pow(2, grade) - 1) / log2(rank + 1) else 0 end) as d5, sum(case when rank <= 10 then (pow(2, grade) - 1) / log2(rank + 1) else 0 end) as d10 from r join g using (query_id, u) group by 1),
m as (select query_id, round(coalesce(1.0::double / first, 0), 9) as mrr, round(coalesce(f3::double / relevant, 0), 9) as recall_3, round(coalesce(f5::double / relevant, 0), 9) as recall_5, round(coalesce(f10::double / relevant, 0), 9) as recall_10,
round(coalesce(d5 / i5, 0), 9) as ndcg_5, round(coalesce(d10 / i10, 0), 9) as ndcg_10, coalesce(first <= 1, false)::bigint as hit_1, coalesce(first <= 3, false)::bigint as hit_3, coalesce(first <= 5, false)::bigint as hit_5 from w left join f using (query_id))"""


def per_query(spark: SparkSession, d: str) -> DataFrame:
    h = tables.hits(spark, d).where("url is not null").withColumn("u", evaluation.evaluation_url(F.col("url")))
    w = Window.partitionBy("query_id").orderBy(F.desc("vec_score"), "hit_id")
    ranked = h.where("vec_score is not null").select("query_id", F.col("u").alias("url"), F.row_number().over(w).alias("rank"))
    grade = F.when(F.col("fts_score") >= 4, 3).when(F.col("fts_score") >= 2, 2).when(F.col("fts_score") >= 1, 1).otherwise(0)
    judged = h.where("fts_score is not null").select("query_id", F.col("u").alias("url"), grade.alias("grade"))
    return evaluation.metrics_per_query(ranked, judged)


@query(f"{METRICS_SQL} select * from m")
def ir_metrics_per_query(spark: SparkSession, d: str) -> DataFrame:
    return per_query(spark, d)


MEANS = "round(avg(mrr), 6) as mrr, round(avg(recall_5), 6) as recall_5, round(avg(ndcg_10), 6) as ndcg_10, round(avg(hit_3), 6) as hit_3, count(*) as n"


def means() -> list:
    return [*[F.round(F.avg(c), 6).alias(c) for c in ("mrr", "recall_5", "ndcg_10", "hit_3")], F.count("*").alias("n")]


@query(f"{METRICS_SQL} select query_id % 4 as intent, {MEANS} from m group by 1")
def ir_metrics_by_intent(spark: SparkSession, d: str) -> DataFrame:
    return per_query(spark, d).groupBy((F.col("query_id") % 4).alias("intent")).agg(*means())


@query(f"""{METRICS_SQL}, a as (select query_id % 4 as intent, avg(mrr) as mrr from m group by 1), b as (select avg(mrr) as base from m)
select intent, case when (mrr - base) / abs(base) < -0.1 then 'regressed' when (mrr - base) / abs(base) > 0.1 then 'improved' else 'steady' end as verdict from a, b where base <> 0""")
def regression_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Each intent against the mean of all queries, by the tolerance for intents."""
    m = per_query(spark, d)
    base = m.agg(F.avg("mrr").alias("base")).where("base <> 0")
    by = m.groupBy((F.col("query_id") % 4).alias("intent")).agg(F.avg("mrr").alias("mrr"))
    return by.join(F.broadcast(base), F.lit(True)).select("intent", evaluation.regression(F.col("mrr"), F.col("base"), evaluation.PER_INTENT).alias("verdict"))  # one row of base


@query(f"select query_id, query_text from (select distinct query_id, query_text from {HITS_SQL}) where query_text is not null order by sha256(query_id::varchar || '::' || query_text), query_id, query_text limit 20")
def sampled_queries(spark: SparkSession, d: str) -> DataFrame:
    q = tables.hits(spark, d).select("query_id", "query_text").where("query_text is not null").distinct()
    return evaluation.deterministic_sample(q, ["query_id", "query_text"], 20)


@query(f"select library_id, n, n > 0.5 * sum(n) over () as too_many from (select coalesce(v.library_id, -1) as library_id, count(*) as n from {HITS_SQL} h left join (select distinct on (id) * from doc_pages) p on h.page_id = p.id left join versions v on p.version_id = v.id group by 1)")
def query_balance(spark: SparkSession, d: str) -> DataFrame:
    p = tables.pages(spark, d).select(F.col("id").alias("page_id"), "version_id")
    v = tables.versions(spark, d).select(F.col("id").alias("version_id"), "library_id")
    g = tables.hits(spark, d).select("page_id").join(p, "page_id", "left").join(v, "version_id", "left").groupBy(F.coalesce("library_id", F.lit(-1)).alias("library_id")).agg(F.count("*").alias("n"))
    total = g.agg(F.sum("n").alias("t"))
    return g.join(F.broadcast(total), F.lit(True)).select("library_id", "n", (F.col("n") > F.col("t") * 0.5).alias("too_many"))  # one row of total


@query(f"select query_id, round(avg(abs(vec_score - fts_score / 10)) + 1e-9, 5) as gap, count(*) as n from {HITS_SQL} where vec_score is not null and fts_score is not null group by query_id")
def score_agreement(spark: SparkSession, d: str) -> DataFrame:
    h = tables.hits(spark, d).where("vec_score is not null and fts_score is not null")
    return h.groupBy("query_id").agg(F.round(F.avg(F.abs(F.col("vec_score") - F.col("fts_score") / 10)) + 1e-9, 5).alias("gap"), F.count("*").alias("n"))
