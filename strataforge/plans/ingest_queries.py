"""Merges, refreshes and crawls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge
from ..session import table
from ..sources import crawl as crawler
from . import tables
from .catalogue import CHUNKS_SQL, PAGES_SQL, SCRAPES_SQL, USABLE_SQL, query
from .url_queries import links

# The last fetch of each page counts as its answer: no text is "not modified", an error list or an empty text is "gone".
LAST_SQL = f"(select * from (select *, row_number() over (partition by page_id order by fetched_at desc, result_id desc) as n from {SCRAPES_SQL}) where n = 1)"
STATUS_SQL = "case when text_content is null then 304 when trim(text_content) = '' then 404 else 200 end"


def last_fetch(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "scrape_results").select("result_id", "page_id", "fetched_at", "etag", F.when(F.col("text_content").isNull(), 304).when(F.expr("trim(text_content)") == "", 404).otherwise(200).alias("status"))
    g = s.groupBy("page_id").agg(F.max_by(F.struct("etag", "status", "result_id"), F.struct("fetched_at", "result_id")).alias("x"))
    return g.select("page_id", "x.etag", "x.status", "x.result_id")


@query(f"""
select coalesce(p.id, s.page_id) as page_id, case when p.id is not null and s.page_id is null then 'kept' when p.id is not null and status = 304 then 'kept'
when p.id is not null and status = 200 and p.etag = s.etag then 'kept' when p.id is not null and status = 200 then 'replaced' when p.id is not null then 'deleted' when status = 200 then 'inserted' else 'ignored' end as change
from {PAGES_SQL} p full outer join (select page_id, etag, {STATUS_SQL} as status from {LAST_SQL}) s on p.id = s.page_id""")
def refresh_changes(spark: SparkSession, d: str) -> DataFrame:
    return merge.refresh_changes(tables.pages(spark, d).select(F.col("id").alias("page_id"), "etag"), last_fetch(spark, d), ["page_id"])


@query(f"""
select p.id as page_id, coalesce(nullif(s.etag, ''), p.etag) as etag from {PAGES_SQL} p left join {LAST_SQL} s on p.id = s.page_id""")
def upserted_tags(spark: SparkSession, d: str) -> DataFrame:
    old = tables.pages(spark, d).select(F.col("id").alias("page_id"), "etag")
    new = last_fetch(spark, d).where("etag is not null and etag <> ''").select("page_id", "etag").join(old.select("page_id"), "page_id", "left_semi")
    return merge.upsert(old, new, ["page_id"])


@query(f"select version_id, count(*) as pages from {PAGES_SQL} where version_id not in (select id from versions where coalesce(name, '') = '') group by version_id")
def without_deleted_versions(spark: SparkSession, d: str) -> DataFrame:
    gone = tables.versions(spark, d).where(F.coalesce("name", F.lit("")) == "").select(F.col("id").alias("version_id"))
    return merge.delete(tables.pages(spark, d).select("id", "version_id"), gone, ["version_id"]).groupBy("version_id").agg(F.count("*").alias("pages"))


@query(f"select id from {CHUNKS_SQL} where id not in (select chunk_id from {USABLE_SQL})")
def chunks_without_vector(spark: SparkSession, d: str) -> DataFrame:
    have = tables.vectors(spark, d).select(F.col("chunk_id").alias("id"))
    return tables.chunks(spark, d, "page_id").select("id").join(have, "id", "left_anti")


@query(f"select chunk_id, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 5) as norm, 96::bigint as dims from {USABLE_SQL}")
def padded_vectors(spark: SparkSession, d: str) -> DataFrame:
    padded = F.concat("e", F.array_repeat(F.lit(0.0), 32))
    v = tables.vectors(spark, d).select("chunk_id", padded.alias("p"))
    return v.select("chunk_id", F.round(F.sqrt(F.aggregate("p", F.lit(0.0), lambda s, x: s + x * x)), 5).alias("norm"), F.size("p").cast("bigint").alias("dims"))


CRAWL_SQL = f"""with recursive e as (select distinct url, unnest(links) as link from {SCRAPES_SQL}), s as (select distinct url from {SCRAPES_SQL} where page_id in (select id from {PAGES_SQL} where depth = 0)),
r(url, depth) as (select url, 0 from s union select e.link, r.depth + 1 from r join e on r.url = e.url where r.depth < 3 and e.link is not null)
select url, min(depth)::int as depth from r group by url"""


@query(CRAWL_SQL)
def crawl_levels(spark: SparkSession, d: str) -> DataFrame:
    roots = tables.pages(spark, d).where("depth = 0").select(F.col("id").alias("page_id"))
    seeds = tables.scrapes(spark, d).select("page_id", "url").join(roots, "page_id", "left_semi").select("url")
    return crawler.crawl(seeds, links(spark, d), 3)


@query(f"""
select p.version_id, count(*) filter (p.depth > 0) as done, count(*) filter (p.depth > 0 and len(s.errors) > 0) as failed,
coalesce(bool_or(p.depth = 0 and len(s.errors) > 0), false) or (count(*) filter (p.depth > 0) >= 10 and count(*) filter (p.depth > 0 and len(s.errors) > 0) > count(*) filter (p.depth > 0) * 0.5) as abort
from {SCRAPES_SQL} s join {PAGES_SQL} p on s.page_id = p.id where p.depth is not null group by p.version_id""")
def crawl_failure_rates(spark: SparkSession, d: str) -> DataFrame:
    s = tables.scrapes(spark, d).select("page_id", (F.coalesce(F.size("errors"), F.lit(0)) > 0).alias("failed"))
    p = tables.pages(spark, d).where("depth is not null").select(F.col("id").alias("page_id"), "version_id", "depth")
    return crawler.failure_rate(s.join(p, "page_id").withColumn("refreshed", F.lit(False)), "version_id")


@query(f"select version_id, count(*) as queued, min(coalesce(depth, 0)) as first_depth, count(etag) as with_tag from {PAGES_SQL} group by version_id")
def refresh_queue(spark: SparkSession, d: str) -> DataFrame:
    return tables.pages(spark, d).groupBy("version_id").agg(F.count("*").alias("queued"), F.min(F.coalesce("depth", F.lit(0))).alias("first_depth"), F.count("etag").alias("with_tag"))


