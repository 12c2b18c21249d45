"""Catalog queries over libraries, versions, pages and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.versions import best_versions, version_key, version_parts
from ..operators import catalog
from . import tables
from .catalogue import CHUNKS_SQL, PAGES_SQL, query

NAME = "lower(regexp_replace(name, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g'))"
ROLLUP_SQL = f"""
select l.library, v.id as version_id, coalesce({NAME.replace("name", "v.name")}, '') as version, count(c.id) as documents, count(distinct p.url) as urls
from versions v join (select id, {NAME} as library from libraries) l on v.library_id = l.id
left join {PAGES_SQL} p on p.version_id = v.id left join {CHUNKS_SQL} c on c.page_id = p.id group by all"""


def _rollup(spark: SparkSession, d: str) -> DataFrame:
    return catalog.version_rollup(tables.libraries(spark, d), tables.versions(spark, d), tables.pages(spark, d).select("id", "version_id", "url", "created_at"), tables.chunks(spark, d, "page_id"))


@query(ROLLUP_SQL)
def library_version_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _rollup(spark, d).drop("first_at")


@query(f"select library, count(*) as n_versions, sum(documents)::bigint as documents, sum(urls)::bigint as urls from ({ROLLUP_SQL}) group by library")
def library_nested_summary(spark: SparkSession, d: str) -> DataFrame:
    nested = catalog.nested_summary(_rollup(spark, d))
    total = lambda f: F.aggregate("versions", F.lit(0).cast("bigint"), lambda s, x: s + x[f])
    return nested.select("library", F.size("versions").cast("bigint").alias("n_versions"), total("documents").alias("documents"), total("urls").alias("urls"))


@query(f"select sum(documents)::bigint as documents, sum(urls)::bigint as urls, count(*) as n_versions, count(distinct library) as n_libraries from ({ROLLUP_SQL})")
def catalog_totals(spark: SparkSession, d: str) -> DataFrame:
    return _rollup(spark, d).agg(F.sum("documents").alias("documents"), F.sum("urls").alias("urls"), F.count("*").alias("n_versions"), F.countDistinct("library").alias("n_libraries"))


@query("select distinct library_id, coalesce(name, '') as version from versions")
def distinct_versions(spark: SparkSession, d: str) -> DataFrame:
    return tables.versions(spark, d).select("library_id", F.coalesce("name", F.lit("")).alias("version")).distinct()


@query(f"""
select library_id, arg_max(id, (n, -id)) as version_id from (select v.library_id, v.id, count(c.id) as n from versions v left join {PAGES_SQL} p on p.version_id = v.id
left join {CHUNKS_SQL} c on c.page_id = p.id where coalesce({NAME.replace("name", "v.name")}, '') = '' group by all) group by library_id""")
def canonical_unversioned(spark: SparkSession, d: str) -> DataFrame:
    return catalog.canonical_unversioned(tables.versions(spark, d), _rollup(spark, d).select("version_id", "documents"))


VERSION_RE = "^[v=\\s]*\\d+\\.\\d+\\.\\d+(-[0-9A-Za-z.-]+)?(\\+[0-9A-Za-z.-]+)?$"


@query(f"""
select id, row_number() over (partition by library_id order by k, a desc, b desc, c desc, pre, name, id) as place from (
select id, library_id, coalesce(name, '') as name, case when coalesce(name, '') = '' then 0 when regexp_matches(name, '{VERSION_RE}') then 1 else 2 end as k,
case when regexp_matches(name, '{VERSION_RE}') and contains(name, '-') then 1 else 0 end as pre,
coalesce(try_cast(case when regexp_matches(name, '{VERSION_RE}') then regexp_extract(name, '^[v=\\s]*(\\d+)\\.(\\d+)\\.(\\d+)', 1) end as bigint), 0) as a,
coalesce(try_cast(case when regexp_matches(name, '{VERSION_RE}') then regexp_extract(name, '^[v=\\s]*(\\d+)\\.(\\d+)\\.(\\d+)', 2) end as bigint), 0) as b,
coalesce(try_cast(case when regexp_matches(name, '{VERSION_RE}') then regexp_extract(name, '^[v=\\s]*(\\d+)\\.(\\d+)\\.(\\d+)', 3) end as bigint), 0) as c from versions)""")
def version_order(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("library_id").orderBy(*version_key("name"), F.coalesce("name", F.lit("")), "id")
    return tables.versions(spark, d).select("id", F.row_number().over(w).cast("bigint").alias("place"))


@query(f"""
select library_id, max(a * 1000000000000 + b * 1000000 + c) as best_number from (select library_id, regexp_extract(name, '(\\d+)\\.(\\d+)\\.(\\d+)', 1)::bigint as a,
regexp_extract(name, '(\\d+)\\.(\\d+)\\.(\\d+)', 2)::bigint as b, regexp_extract(name, '(\\d+)\\.(\\d+)\\.(\\d+)', 3)::bigint as c from versions
where regexp_matches(name, '{VERSION_RE}') and not contains(name, '-')) group by library_id""")
def latest_stable_version(spark: SparkSession, d: str) -> DataFrame:
    b = best_versions(tables.versions(spark, d).select("library_id", "name"), None).where("best is not null")
    x, y, z = version_parts("best")
    return b.select("library_id", (x * 1_000_000_000_000 + y * 1_000_000 + z).alias("best_number"))


@query()
def best_version_for_targets(spark: SparkSession, d: str) -> DataFrame:
    v = tables.versions(spark, d).select("library_id", "name")
    out = None
    for t in ("latest", "1", "2.x", "3.4", "4.0.0"):
        part = best_versions(v, t).withColumn("target", F.lit(t))
        out = part if out is None else out.unionByName(part)
    return out


@query("""
with n as (select distinct lower(trim(name)) as name from libraries), a as (select distinct left(name, len(name) - 1) || 'x' as asked from n)
select asked, place, name from (select asked, name, row_number() over (partition by asked order by levenshtein(asked, name), name) as place from a join n
on levenshtein(asked, name) <= greatest(len(asked), len(name)) * 0.7) where place <= 3""")
def did_you_mean(spark: SparkSession, d: str) -> DataFrame:
    names = tables.libraries(spark, d).select(F.lower(F.trim("name")).alias("name")).distinct()
    asked = names.select(F.concat(F.expr("left(name, length(name) - 1)"), F.lit("x")).alias("asked"))
    return catalog.did_you_mean(asked, names).withColumn("place", F.col("place").cast("bigint"))


@query("select source_url, id as version_id, row_number() over (partition by source_url order by created_at desc, id desc) as place from versions where source_url is not null")
def versions_by_source_url(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("source_url").orderBy(F.desc("created_at"), F.desc("id"))
    return tables.versions(spark, d).where("source_url is not null").select("source_url", F.col("id").alias("version_id"), F.row_number().over(w).cast("bigint").alias("place"))


@query("""
select id, scraper_options->>'$.scope' as scope, try_cast(scraper_options->>'$.maxPages' as bigint) as max_pages, try_cast(scraper_options->>'$.maxDepth' as bigint) as max_depth from versions""")
def stored_options(spark: SparkSession, d: str) -> DataFrame:
    o = F.from_json("scraper_options", "scope string, maxPages bigint, maxDepth bigint")
    return tables.versions(spark, d).select("id", o.scope.alias("scope"), o.maxPages.alias("max_pages"), o.maxDepth.alias("max_depth"))


@query(f"""
select c.id, p.url, l.name as library, coalesce(v.name, '') as version, c.level, c.sort_order from {CHUNKS_SQL} c join {PAGES_SQL} p on c.page_id = p.id
join versions v on p.version_id = v.id join libraries l on v.library_id = l.id""")
def chunk_page_version_library(spark: SparkSession, d: str) -> DataFrame:
    c, p = tables.chunks(spark, d, "page_id", "level", "sort_order"), tables.pages(spark, d).select(F.col("id").alias("page_id"), "version_id", "url")
    v = tables.versions(spark, d).select(F.col("id").alias("version_id"), F.coalesce("name", F.lit("")).alias("version"), "library_id")
    n = tables.libraries(spark, d).select(F.col("id").alias("library_id"), F.col("name").alias("library"))
    # Pages and chunks meet on page_id, which is spread evenly; the dimensions are small enough to be broadcast by size.
    return c.join(p, "page_id").join(v.join(n, "library_id"), "version_id").select("id", "url", "library", "version", "level", "sort_order")


@query(f"select version_id, url, max(title) as title, max(updated_at)::varchar as updated from {PAGES_SQL} group by version_id, url")
def page_rollup(spark: SparkSession, d: str) -> DataFrame:
    g = tables.pages(spark, d).groupBy("version_id", "url").agg(F.max("title").alias("title"), F.max("updated_at").alias("u"))
    text = F.regexp_replace(F.regexp_replace(F.date_format("u", "yyyy-MM-dd HH:mm:ss.SSSSSS"), "0+$", ""), r"\.$", "")
    return g.select("version_id", "url", "title", F.concat(text, F.lit("+00")).alias("updated"))


@query("select library_id, status, count(*) as n from versions where status in ('completed', 'failed', 'updating', 'running', 'queued') group by all")
def version_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return tables.versions(spark, d).where(F.col("status").isin("completed", "failed", "updating", "running", "queued")).groupBy("library_id", "status").agg(F.count("*").alias("n"))


