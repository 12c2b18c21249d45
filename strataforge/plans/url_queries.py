"""URL identity, scope and admission, and media types, over pages and scraped links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..sources.web import source_kind
from . import tables
from .catalogue import HITS_SQL, PAGES_SQL, SCRAPES_SQL, query

U = "'^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\\?[^#]*)?(#.*)?$'"


def sql_part(url: str, i: int) -> str:
    return f"regexp_extract({url}, {U}, {i})"


def sql_host(u: str) -> str:
    h = f"regexp_replace(lower({sql_part(u, 2)}), '^.*@', '')"
    return f"regexp_replace(case lower({sql_part(u, 1)}) when 'https' then regexp_replace({h}, ':443$', '') when 'http' then regexp_replace({h}, ':80$', '') else {h} end, '\\.(:\\d+)?$', '\\1')"


def sql_path(u: str) -> str:
    return f"(case when {sql_part(u, 3)} = '' then '/' else {sql_part(u, 3)} end)"


def sql_normal(u: str) -> str:
    p = f"regexp_replace(regexp_replace({sql_path(u)}, '(?i)/index\\.(html|htm|asp|php|jsp)$', '/'), '/+$', '')"
    q = f"case when {sql_part(u, 4)} = '?' then '' else {sql_part(u, 4)} end"
    return f"(case when regexp_matches({u}, {U}) then lower(lower({sql_part(u, 1)}) || '://' || {sql_host(u)} || case when {p} = '' then '/' else {p} end || {q}) else {u} end)"


@query(f"select id, {sql_normal('url')} as normal from {PAGES_SQL}")
def normalize_url(spark: SparkSession, d: str) -> DataFrame:
    return tables.pages(spark, d).select("id", urls.normalize(F.col("url")).alias("normal"))


def _dir(p: str) -> str:
    return f"case when {p} in ('', '/') then '/' when {p} like '%/' then {p} when regexp_matches(regexp_extract({p}, '([^/]*)$', 1), '(?i)^index(\\.[a-z0-9]+)?$') then regexp_replace({p}, '/[^/]*$', '/') else {p} || '/' end"


SAME = f"lower({sql_part('v.source_url', 1)}) = lower({sql_part('p.url', 1)})"
DOMAIN = lambda u: f"regexp_extract(regexp_replace({sql_host(u)}, ':\\d+$', ''), '([^.]+\\.[^.]+)$', 1)"


@query(f"""
select p.id, {SAME} and {sql_host('v.source_url')} = {sql_host('p.url')} and starts_with({sql_path('p.url')}, {_dir(sql_path('v.source_url'))}) as subpages,
{SAME} and {sql_host('v.source_url')} = {sql_host('p.url')} as hostname, {SAME} and {DOMAIN('v.source_url')} = {DOMAIN('p.url')} as domain
from {PAGES_SQL} p join versions v on p.version_id = v.id""")
def crawl_scopes(spark: SparkSession, d: str) -> DataFrame:
    v = tables.versions(spark, d).select(F.col("id").alias("version_id"), "source_url")
    j = tables.pages(spark, d).select("id", "version_id", "url").join(v, "version_id")
    return j.select("id", *[urls.in_scope(F.col("source_url"), F.col("url"), s).alias(s) for s in ("subpages", "hostname", "domain")])


LINKS_SQL = f"(select result_id, url, unnest(links) as link, generate_subscripts(links, 1) as pos from {SCRAPES_SQL} where links is not null)"


def links(spark: SparkSession, d: str) -> DataFrame:
    s = tables.scrapes(spark, d).select("result_id", "url", "links")
    return s.select("result_id", "url", F.posexplode("links").alias("pos", "link"))


@query(f"select link, count(*) as mentions, count(distinct result_id) as pages from {LINKS_SQL} where link is not null group by link")
def link_degree(spark: SparkSession, d: str) -> DataFrame:
    return links(spark, d).where("link is not null").groupBy("link").agg(F.count("*").alias("mentions"), F.countDistinct("result_id").alias("pages"))


@query(f"""
select distinct {sql_normal('link')} as target from {LINKS_SQL} where link is not null and not regexp_matches(link, '/(faq|blog)(/|$)') and regexp_matches(regexp_replace({sql_path('link')} || {sql_part('link', 4)}, '^/', ''), '^.*/(guide|reference|api)/.*$')""")
def admitted_links(spark: SparkSession, d: str) -> DataFrame:
    l = links(spark, d).where("link is not null").select("link")
    keep = urls.admitted(F.col("link"), includes=["*/**/guide/**", "*/guide/**", "*/reference/**", "*/api/**", "*/**/reference/**", "*/**/api/**"], excludes=["/\\/(faq|blog)(\\/|$)/"])
    return l.where(keep).select(urls.normalize(F.col("link")).alias("target")).distinct()


@query()
def default_admission(spark: SparkSession, d: str) -> DataFrame:
    return tables.pages(spark, d).select("id", urls.admitted(F.col("url")).alias("kept"))


@query(f"select version_id, {sql_normal('url')} as normal, arg_min(id, (depth is null, depth, id)) as id, count(*) as spellings from {PAGES_SQL} group by 1, 2")
def first_page_of_identity(spark: SparkSession, d: str) -> DataFrame:
    g = tables.pages(spark, d).groupBy("version_id", urls.normalize(F.col("url")).alias("normal"))
    return g.agg(F.min_by("id", F.struct(F.col("depth").isNull(), "depth", "id")).alias("id"), F.count("*").alias("spellings"))


EXT = "regexp_extract(lower(regexp_replace(url, '[?#].*$', '')), '\\.([^./]+)$', 1)"


@query(f"select id, case {EXT} when 'html' then 'text/html' when 'htm' then 'text/html' when 'md' then 'text/markdown' when 'json' then 'application/json' when 'txt' then 'text/plain' when 'py' then 'text/x-python' when 'ts' then 'text/x-typescript' end as mime from {PAGES_SQL} where {EXT} not in ('test', 'example')")
def mime_from_extension(spark: SparkSession, d: str) -> DataFrame:
    p = tables.pages(spark, d)
    return p.where(~urls.extension(F.col("url")).isin("test", "example")).select("id", urls.mime_from_path(F.col("url")).alias("mime"))


HEADER = "source_content_type"


@query(f"""
select id, case when coalesce({HEADER}, '') = '' then 'application/octet-stream' else lower(trim(regexp_extract({HEADER}, '^([^;]*)', 1))) end as mime,
nullif(lower(trim(regexp_extract(coalesce({HEADER}, ''), '(?i);\\s*charset=([^;]*)', 1))), '') as charset from {PAGES_SQL}""")
def parsed_content_types(spark: SparkSession, d: str) -> DataFrame:
    mime, charset = urls.content_type(F.col("source_content_type"))
    return tables.pages(spark, d).select("id", mime.alias("mime"), charset.alias("charset"))


@query()
def pipeline_routes(spark: SparkSession, d: str) -> DataFrame:
    mime, _ = urls.content_type(F.col("source_content_type"))
    return tables.pages(spark, d).groupBy(urls.pipeline(mime).alias("pipeline")).agg(F.count("*").alias("n"))


@query(f"""
select query_id, hit_id, row_number() over (partition by query_id, {sql_normal('url')} order by hit_id) = 1 as first from {HITS_SQL} where url is not null""")
def first_hit_of_page(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("query_id", urls.normalize(F.col("url"))).orderBy("hit_id")
    return tables.hits(spark, d).where("url is not null").select("query_id", "hit_id", (F.row_number().over(w) == 1).alias("first"))


@query("select id, case when regexp_matches(lower(source_url), '^https?://(www\\.)?github\\.com(/|$)') then 'repository' when regexp_matches(lower(source_url), '^https?://') then 'web' when source_url like 'file:%' then 'file' end as kind from versions")
def source_kinds(spark: SparkSession, d: str) -> DataFrame:
    return tables.versions(spark, d).select("id", source_kind(F.col("source_url")).alias("kind"))
