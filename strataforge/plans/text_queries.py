"""Titles, links, chunking and structural checks over scraped texts and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking, embedding, pipeline, transform
from . import tables
from .catalogue import CHUNKS_SQL, HITS_SQL, SCRAPES_SQL, query


def texts(spark: SparkSession, d: str) -> DataFrame:
    return tables.scrapes(spark, d).select("result_id", "url", "text_content").where("text_content is not null")


@query(f"""
select result_id, case when trim(regexp_extract(text_content, '(?m)^#[ \\t]+([^\\n]+)$', 1)) <> '' then trim(regexp_extract(text_content, '(?m)^#[ \\t]+([^\\n]+)$', 1)) else 'Untitled' end as title
from {SCRAPES_SQL} where text_content is not null""")
def markdown_titles(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("result_id", transform.markdown_title(F.col("text_content")).alias("title"))


@query(f"""
select result_id, len(l) as n, l[1] as first from (select result_id, regexp_extract_all(text_content, '(?:^|[^!\\\\])\\[[^\\]]*\\]\\(([^)\\s]+)[^)]*\\)', 1) as a,
list_filter(a, lambda x, i: list_position(a, x) = i) as l from {SCRAPES_SQL} where text_content is not null)""")
def markdown_links(spark: SparkSession, d: str) -> DataFrame:
    l = texts(spark, d).select("result_id", transform.markdown_links(F.col("text_content")).alias("l"))
    return l.select("result_id", F.size("l").cast("bigint").alias("n"), F.get("l", F.lit(0)).alias("first"))


@query(f"select id, len(regexp_extract_all(content, '[`]{{3}}')) % 2 = 0 as balanced, trim(content) <> '' as filled from {CHUNKS_SQL} where content is not null")
def fence_balance(spark: SparkSession, d: str) -> DataFrame:
    c = tables.chunks(spark, d, "content").where("content is not null")
    return c.select("id", chunking.fence_balance(F.col("content")).alias("balanced"), (F.trim("content") != "").alias("filled"))


@query(f"""
select query_id, round(avg((len(regexp_extract_all(c.content, '[`]{{3}}')) % 2 = 0)::int), 6) as balanced, round(avg((trim(c.content) <> '')::int), 6) as filled, round(avg((coalesce(h.url, '') <> '')::int), 6) as with_url
from {HITS_SQL} h join {CHUNKS_SQL} c on h.chunk_id = c.id where c.content is not null group by query_id""")
def structural_pass_rates(spark: SparkSession, d: str) -> DataFrame:
    c = tables.chunks(spark, d, "content").where("content is not null").withColumnRenamed("id", "chunk_id")
    j = tables.hits(spark, d).select("query_id", "chunk_id", "url").join(c, "chunk_id")
    rate = lambda x, name: F.round(F.avg(x.cast("int")), 6).alias(name)
    return j.groupBy("query_id").agg(rate(chunking.fence_balance(F.col("content")), "balanced"), rate(F.trim("content") != "", "filled"), rate(F.coalesce("url", F.lit("")) != "", "with_url"))


@query(f"select t as type, count(*) as n, count(distinct page_id) as pages from (select page_id, unnest(types) as t from {CHUNKS_SQL}) group by t")
def chunk_types(spark: SparkSession, d: str) -> DataFrame:
    return tables.chunks(spark, d, "page_id", "types").select("page_id", F.explode("types").alias("type")).groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


@query()
def split_markdown_pages(spark: SparkSession, d: str) -> DataFrame:
    return chunking.markdown_chunks(texts(spark, d), "result_id", "text_content")


@query()
def split_markdown_blocks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.markdown_chunks(texts(spark, d), "result_id", "text_content", merge=False)


def code_blocks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.fenced_code(texts(spark, d), "result_id", "text_content").withColumn("block", F.concat_ws(":", "result_id", "pos"))


@query()
def fenced_blocks(spark: SparkSession, d: str) -> DataFrame:
    return code_blocks(spark, d).groupBy("language").agg(F.count("*").alias("n"), F.sum(F.length("code")).alias("chars"))


@query()
def split_json_blocks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.json_chunks(code_blocks(spark, d).where("language = 'json'"), "block", "code")


@query()
def split_source_blocks(spark: SparkSession, d: str) -> DataFrame:
    code = code_blocks(spark, d).where(F.col("language").isin("python", "js", "ts", "javascript", "typescript"))
    return chunking.source_chunks(code, "block", "code", "language")


@query()
def processed_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every page through the pipeline of its media type."""
    s = tables.scrapes(spark, d).select("result_id", "url", "content_type", "text_content")
    p = pipeline.processed(s, "result_id", "url", "content_type", "text_content")
    return p.select("item_id", "title", F.size("links").alias("links"), F.size("chunks").alias("chunks"), F.size("errors").alias("errors"))


@query()
def embedded_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with their page's title and address, embedded offline."""
    c = tables.chunks(spark, d, "page_id", "path", "content").where("content is not null")
    p = tables.pages(spark, d).select(F.col("id").alias("page_id"), "title", "url")
    t = c.join(p, "page_id").select("id", embedding.embedding_text(F.col("title"), F.col("url"), F.col("path"), F.col("content")).alias("text"))
    return embedding.embed_column(t, "text", "embedding", 256).select("id", F.size("embedding").alias("dimension"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x), 3).alias("norm"))
