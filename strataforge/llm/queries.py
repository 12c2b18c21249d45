"""Queries of the corpus operators; each takes (spark, sf_dir) and runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import boilerplate, language, leakage, near_copies, neighbours, packing, page_identity, pieces, residue


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, d, "documents_vec"), "chunk_id", "embedding").select("id_a", "id_b")


def p1_nearest(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest(table(spark, d, "documents_vec"), "chunk_id", "embedding")


def _split(spark: SparkSession, d: str, only: bool) -> DataFrame:
    chunks = pieces.split_oversized(table(spark, d, "chunks"), "id", "content", "path", only_oversized=only)
    scrapes = pieces.split_oversized(table(spark, d, "scrape_results"), "result_id", "text_content", only_oversized=only)
    return chunks.select(F.lit("chunk").alias("src"), "*").unionByName(scrapes.select(F.lit("scrape").alias("src"), "*"))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d, False)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    # Pieces of an item leave the splitter together, so the partial aggregation leaves one row an item to shuffle.
    return _split(spark, d, True).groupBy("src", "item_id").agg(F.when(F.max("forced"), "forced").otherwise("natural").alias("cut"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pages = residue.residue_pages(table(spark, d, "scrape_results"), "result_id", "url", "text_content")
    titles = residue.residue_titles(table(spark, d, "search_results"), "hit_id", "title", "url")
    return pages.select(F.lit("scrape").alias("src"), "item_id").unionByName(titles.select(F.lit("search").alias("src"), "item_id"))


def p3_kept_pages(spark: SparkSession, d: str) -> DataFrame:
    """The pages left for the index."""
    scrapes = table(spark, d, "scrape_results").where("text_content is not null").select("result_id", "url", "text_content")
    bad = residue.residue_pages(scrapes, "result_id", "url", "text_content")
    return scrapes.select("result_id", "url").distinct().join(bad.select(F.col("item_id").alias("result_id")), "result_id", "left_anti")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.frame_lines(table(spark, d, "scrape_results"), "result_id", "url", "text_content").withColumnRenamed("item_id", "result_id")


def p5_bodies(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.main_bodies(table(spark, d, "scrape_results"), "result_id", "url", "text_content").withColumnRenamed("item_id", "result_id")


#: The data's own terms: three words a shingle, 0.6, at least 20 words.
CHUNK_COPIES = near_copies.CopyParams(shingle=3, similarity=0.6, least_words=20)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks")
    members, links = near_copies.near_copies(chunks, "id", "content", CHUNK_COPIES)
    chunk = near_copies.expand_pairs(members, links, near_copies.copied_codes(chunks, members, "content", CHUNK_COPIES))
    url = page_identity.same_page_hits(table(spark, d, "search_results"), "hit_id", "query_id", "url")
    return chunk.select(F.lit("chunk").alias("src"), "*").unionByName(url.select(F.lit("url").alias("src"), "*"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_copies.groups(*near_copies.near_copies(table(spark, d, "chunks"), "id", "content", CHUNK_COPIES))


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_windows(table(spark, d, "documents"), table(spark, d, "context_windows"), "doc_id", "text")


def p6_utilisation(spark: SparkSession, d: str) -> DataFrame:
    return packing.utilisation(p6_packed(spark, d), table(spark, d, "context_windows"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), "doc_id", "text", "item_id", ["prompt", "answer"])


#: Windows of 16 words within 2 word edits, 8 within one for shorter passages: passages that were reworded in places.
NEAR = leakage.LeakParams(window=16, least_window=8, max_edits=2, repetitions=12, samples=6)


def p7_near(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), "doc_id", "text", "item_id", ["prompt", "answer"], NEAR)


def p8_languages(spark: SparkSession, d: str) -> DataFrame:
    return language.relabel(table(spark, d, "documents"), "doc_id", "text", "lang").drop("stated")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return language.corrections(language.relabel(table(spark, d, "documents"), "doc_id", "text", "lang"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_nearest, p2_found, p2_pieces, p3_found, p3_kept_pages, p4_found, p4_groups, p5_found, p5_bodies, p6_packed, p6_utilisation, p7_found, p7_near, p8_found, p8_languages)}


#: Brute force over all pairs; and white space as Unicode defines it.
P1_SQL = """
with e as (select chunk_id as id, embedding::double[] as v from (select distinct on (chunk_id) * from documents_vec)
where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
s as (select a.id as a, b.id as b, list_cosine_similarity(a.v, b.v) as sim from e a join e b on a.id <> b.id),
r as (select a, b, sim from s qualify row_number() over (partition by a order by sim desc, b) <= 10)
select distinct least(a, b) as id_a, greatest(a, b) as id_b from r where sim >= 0.9"""
SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
UNITS = r"(length({0}) + len(regexp_extract_all({0}, '[\x{{10000}}-\x{{10FFFF}}]')))"
P2_SQL = f"""
with t as (select 'chunk' as src, id as item_id, content as t from (select distinct on (id) * from chunks)
union all select 'scrape', result_id, text_content from (select distinct on (result_id) * from scrape_results)),
l as (select src, item_id, list_max(list_transform(regexp_split_to_array(t, '{SPACE}'), lambda x: {UNITS.format("x")})) as run from t where {UNITS.format("t")} > 5000)
select src, item_id, case when run > 5000 then 'forced' else 'natural' end as cut from l"""


def oracle_sql() -> dict[str, str]:
    """SQL twins where SQL can express the result; the others are tested against brute force on fixtures."""
    return {"p1_found": P1_SQL, "p2_found": P2_SQL}
