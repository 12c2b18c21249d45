"""Search, fusion, clustering, expansion and assembly. Searches take every row whose id is divisible by 100 as a query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fulltext
from ..functions.fulltext import stems, tokens
from ..operators import expand, phrases, search
from ..session import cut_lineage, table
from . import tables
from .catalogue import CHUNKS_SQL, HITS_SQL, PAGES_SQL, USABLE_SQL, query

TOK = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
DOCS_SQL = f"""docs as (select c.id, c.version_id, c.types, c.sort_order, c.path, c.page_id, p.url, p.content_type, coalesce({TOK.format('c.content')}, []) as ct, coalesce({TOK.format('p.title')}, []) as tt,
coalesce({TOK.format('p.url')}, []) as ut, coalesce({TOK.format("array_to_string(c.path, ' ')")}, []) as pt from {CHUNKS_SQL} c join {PAGES_SQL} p on c.page_id = p.id)"""
TF_SQL = """tf as (select id, n as len, term, sum(w) as f from (select id, len(ct) + len(tt) + len(ut) + len(pt) as n, unnest(list_concat(list_concat(ct, tt), list_concat(ut, pt))) as term,
unnest(list_concat(list_concat(list_transform(ct, lambda x: 10.0::double), list_transform(tt, lambda x: 1.0::double)), list_concat(list_transform(ut, lambda x: 5.0::double), list_transform(pt, lambda x: 1.0::double)))) as w from docs) group by all)"""
QUERIES_SQL = f"q as (select distinct hit_id as query_id, unnest({TOK.format('query_text')}) as term from {HITS_SQL} where hit_id % 100 = 0)"
SCORES_SQL = """st as (select count(*) as n, avg(len(ct) + len(tt) + len(ut) + len(pt)) as al from docs),
df as (select term, count(*) as df from tf where term in (select term from q) group by term),
bm as (select query_id, id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / al))), 9) as score from q join tf using (term) join df using (term), st group by all)"""
BM25_SQL = f"with {DOCS_SQL}, {TF_SQL}, {QUERIES_SQL}, {SCORES_SQL}"
KNN_SQL = f"""e as {USABLE_SQL}, vq as (select h.hit_id as query_id, e.e, e.version_id from {HITS_SQL} h join e on h.chunk_id = e.chunk_id where h.hit_id % 100 = 0),
nn as (select query_id, chunk_id as id, round(list_distance(vq.e, e.e), 9) as distance from vq, e)"""


CHUNK_FIELDS, PAGE_FIELDS = ("content", "path"), ("title", "url")


def indexed(spark: SparkSession, d: str, terms: DataFrame | None, by: Callable[[Column], Column] = tokens) -> tuple[DataFrame, DataFrame]:
    """Occurrences and lengths of all chunks over content, path and their page's title and URL.

    Chunk and page texts are cut into terms where they are read; a page's few terms then go to its chunks, so no text is shuffled.
    """
    pick = lambda fields: {f: search.WEIGHTS[f] for f in fields}
    c = table(spark, d, "chunks").select("id", "content", F.array_join("path", " ").alias("path"))
    p = table(spark, d, "doc_pages").select(F.col("id").alias("page_id"), "title", "url")
    pairs = tables.chunks(spark, d, "page_id").where("page_id is not null")
    paged = search.lengths(p, "page_id", list(PAGE_FIELDS), by).withColumnRenamed("len", "page_len")
    sizes = search.lengths(c, "id", list(CHUNK_FIELDS), by).join(pairs, "id").join(paged, "page_id").select("id", (F.col("len") + F.col("page_len")).alias("len"))
    own = search.occurrences(c, "id", pick(CHUNK_FIELDS), terms, by)
    given = search.occurrences(p, "page_id", pick(PAGE_FIELDS), terms, by).join(pairs, "page_id").select("id", "term", "w")
    return own.unionByName(given), sizes


def ranked_texts(spark: SparkSession, d: str, k: int) -> DataFrame:
    q = text_queries(spark, d)
    return search.bm25(*indexed(spark, d, q.select("term").distinct()), q, "id", k)


def text_queries(spark: SparkSession, d: str) -> DataFrame:
    q = tables.hits(spark, d).where("hit_id % 100 = 0")
    return q.select(F.col("hit_id").alias("query_id"), F.explode(F.array_distinct(tokens(F.col("query_text")))).alias("term"))


def vector_queries(spark: SparkSession, d: str, e: DataFrame) -> DataFrame:
    q = tables.hits(spark, d).where("hit_id % 100 = 0").select(F.col("hit_id").alias("query_id"), "chunk_id")
    return q.join(e, "chunk_id").select("query_id", "e", "version_id")


def arms(spark: SparkSession, d: str, depth: int) -> tuple[DataFrame, DataFrame]:
    e = tables.vectors(spark, d)
    text = ranked_texts(spark, d, depth)
    near = search.knn(e.withColumnRenamed("chunk_id", "id"), vector_queries(spark, d, e), "id", depth)
    return text, near


@query(f"{BM25_SQL} select query_id, id, score from bm qualify row_number() over (partition by query_id order by score desc, id) <= 20")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return ranked_texts(spark, d, 20)


@query(f"""{BM25_SQL} select query_id, id, score from (select * from bm qualify row_number() over (partition by query_id order by score desc, id) <= 40) join docs using (id)
where not coalesce(list_contains(types, 'code'), false)""")
def bm25_structural_excluded(spark: SparkSession, d: str) -> DataFrame:
    """A type is left out after the arm's limit, as the hybrid search does."""
    best = ranked_texts(spark, d, 40)
    types = tables.chunks(spark, d, "types")
    return best.join(types, "id").where(~F.coalesce(F.array_contains("types", "code"), F.lit(False))).select("query_id", "id", "score")


@query(f"with {DOCS_SQL}, {TF_SQL} select term, count(*) as df, sum(f) as weight from tf group by term")
def term_document_frequency(spark: SparkSession, d: str) -> DataFrame:
    found, sizes = indexed(spark, d, None)
    t = found.join(sizes.select("id"), "id", "left_semi").groupBy("id", "term").agg(F.sum("w").alias("f"))
    return t.groupBy("term").agg(F.count("*").alias("df"), F.sum("f").alias("weight"))


@query(f"with {DOCS_SQL} select count(*) as n, round(avg(len(ct) + len(tt) + len(ut) + len(pt)), 6) as avg_len from docs")
def corpus_statistics(spark: SparkSession, d: str) -> DataFrame:
    return indexed(spark, d, None)[1].agg(F.count("*").alias("n"), F.round(F.avg("len"), 6).alias("avg_len"))


@query()
def bm25_porter(spark: SparkSession, d: str) -> DataFrame:
    """Stemmed ranking; the stemmer and scores are held against an embedded full-text index in the tests."""
    q = tables.hits(spark, d).where("hit_id % 100 = 0").select(F.col("hit_id").alias("query_id"), F.explode(F.array_distinct(stems(F.col("query_text")))).alias("term"))
    return search.bm25(*indexed(spark, d, q.select("term").distinct(), stems), q, "id", 20)


@query()
def match_expressions(spark: SparkSession, d: str) -> DataFrame:
    return tables.hits(spark, d).select("query_text").where("query_text is not null").distinct().select("query_text", fulltext.match_expressions(F.col("query_text")).alias("expression"))


@query(f"""with {DOCS_SQL}, parts as (select hit_id as query_id, list_filter(list_transform(regexp_extract_all(query_text, '"[^"]*"?|[^" ]+'), lambda x: replace(x, '"', '')), lambda x: x <> '') as parts from {HITS_SQL} where hit_id % 100 = 0),
whole as (select query_id, unnest(case when len(parts) > 1 then list_prepend(array_to_string(parts, ' '), parts) else parts end) as part from parts),
q as (select distinct query_id, {TOK.format('part')} as ws from whole where len({TOK.format('part')}) > 0),
tf as (select id, len(ct) + len(tt) + len(ut) + len(pt) as len, ws, {" + ".join(f"{w} * len(list_filter(range(1, len({c}) - len(ws) + 2), lambda i: {c}[i:i + len(ws) - 1] = ws))" for c, w in (("ct", "10.0::double"), ("tt", "1"), ("ut", "5"), ("pt", "1")))} as f from docs, (select distinct ws from q)),
st as (select count(*) as n, avg(len(ct) + len(tt) + len(ut) + len(pt)) as al from docs), df as (select ws, count(*) as df from tf where f > 0 group by ws),
bm as (select query_id, id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / al))), 9) as score from q join tf using (ws) join df using (ws), st where f > 0 group by all)
select query_id, id, score from bm qualify row_number() over (partition by query_id order by score desc, id) <= 20""")
def bm25_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Queries as match expressions: the whole query as one phrase, or any of its parts; every phrase is ranked like a term."""
    q = tables.hits(spark, d).where("hit_id % 100 = 0").select(F.col("hit_id").alias("query_id"), F.explode(fulltext.phrases(F.col("query_text"))).alias("part"))
    q = cut_lineage(q.select("query_id", F.array_join(tokens(F.col("part")), " ").alias("term")).where("term <> ''").distinct())
    c = table(spark, d, "chunks").select("id", "content", F.array_join("path", " ").alias("path"))
    p = table(spark, d, "doc_pages").select(F.col("id").alias("page_id"), "title", "url")
    pairs = tables.chunks(spark, d, "page_id").where("page_id is not null")

    def find(lexicon: Broadcast[phrases.Lexicon]) -> DataFrame:
        given = phrases.found(p, "page_id", list(PAGE_FIELDS), lexicon).withColumnRenamed("len", "page_len").join(pairs, "page_id")
        return phrases.found(c, "id", list(CHUNK_FIELDS), lexicon).join(given, "id").select("id", (F.col("len") + F.col("page_len")).alias("len"), *CHUNK_FIELDS, *PAGE_FIELDS)

    return phrases.bm25_phrases(find, q, "id", search.WEIGHTS, 20)


@query(f"with {KNN_SQL} select query_id, id, distance from nn qualify row_number() over (partition by query_id order by distance, id) <= 20")
def knn_l2_topk(spark: SparkSession, d: str) -> DataFrame:
    e = tables.vectors(spark, d)
    return search.knn(e.withColumnRenamed("chunk_id", "id"), vector_queries(spark, d, e), "id", 20)


@query(f"""with e as {USABLE_SQL}, nn as (select q.chunk_id as query_id, e.chunk_id as id, round(list_distance(q.e, e.e), 9) as distance from e q join e on q.version_id = e.version_id where q.chunk_id % 100 = 0)
select query_id, id, distance from nn qualify row_number() over (partition by query_id order by distance, id) <= 10""")
def knn_within_version(spark: SparkSession, d: str) -> DataFrame:
    e = tables.vectors(spark, d)
    q = e.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "e", "version_id")
    return search.knn(e.withColumnRenamed("chunk_id", "id"), q, "id", 10, group="version_id")


FUSED_SQL = """ta as (select query_id, id, row_number() over (partition by query_id order by score desc, id) as r from bm qualify r <= {depth}),
va as (select query_id, id, row_number() over (partition by query_id order by distance, id) as r from nn qualify r <= {depth}),
fu as (select query_id, id, ta.r as text_rank, va.r as vector_rank, round(coalesce({tw}::double / (60 + ta.r), 0) + coalesce({vw}::double / (60 + va.r), 0), 12) as score from ta full outer join va using (query_id, id))
select query_id, id, text_rank, vector_rank, score from fu qualify row_number() over (partition by query_id order by score desc, id) <= 10"""


def _fused_sql(**how: float) -> str:
    return f"{BM25_SQL}, {KNN_SQL}, " + FUSED_SQL.format(**how)


def _ranks(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in ("text_rank", "vector_rank")})


@query(_fused_sql(depth=20, tw=1, vw=1))
def hybrid_rrf_topk(spark: SparkSession, d: str) -> DataFrame:
    return _ranks(search.fuse(*arms(spark, d, 20), "id", 10))


@query(_fused_sql(depth=20, tw=2, vw=0.5))
def hybrid_rrf_weighted(spark: SparkSession, d: str) -> DataFrame:
    return _ranks(search.fuse(*arms(spark, d, 20), "id", 10, text_weight=2.0, vector_weight=0.5))


@query(_fused_sql(depth=100, tw=1, vw=1))
def hybrid_overfetch(spark: SparkSession, d: str) -> DataFrame:
    return _ranks(search.fuse(*arms(spark, d, 100), "id", 10))


STORED_SQL = f"""a as (select hit_id, query_id, row_number() over (partition by query_id order by vec_score desc, hit_id) as r from {HITS_SQL} where vec_score is not null),
b as (select hit_id, query_id, row_number() over (partition by query_id order by fts_score desc, hit_id) as r from {HITS_SQL} where fts_score is not null),
f as (select h.hit_id, h.query_id, h.url, h.chunk_id, round(coalesce(1.0::double / (60 + a.r), 0) + coalesce(1.0::double / (60 + b.r), 0), 12) as score from {HITS_SQL} h left join a using (hit_id) left join b using (hit_id))"""


def stored_scores(spark: SparkSession, d: str) -> DataFrame:
    """Fusion of the scores stored with the hits; a null score is no rank."""
    h = tables.hits(spark, d)
    rank = lambda c: F.when(F.col(c).isNotNull(), F.row_number().over(Window.partitionBy("query_id", F.col(c).isNotNull()).orderBy(F.desc(c), "hit_id")))
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(60.0) + F.col(c)), F.lit(0.0))
    return h.withColumns({"vr": rank("vec_score"), "tr": rank("fts_score")}).withColumn("score", F.round(part("vr") + part("tr"), 12))


@query(f"with {STORED_SQL} select hit_id, query_id, score, row_number() over (partition by query_id order by score desc, hit_id) as place from f")
def fuse_stored_scores(spark: SparkSession, d: str) -> DataFrame:
    s = stored_scores(spark, d)
    return s.select("hit_id", "query_id", "score", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "hit_id")).cast("bigint").alias("place"))


CLUSTER_SQL = f"""with {STORED_SQL}, j as (select f.query_id, f.url, f.score, c.id, c.sort_order, p.content_type from f join {CHUNKS_SQL} c on f.chunk_id = c.id join {PAGES_SQL} p on c.page_id = p.id),
l as (select *, sort_order - lag(sort_order) over (partition by query_id, url order by sort_order, id) as gap from j),
k as (select *, sum(case when gap > 3 then 1 else 0 end) over (partition by query_id, url order by sort_order, id rows unbounded preceding)::bigint as cluster from l)"""


def clustered(spark: SparkSession, d: str) -> DataFrame:
    s = stored_scores(spark, d).select("query_id", "url", "score", F.col("chunk_id").alias("id"))
    c = tables.chunks(spark, d, "sort_order", "page_id")
    p = tables.pages(spark, d).select(F.col("id").alias("page_id"), "content_type")
    return search.cluster_hits(s.join(c, "id").join(p, "page_id"))


@query(f"{CLUSTER_SQL} select query_id, url, id, cluster from k")
def gap_cluster_hits(spark: SparkSession, d: str) -> DataFrame:
    return clustered(spark, d).select("query_id", "url", "id", "cluster")


@query(f"{CLUSTER_SQL} select query_id, url, cluster, max(score) as score, arg_min(content_type, (-score, id)) as content_type, string_agg(id::varchar, ',' order by sort_order, id) as ids from k group by all")
def group_hits_by_url(spark: SparkSession, d: str) -> DataFrame:
    return search.group_results(clustered(spark, d)).withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


# Expansion: every chunk that some hit names is a seed.
C_SQL = f"c as (select id, page_id, coalesce(path, []) as path, coalesce(types, []) as types, sort_order, content from {CHUNKS_SQL})"
SEED_SQL = f"with {C_SQL}, s as (select * from c where id in (select chunk_id from search_results))"


def tree(spark: SparkSession, d: str) -> DataFrame:
    c = tables.chunks(spark, d, "page_id", "path", "types", "sort_order", "content")
    empty = F.array().cast("array<string>")
    return c.withColumns({"path": F.coalesce("path", empty), "types": F.coalesce("types", empty)})


def seeds(spark: SparkSession, d: str, c: DataFrame) -> DataFrame:
    return c.join(tables.hits(spark, d).select(F.col("chunk_id").alias("id")).where("id is not null").distinct(), "id", "left_semi")


@query(f"{SEED_SQL} select s.id as seed_id, arg_max(c.id, (c.sort_order, c.id)) as id from s join c on s.page_id = c.page_id and len(s.path) > 0 and c.path = s.path[:len(s.path) - 1] and c.sort_order < s.sort_order group by s.id")
def expand_parent(spark: SparkSession, d: str) -> DataFrame:
    c = tree(spark, d)
    return expand.parents(seeds(spark, d, c), c)


@query(f"""{SEED_SQL} select s.id as seed_id, c.id, 'before' as side from s join c on s.page_id = c.page_id and c.path = s.path and c.sort_order < s.sort_order qualify row_number() over (partition by s.id order by c.sort_order desc, c.id desc) <= 1
union all select s.id, c.id, 'after' from s join c on s.page_id = c.page_id and c.path = s.path and c.sort_order > s.sort_order qualify row_number() over (partition by s.id order by c.sort_order, c.id) <= 2""")
def expand_siblings(spark: SparkSession, d: str) -> DataFrame:
    c = tree(spark, d)
    before, after = expand.siblings(seeds(spark, d, c), c)
    return before.withColumn("side", F.lit("before")).unionByName(after.withColumn("side", F.lit("after")))


@query(f"{SEED_SQL} select s.id as seed_id, c.id from s join c on s.page_id = c.page_id and len(c.path) = len(s.path) + 1 and c.path[:len(s.path)] = s.path and c.sort_order > s.sort_order qualify row_number() over (partition by s.id order by c.sort_order, c.id) <= 3")
def expand_children(spark: SparkSession, d: str) -> DataFrame:
    c = tree(spark, d)
    return expand.children(seeds(spark, d, c), c)


@query(f"{SEED_SQL} select s.id as seed_id, len(c.path)::int as depth, arg_min(c.id, (c.sort_order, c.id)) as id from s join c on s.page_id = c.page_id and len(c.path) < len(s.path) and len(c.path) >= len(s.path) - 10 and s.path[:len(c.path)] = c.path group by s.id, len(c.path)")
def expand_ancestors(spark: SparkSession, d: str) -> DataFrame:
    c = tree(spark, d)
    return expand.ancestors(seeds(spark, d, c), c)


@query(f"{SEED_SQL} select s.id as seed_id, c.id from s join c on s.page_id = c.page_id and c.path[:len(s.path)] = s.path and c.sort_order >= s.sort_order")
def expand_subtree(spark: SparkSession, d: str) -> DataFrame:
    c = tree(spark, d)
    return expand.subtrees(seeds(spark, d, c), c)


@query(f"{SEED_SQL} select s.id as seed_id, arg_max(x.id, x.depth) as id from s join (select page_id, path, len(path) as depth, arg_min(id, (sort_order, id)) as id from c where list_contains(types, 'list') group by all) x on s.page_id = x.page_id and x.depth < len(s.path) and s.path[:x.depth] = x.path group by s.id")
def nearest_typed_ancestor(spark: SparkSession, d: str) -> DataFrame:
    c = tree(spark, d)
    return expand.nearest_ancestor(seeds(spark, d, c), c, "list")


@query(f"""with {C_SQL}, g as (select page_id, max(len(path)) as m, min(len(path)) as n, list(path) as ps from c group by page_id)
select page_id, len(list_filter(range(1, n + 1), lambda i: len(list_distinct(list_transform(ps, lambda p: array_to_string(p[:i], chr(1))))) = 1)) as shared from g""")
def common_path_prefix(spark: SparkSession, d: str) -> DataFrame:
    g = tree(spark, d).groupBy("page_id").agg(F.collect_list("path").alias("paths"))
    return g.select("page_id", F.size(expand.common_prefix(F.col("paths"))).cast("bigint").alias("shared"))


@query(f"""{SEED_SQL}, x as (select s.id as seed_id, c.id, c.sort_order, c.content from s join c on s.page_id = c.page_id where c.id = s.id
or c.id = (select arg_max(k.id, (k.sort_order, k.id)) from c k where k.page_id = s.page_id and len(s.path) > 0 and k.path = s.path[:len(s.path) - 1] and k.sort_order < s.sort_order))
select seed_id, md5(string_agg(content, chr(10) || chr(10) order by sort_order, id)) as digest, count(*) as parts from x where content is not null group by seed_id""")
def assemble_with_parent(spark: SparkSession, d: str) -> DataFrame:
    c = tree(spark, d)
    s = seeds(spark, d, c)
    found = s.select(F.col("id").alias("seed_id"), "id").unionByName(expand.parents(s, c)).distinct()
    parts = found.join(c.where("content is not null").select("id"), "id").groupBy("seed_id").agg(F.count("*").alias("parts"))
    return expand.assemble(found, c).select("seed_id", F.md5(F.col("content").cast("binary")).alias("digest")).join(parts, "seed_id")


@query()
def expanded_results(spark: SparkSession, d: str) -> DataFrame:
    c = cut_lineage(tree(spark, d))
    return expand.assemble(expand.expand_markdown(seeds(spark, d, c), c), c)


@query()
def expanded_hierarchies(spark: SparkSession, d: str) -> DataFrame:
    c = cut_lineage(tree(spark, d))
    return expand.assemble(expand.expand_hierarchical(seeds(spark, d, c), c), c, "")
