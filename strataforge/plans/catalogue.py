"""All queries of the core, with the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: One row a key: a re-delivered row repeats its key with the same content.
PAGES_SQL = "(select distinct on (id) * from doc_pages)"
CHUNKS_SQL = "(select distinct on (id) * from chunks)"
VECTORS_SQL = "(select distinct on (chunk_id) * from documents_vec)"
HITS_SQL = "(select distinct on (hit_id) * from search_results)"
SCRAPES_SQL = "(select distinct on (result_id) * from scrape_results)"
USABLE_SQL = (
    "(select chunk_id, library_id, version_id, embedding::double[] as e from (select distinct on (chunk_id) * from documents_vec) "
    "where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0)"
)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name; without `sql` only its rows are checked by the driver."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)


def _load() -> None:
    from . import catalog_queries, evaluation_queries, ingest_queries, relational_queries, search_queries, stream_queries, text_queries, url_queries  # noqa: F401
