"""Every core query against its SQL twin over whole small tables; those without one must run."""

import random

import pytest
from pyspark.sql import functions as F

from strataforge.plans import catalogue

from .oracle import compare

QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf_dir, name):
    assert compare(spark, sf_dir, QUERIES[name], ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)


def test_hot_plans_have_no_row_by_row_python(spark, sf_dir):
    for name in ("bm25_topk", "expand_children", "normalize_url", "library_version_rollup", "group_hits_by_url"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
        assert "BatchEvalPython" not in plan and "CartesianProduct" not in plan, name


def test_phrase_ranking_shuffles_rows_and_queries_not_their_matches(spark, tmp_path):
    """Every query meets every chunk by a common word; phrases across fields or chunks don't count, and re-delivered rows count once."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(40)}"
    pages = [(i, f"https://h/{word()}/{word()}", f"{word()} Common {word()}" if i % 9 else None) for i in range(60)]
    chunks = [(i, i % 61 if i % 7 else None, f"common {' '.join(word() for _ in range(i % 12))}", [word(), "common"] if i % 5 else None) for i in range(1_500)]
    hits = [(100 * i, f'common {word()} "{word()} {word()}" {word()}_{word()}' if i % 10 else None if i else '"') for i in range(300)]
    hits += [(100 * i, hits[7][1]) for i in range(300, 310)]
    for name, rows, schema in (
        ("chunks", chunks + chunks[:50], "id bigint, page_id bigint, content string, path array<string>"),
        ("doc_pages", pages + pages[:5], "id bigint, url string, title string"),
        ("search_results", hits + hits[:20], "hit_id bigint, query_text string"),
    ):
        df = spark.createDataFrame(rows, schema)
        for c, kind in {"chunks": {"version_id": "bigint", "types": "array<string>", "sort_order": "int"}, "doc_pages": {"content_type": "string"}}.get(name, {}).items():
            df = df.withColumn(c, F.lit(None).cast(kind))
        df.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    sc = spark._jsc.sc()

    def shuffled() -> int:
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorList(True).apply(0).totalShuffleWrite()

    before = shuffled()
    assert compare(spark, str(tmp_path), QUERIES["bm25_phrases"], ORACLES["bm25_phrases"]) == []
    assert shuffled() - before < 1_500_000
