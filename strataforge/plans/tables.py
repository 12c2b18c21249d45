"""The domain tables, one row a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table


def libraries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "libraries")


def versions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "versions")


def pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "doc_pages").dropDuplicates(["id"])


def chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Name the columns that are needed: the wide ones are then not shuffled to find repeats."""
    t = table(spark, d, "chunks")
    return (t.select("id", *[c for c in columns if c != "id"]) if columns else t).dropDuplicates(["id"])


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Usable vectors in double precision: 64 values, none null or NaN, not all zero."""
    v = table(spark, d, "documents_vec")
    good = (F.size("embedding") == 64) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)) & F.exists("embedding", lambda x: x != 0)
    return v.where(good).select("chunk_id", "library_id", "version_id", F.col("embedding").cast("array<double>").alias("e")).dropDuplicates(["chunk_id"])


def hits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "search_results").dropDuplicates(["hit_id"])


def scrapes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scrape_results").dropDuplicates(["result_id"])
