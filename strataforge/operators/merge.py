"""Writes to the store as set operations: upsert, delete, refresh, back-fill."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of both, new ones winning on equal keys (null keys are equal). Columns that only one side has become null on the other.

    `new` may repeat a key: one of its rows, the greatest by all columns as text, stays.
    """
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    others = [c for c in both.columns if c not in keys and c != "_new"]
    w = Window.partitionBy(*keys).orderBy(F.desc("_new"), F.desc(F.to_json(F.struct(*others))) if others else F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def delete(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of `old` whose keys are not in `gone`."""
    return old.join(gone.select(*keys).distinct(), keys, "left_anti")


def refresh_changes(stored: DataFrame, fetched: DataFrame, keys: list[str], tag: str = "etag") -> DataFrame:
    """keys, change: what a refresh does to each page. Both sides have one row a key; `fetched` has `status` (200, 304, 404) and the new tag.

    kept: not fetched, 304, or 200 with the tag unchanged; replaced: 200 with another or no tag; deleted: 404 of a stored page; inserted: 200 of one
    not stored; ignored: any other answer for a page that is not stored.
    """
    a = stored.select(*keys, F.col(tag).alias("_old"), F.lit(True).alias("_stored"))
    b = fetched.select(*keys, F.col(tag).alias("_tag"), F.col("status").alias("_status"))
    known, ok = F.coalesce("_stored", F.lit(False)), F.col("_status") == 200
    change = (
        F.when(known & (F.col("_status").isNull() | (F.col("_status") == 304)), "kept")
        .when(known & ok & (F.col("_old") == F.col("_tag")), "kept")
        .when(known & ok, "replaced")
        .when(known & (F.col("_status") == 404), "deleted")
        .when(known, "kept")
        .when(ok, "inserted")
        .otherwise("ignored")
    )
    return a.join(b, keys, "full_outer").select(*keys, change.alias("change"))


def apply_refresh(stored: DataFrame, fetched: DataFrame, keys: list[str], tag: str = "etag") -> DataFrame:
    """The stored table after the refresh."""
    changes = refresh_changes(stored, fetched, keys, tag)
    stay = stored.join(changes.where(F.col("change") == "kept").select(*keys), keys, "left_semi")
    come = fetched.join(changes.where(F.col("change").isin("replaced", "inserted")).select(*keys), keys, "left_semi").drop("status")
    return stay.unionByName(come, allowMissingColumns=True)


def write_partitions(df: DataFrame, path: str, partitions: list[str], sort: list[str]) -> None:
    """Overwrite only the partitions that `df` has, files sorted for row group skipping; hot partitions are spread by the sort columns' hash."""
    salted = df.repartition(*[F.col(c) for c in partitions], F.pmod(F.xxhash64(*sort), F.lit(8)))
    salted.sortWithinPartitions(*partitions, *sort).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)
