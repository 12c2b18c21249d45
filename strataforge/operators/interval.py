"""Joins on ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], start: str, end: str, at: str, bucket_seconds: int) -> DataFrame:
    """Rows with equal `keys` and start < at <= end, by time buckets: an equi-join on (keys, bucket), so a key's rows spread over tasks.

    A left row goes to every bucket its interval touches; choose `bucket_seconds` about the usual interval length. Rows with a null key or time join nothing.
    """
    second = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1_000_000
    slot = lambda c: F.floor(second(c) / bucket_seconds)
    a = left.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end))).withColumn("_slot", F.explode(F.sequence(slot(start), slot(end))))
    b = right.where(F.col(at).isNotNull()).withColumn("_slot", slot(at))
    return a.join(b, [*keys, "_slot"]).where((F.col(at) > F.col(start)) & (F.col(at) <= F.col(end))).drop("_slot")
