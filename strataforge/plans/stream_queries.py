"""Event-time queries: streams drained to their end, and batch twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table
from ..streaming import events as stream
from .catalogue import query


def batch_events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))


def stamp(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


TUMBLING_SQL = "select strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2"


@query(TUMBLING_SQL)
def event_counts_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return stream.tumbling_counts(batch_events(spark, d)).select(stamp("w.start").alias("start"), "event_type", "n", "total")


@query(TUMBLING_SQL)
def event_counts_streamed(spark: SparkSession, d: str) -> DataFrame:
    s = stream.tumbling_counts(stream.read_events(spark, f"{d}/events.parquet"), late="400 days")
    return stream.drain(s, ["w", "event_type"]).select(stamp("w.start").alias("start"), "event_type", "n", "total")


@query("""
with o as (select user_id, ts, lag(ts) over (partition by user_id order by ts, event_id) as p from events),
s as (select user_id, ts, sum(case when p is null or ts >= p + interval 30 minutes then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) as k from o)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from s group by user_id, k""")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return stream.sessions(batch_events(spark, d)).select("user_id", stamp("w.start").alias("start"), "n")


@query("""select strftime(s, '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n
from (select unnest([time_bucket(interval 1 hour, ts), time_bucket(interval 1 hour, ts) - interval 1 hour]) as s, event_type from events) group by 1, 2""")
def event_counts_sliding(spark: SparkSession, d: str) -> DataFrame:
    return stream.sliding_counts(batch_events(spark, d)).select(stamp("w.start").alias("start"), "event_type", "n")


@query("select user_id, count(distinct event_type) as types, count(*) as n from events where user_id is not null group by user_id")
def user_types_streamed(spark: SparkSession, d: str) -> DataFrame:
    """State of each user kept by the stream itself."""
    return stream.drain(stream.user_types(stream.read_events(spark, f"{d}/events.parquet")), ["user_id"])


LATEST_SQL = "select user_id, arg_max(event_id, (ts, event_id)) as event_id, arg_max(event_type, (ts, event_id)) as event_type, count(*) as n from events group by user_id"


@query(LATEST_SQL)
def latest_event(spark: SparkSession, d: str) -> DataFrame:
    return stream.latest(batch_events(spark, d))


@query(LATEST_SQL)
def latest_event_streamed(spark: SparkSession, d: str) -> DataFrame:
    return stream.drain(stream.latest(stream.read_events(spark, f"{d}/events.parquet")), ["user_id"])


@query("select event_type, count(*) as n, round(avg(gap), 3) as mean_gap from (select event_type, epoch(ts) - lag(epoch(ts)) over (partition by user_id order by ts, event_id) as gap from events) group by event_type")
def event_gaps(spark: SparkSession, d: str) -> DataFrame:
    t = F.unix_micros("at") / 1_000_000
    gap = t - F.lag(t).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return batch_events(spark, d).withColumn("gap", gap).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("gap"), 3).alias("mean_gap"))


@query("select cast(props::json->>'$.k' as bigint) as k, count(*) as n from events group by 1")
def event_properties(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.get_json_object("props", "$.k").cast("bigint").alias("k")).agg(F.count("*").alias("n"))
