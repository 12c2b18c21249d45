"""The event stream: windows in event time, sessions, latest state, run to the end of what is there."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import cut_lineage

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The events as a stream, with a time that watermarks accept."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    single = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isFile()
    reader = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 64)
    if single:  # a stream reads folders: the file's own, with only its name let through
        folder, name = path.rsplit("/", 1)
        reader, path = reader.option("pathGlobFilter", name).option("recursiveFileLookup", "true"), folder
    return reader.parquet(path).withColumn("at", F.col("ts").cast("timestamp"))


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events and their value by type and window; events later than `late` are left out when streaming."""
    w = F.window("at", width)
    return events.withWatermark("at", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def sliding_users(events: DataFrame, width: str = "2 hours", step: str = "1 hour", late: str = "1 day") -> DataFrame:
    return events.withWatermark("at", late).groupBy(F.window("at", width, step).alias("w")).agg(F.approx_count_distinct("user_id").alias("users"), F.count("*").alias("n"))


def sliding_counts(events: DataFrame, width: str = "2 hours", step: str = "1 hour", late: str = "1 day") -> DataFrame:
    return events.withWatermark("at", late).groupBy(F.window("at", width, step).alias("w"), "event_type").agg(F.count("*").alias("n"))


def user_types(events: DataFrame) -> DataFrame:
    """(user_id, types, n): kinds and number of each user's events so far, kept as state of the user; a row each time it changes.

    A user's events come in pieces and in any order, of which only the kinds are held.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, n = state.get if state.exists else ([], 0)
        kinds = set(seen)
        for pdf in parts:
            kinds.update(pdf["event_type"].dropna())
            n += len(pdf)
        state.update((sorted(kinds), n))
        yield pd.DataFrame({"user_id": [key[0]], "types": [len(kinds)], "n": [n]})

    rows = events.select("user_id", "event_type").where("user_id is not null")
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, types bigint, n bigint", "kinds array<string>, n bigint", "update", GroupStateTimeout.NoTimeout)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Runs of a user's events with less than `gap` between them."""
    return events.withWatermark("at", late).groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n"))


def latest(events: DataFrame) -> DataFrame:
    """Each user's last event by time; as a stream in update mode."""
    return events.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("at", "event_id")).alias("x"), F.count("*").alias("n")).select("user_id", "x.event_id", "x.event_type", "n")


def drain(stream: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """Run the stream over all data present and return its last result for each key, from files in the shared checkpoint folder.

    Every micro-batch writes its updates under its own number, so a batch that is repeated after a failure replaces its own files.
    """
    spark = stream.sparkSession
    cut_lineage(spark.range(1))  # makes sure that a checkpoint folder is set
    root = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/streams/{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    out = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{root}/out")
    values = [c for c in stream.columns if c not in keys]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("x")).select(*keys, *[F.col(f"x.{c}").alias(c) for c in values])
