"""Structured Streaming jobs over telemetry and error logs."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.operators.errors import classify, error_stats
from tallymark.operators.telemetry import ALERT_RULES, AlertRule, fired_alerts, level_counts, window_summary
from tallymark.session import scratch_path

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)
# A deployment's metric payload.
PAYLOAD_SCHEMA = T.StructType(
    [
        T.StructField("cpu_percent", T.DoubleType()),
        T.StructField("memory_percent", T.DoubleType()),
        T.StructField("disk_usage", T.DoubleType()),
        T.StructField("gpu_memory_used", T.DoubleType()),
        T.StructField("gpu_memory_total", T.DoubleType()),
    ]
)


def read_events(spark: SparkSession, folder: str, glob: str = "*.parquet", files_per_trigger: int = 100) -> DataFrame:
    """Event files of a folder as a stream with timestamps a watermark can use."""
    return (
        spark.readStream.schema(EVENT_SCHEMA)
        .option("maxFilesPerTrigger", files_per_trigger)
        .option("pathGlobFilter", glob)
        .parquet(folder)
        .withColumn("ts", F.col("ts").cast("timestamp"))
    )


def metric_ticks(events: DataFrame) -> DataFrame:
    """Deployment and device readings of an event stream."""
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.col("user_id").alias("deployment"),
        F.col("event_id").alias("tick_id"),
        "ts",
        F.least(F.lit(100.0), F.col("value")).alias("cpu_percent"),
        k.cast("double").alias("memory_percent"),
        (F.col("event_id") % 100).cast("double").alias("disk_percent"),
        (F.col("value") / 50).alias("response_s"),
        (F.least(F.col("value"), F.lit(100.0)) / 100).alias("utilization"),
        (F.col("user_id") % 16).alias("device"),
    )


def parse_payload(df: DataFrame, column: str = "payload", schema: T.StructType = PAYLOAD_SCHEMA) -> DataFrame:
    """Columns of a JSON metric payload; unreadable payloads give nulls."""
    return df.withColumn("_p", F.from_json(column, schema)).select("*", "_p.*").drop("_p", column)


def _bounded(ticks: DataFrame, column: str, late: str | None) -> DataFrame:
    """State is dropped ``late`` behind the newest reading, or kept for good without a bound.

    Readings older than a bound are lost, so a bound is only for sources that
    promise one; files in any order are read without.
    """
    return ticks.withWatermark(column, late) if late else ticks


def windowed_summary(
    ticks: DataFrame, keys: Sequence[str], size: str, late: str | None = None, slide: str | None = None
) -> DataFrame:
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return window_summary(_bounded(ticks, "ts", late), keys, window)


def windowed_levels(ticks: DataFrame, keys: Sequence[str], size: str, late: str | None = None) -> DataFrame:
    return level_counts(_bounded(ticks, "ts", late), keys, F.window("ts", size))


def alert_stream(
    ticks: DataFrame, key: str, late: str | None = None, rules: Sequence[AlertRule] = ALERT_RULES
) -> DataFrame:
    """Alerts as they fire, one per key, rule and second."""
    fired = fired_alerts(ticks, rules).select(key, "rule", "severity", "message", "second")
    same = [key, "rule", "second"]
    return _bounded(fired, "second", late).dropDuplicatesWithinWatermark(same) if late else fired.dropDuplicates(same)


def running_error_stats(log: DataFrame) -> DataFrame:
    return error_stats(classify(log))


def append_to(df: DataFrame, path: str, checkpoint: str) -> None:
    """Run an append stream over what is available into Parquet files."""
    query = (
        df.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def upsert_to(df: DataFrame, path: str, checkpoint: str) -> None:
    """Run an update stream over what is available, one folder per batch.

    A replayed batch overwrites its own folder, so a lost executor or a restart
    leaves no doubled rows; ``read_upserts`` keeps the last state per key.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(path, f"batch={batch_id}"))

    query = (
        df.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_upserts(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    """Last written state per key."""
    values = [f.name for f in schema.fields if f.name not in keys]
    stored = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
    newest = F.max(F.struct("batch", *values)).alias("_r")
    return stored.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"_r.{v}").alias(v) for v in values])


def run_append(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Finish an append stream and return what it wrote."""
    out = scratch_path(spark, name)
    append_to(df, out, scratch_path(spark, f"{name}-state"))
    return spark.read.schema(df.schema).parquet(out)


def run_upsert(spark: SparkSession, df: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """Finish an update stream and return its last state per key."""
    out = scratch_path(spark, name)
    upsert_to(df, out, scratch_path(spark, f"{name}-state"))
    return read_upserts(spark, out, df.schema, keys)


def _newest(rows: DataFrame, key: str, order: Sequence[str], n: int) -> DataFrame:
    """The newest ``n`` rows per key with their rank; nulls are oldest."""
    others = [c for c in rows.columns if c not in (key, "rank", *order)]
    place = Window.partitionBy(key).orderBy(*[F.desc_nulls_last(c) for c in (*order, *others)])
    return rows.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= n)


def run_newest(
    spark: SparkSession, readings: DataFrame, key: str, order: Sequence[str], values: Sequence[str], n: int, name: str
) -> DataFrame:
    """``key, rank, order, values`` of the newest ``n`` rows per key, after a stream's end.

    Each batch writes a new state of ``n`` rows a key from the state before and its own
    rows, wherever they lie in time; no key is handed to Python.  A replayed batch starts
    from the state before it and overwrites its own.
    """
    out = scratch_path(spark, name)
    columns = [key, *order, *values]
    held = readings.select(*columns)
    schema = T.StructType([held.schema[key], T.StructField("rank", T.IntegerType()), *held.schema.fields[1:]])
    done: list[int] = []

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        before = [b for b in done if b < batch_id]
        if before:
            batch = session.read.schema(schema).parquet(os.path.join(out, f"batch={before[-1]}")).select(*columns).unionByName(batch)
        _newest(batch, key, order, n).select(*schema.names).write.mode("overwrite").parquet(os.path.join(out, f"batch={batch_id}"))
        done[:] = [*before, batch_id]

    query = (
        held.writeStream.foreachBatch(write).option("checkpointLocation", scratch_path(spark, f"{name}-state")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    if not done:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(os.path.join(out, f"batch={done[-1]}"))


def run_partials(spark: SparkSession, df: DataFrame, name: str, reduce: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``reduce`` makes of each batch of a finished stream, all batches together.

    For sums that are only asked for at the end of the input: no state is kept between
    batches, and a replayed batch overwrites its own folder.
    """
    out = scratch_path(spark, name)
    schemas: list[T.StructType] = []

    def write(batch: DataFrame, batch_id: int) -> None:
        part = reduce(batch)
        schemas[:] = [part.schema]
        part.write.mode("overwrite").parquet(os.path.join(out, f"batch={batch_id}"))

    query = df.writeStream.foreachBatch(write).option("checkpointLocation", scratch_path(spark, f"{name}-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    if not schemas:
        return reduce(spark.createDataFrame([], df.schema))
    return spark.read.schema(schemas[0]).parquet(out)
