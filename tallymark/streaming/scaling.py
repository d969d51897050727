"""Scaling decisions with a cooldown as keyed stream state."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallymark.operators.telemetry import ScalingPolicy, scale_steps
from tallymark.session import scratch_path
from tallymark.streaming.telemetry import run_append, run_partials

STATE = "replicas int, changed_at double"


def _advance(
    key: tuple, parts: Iterator[pd.DataFrame], state: GroupState, column: str, policy: ScalingPolicy
) -> Iterator[pd.DataFrame]:
    replicas, changed_at = state.get if state.exists else (policy.min_replicas, float("-inf"))
    ticks = pd.concat(list(parts), ignore_index=True)
    changes, replicas, changed_at = scale_steps(ticks, replicas, changed_at, policy)
    state.update((replicas, changed_at))
    changes.insert(0, column, key[0])
    yield changes


def tick_stream(readings: DataFrame, key: str, every: str = "30 seconds") -> DataFrame:
    """Mean load and response time per key and tick, updated as readings come in any order."""
    ticks = readings.groupBy(key, F.window("ts", every).alias("window")).agg(
        (F.sum("cpu_percent") / F.count(F.lit(1)) / 100).alias("load"), F.avg("response_s").alias("response_s")
    )
    return ticks.select(key, F.unix_seconds("window.start").alias("tick"), "load", "response_s")


def _tick_sums(readings: DataFrame, key: str, every_s: int = 30) -> DataFrame:
    tick = (F.floor(F.unix_seconds("ts") / every_s) * every_s).alias("tick")
    return readings.groupBy(key, tick).agg(
        F.sum("cpu_percent").alias("cpu"), F.count(F.lit(1)).alias("n"),
        F.sum("response_s").alias("response"), F.count("response_s").alias("answered"),
    )


def run_scaling(spark: SparkSession, readings: DataFrame, key: str) -> DataFrame:
    """Finish both stages over what is available: readings to ticks, ticks to decisions.

    Keyed state cannot follow an aggregation in one stream.  The first stream
    runs to the end of its input, which closes every tick, the last one too,
    however its files were ordered; the second walks the stored ticks.  A tick is
    only read once all is closed, so batches write their sums and keep no state.
    """
    lean = readings.where(F.col("ts").isNotNull()).select(key, "ts", "cpu_percent", "response_s")
    parts = run_partials(spark, lean, "scaling-ticks", lambda batch: _tick_sums(batch, key))
    sums = parts.groupBy(key, "tick").agg(*[F.sum(c).alias(c) for c in ("cpu", "n", "response", "answered")])
    ticks = sums.select(
        key, "tick", (F.col("cpu") / F.col("n") / 100).alias("load"), F.try_divide("response", "answered").alias("response_s")
    )
    stored = scratch_path(spark, "scaling-closed")
    ticks.write.parquet(stored)
    source = spark.readStream.schema(ticks.schema).parquet(stored)
    return run_append(spark, scaling_stream(source, key), "scaling")


def scaling_stream(ticks: DataFrame, key: str, policy: ScalingPolicy = ScalingPolicy()) -> DataFrame:
    """Scaling changes per key; replicas and the last change carry over batches.

    ``ticks`` holds one averaged row per key and tick (see ``tick_stream``), and
    batches follow each other in time, so a batch gives a key as many rows as
    the time it covers has ticks.
    """
    kind = ticks.schema[key].dataType.simpleString()
    return ticks.groupBy(key).applyInPandasWithState(
        partial(_advance, column=key, policy=policy),
        f"{key} {kind}, tick bigint, action string, replicas int",
        STATE,
        "append",
        GroupStateTimeout.NoTimeout,
    )
