"""Telemetry rules shared by batch and stream."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions.sequence import SLICE, ordered_slices


class AlertRule(NamedTuple):
    """An alert rule; the condition is a SQL predicate over the metric columns."""

    name: str
    condition: str
    message: str
    severity: str = "warning"


# The default alert rules.
ALERT_RULES = (
    AlertRule("high_cpu", "cpu_percent > 80", "CPU 사용률이 80%를 초과했습니다", "warning"),
    AlertRule("high_memory", "memory_percent > 85", "메모리 사용률이 85%를 초과했습니다", "critical"),
)


def memory_level(utilization: Column) -> Column:
    """safe, warning from .70, critical from .85, emergency from .95."""
    return (
        F.when(utilization < 0.70, "safe")
        .when(utilization < 0.85, "warning")
        .when(utilization < 0.95, "critical")
        .otherwise("emergency")
    )


def level_name(utilization: float) -> str:
    """``memory_level`` of one number."""
    return "safe" if utilization < 0.70 else "warning" if utilization < 0.85 else "critical" if utilization < 0.95 else "emergency"


def healthy(cpu: Column, memory: Column, disk: Column) -> Column:
    return (cpu < 90) & (memory < 95) & (disk < 95)


def fired_alerts(df: DataFrame, rules: Sequence[AlertRule] = ALERT_RULES) -> DataFrame:
    """One row per metric row and rule whose condition holds."""
    fired = [
        F.when(
            F.expr(r.condition),
            F.struct(
                F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(r.message).alias("message")
            ),
        )
        for r in rules
    ]
    return (
        df.withColumn("_r", F.explode(F.array_compact(F.array(*fired))))
        .select("*", "_r.*")
        .drop("_r")
        .withColumn("second", F.date_trunc("second", "ts"))
    )


def alerts(df: DataFrame, key: str, rules: Sequence[AlertRule] = ALERT_RULES) -> DataFrame:
    """At most one alert per key, rule and second."""
    return fired_alerts(df, rules).select(key, "rule", "severity", "message", "second").distinct()


def window_summary(df: DataFrame, keys: Sequence[str], window: Column) -> DataFrame:
    """CPU and memory means and peaks, ticks and health per key and time window."""
    ok = healthy(F.col("cpu_percent"), F.col("memory_percent"), F.col("disk_percent"))
    return df.groupBy(*keys, window.alias("window")).agg(
        F.avg("cpu_percent").alias("cpu_avg"),
        F.max("cpu_percent").alias("cpu_peak"),
        F.avg("memory_percent").alias("memory_avg"),
        F.max("memory_percent").alias("memory_peak"),
        F.count(F.lit(1)).alias("ticks"),
        F.every(ok).alias("healthy"),
    )


def level_counts(df: DataFrame, keys: Sequence[str], window: Column) -> DataFrame:
    return df.groupBy(*keys, window.alias("window"), memory_level(F.col("utilization")).alias("level")).agg(
        F.count(F.lit(1)).alias("ticks")
    )


def level_changes(df: DataFrame, keys: Sequence[str], tick: Column, slices: int | None = None) -> DataFrame:
    """Times at which the level of a key's peak utilisation per tick changed.

    Ticks are put in even slices of time.  A slice is summed up by its first and its
    last level and the changes inside; summaries are combined in the order of slices,
    so a key of any length is worked on by many tasks.
    """
    ticks = df.groupBy(*keys, tick.alias("tick")).agg(F.max("utilization").alias("utilization"))
    levels = ticks.select(*keys, "tick", memory_level(F.col("utilization")).alias("level"))
    sliced = ordered_slices(levels, keys, ["tick"], slices)
    inside = Window.partitionBy(*keys, SLICE).orderBy("tick")
    within = sliced.withColumn("previous_level", F.lag("level").over(inside)).where("previous_level <> level")
    ends = F.struct("tick", "level")
    summaries = sliced.groupBy(*keys, SLICE).agg(F.min(ends).alias("first"), F.max(ends).alias("last"))
    before = F.lag("last").over(Window.partitionBy(*keys).orderBy(SLICE))
    seams = summaries.withColumn("before", before).where(F.col("before.level") != F.col("first.level"))
    across = seams.select(*keys, F.col("first.tick").alias("tick"), F.col("before.level").alias("previous_level"), F.col("first.level").alias("level"))
    return within.select(*keys, "tick", "previous_level", "level").unionByName(across)


def status_panel(latest: DataFrame, limit: float = 80.0) -> DataFrame:
    """Alert or normal flag of the latest readings."""
    def flag(c):
        return F.when(F.col(c) > limit, "alert").otherwise("normal")

    return latest.withColumn("cpu_flag", flag("cpu_percent")).withColumn("memory_flag", flag("memory_percent"))


class ScalingPolicy(NamedTuple):
    """When to add or remove a replica. The numbers are fixed values."""

    high_load: float = 0.8
    high_response_s: float = 5.0
    low_load: float = 0.3
    low_response_s: float = 1.0
    min_replicas: int = 1
    max_replicas: int = 10
    cooldown_s: float = 300.0


def scaling_ticks(df: DataFrame, keys: Sequence[str], every_s: int = 30) -> DataFrame:
    """Mean load and response time per key and tick of ``every_s`` seconds."""
    second = F.unix_seconds(F.col("ts").cast("timestamp"))
    tick = (F.floor(second / every_s) * every_s).alias("tick")
    return df.groupBy(*keys, tick).agg(
        (F.sum("cpu_percent") / F.count(F.lit(1)) / 100).alias("load"), F.avg("response_s").alias("response_s")
    )


def scale_steps(
    pdf: pd.DataFrame, replicas: int, changed_at: float, policy: ScalingPolicy
) -> tuple[pd.DataFrame, int, float]:
    """Walk ticks in time order from a state; return the changes and the new state."""
    pdf = pdf.sort_values("tick", kind="stable")
    rows = []
    for row in pdf.itertuples(index=False):
        if row.tick - changed_at < policy.cooldown_s:
            continue
        if replicas < policy.max_replicas and (row.load > policy.high_load or row.response_s > policy.high_response_s):
            step, action = 1, "up"
        elif replicas > policy.min_replicas and row.load < policy.low_load and row.response_s < policy.low_response_s:
            step, action = -1, "down"
        else:
            continue
        replicas, changed_at = replicas + step, row.tick
        rows.append((int(row.tick), action, replicas))
    return pd.DataFrame(rows, columns=["tick", "action", "replicas"]), replicas, float(changed_at)


def scaling_decisions(ticks: DataFrame, key: str, policy: ScalingPolicy = ScalingPolicy()) -> DataFrame:
    """Scaling changes per key with a cooldown between them.

    Each decision depends on the one before, so a key is walked in order; its
    ticks are already averaged, which bounds them by elapsed time.
    """
    kind = ticks.schema[key].dataType.simpleString()

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        changes, _, _ = scale_steps(pdf, policy.min_replicas, float("-inf"), policy)
        changes.insert(0, key, pdf[key].iloc[0])
        return changes

    return ticks.groupBy(key).applyInPandas(walk, f"{key} {kind}, tick bigint, action string, replicas int")


def performance_by_period(df: DataFrame, period: str) -> DataFrame:
    """Responses with the start of their day, week or month."""
    return df.withColumn("period", F.to_date(F.date_trunc(period, "ts")))

