"""Quality, latency, throughput, efficiency and cost per group.

Every aggregate is combined on the map side first; percentiles come from
``order_statistics`` and join the other aggregates as one row per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.order_stats import order_statistics
from tallymark.operators.joins import null_safe_join

TAIL = {"latency_p95": 0.95, "latency_p99": 0.99}
POINTS = {"latency_p50": 0.5, **TAIL}


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(first: Column, last: Column) -> Column:
    return (micros(last) - micros(first)) / 1_000_000


def spread(score: str) -> Column:
    """Population standard deviation, 0 for fewer than two scores."""
    return F.when(F.count(score) > 1, F.stddev_pop(score)).otherwise(0.0)


def consistency(score: str) -> Column:
    """1 minus the spread against its largest possible value of one half."""
    return F.when(F.count(score) < 2, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - F.stddev_pop(score) / 0.5))


def evaluation_rollup(
    df: DataFrame, keys: Sequence[str], score: str = "score", correct: str = "correct", failed_as_zero: bool = False
) -> DataFrame:
    """Accuracy, mean and spread of scores, size and error rate per group.

    The error rate is the share of rows without a score.  ``failed_as_zero``
    counts such rows as score 0, which keeps the error rate at 0.
    """
    if failed_as_zero:
        df = df.withColumn(score, F.coalesce(F.col(score), F.lit(0.0)))
    n = F.count(F.lit(1))
    return df.groupBy(*keys).agg(
        (F.count_if(F.col(correct)) / n).alias("accuracy"),
        F.coalesce(F.avg(score), F.lit(0.0)).alias("average_score"),
        spread(score).alias("std_score"),
        n.alias("total_samples"),
        (1.0 - F.count(score) / n).alias("error_rate"),
    )


def with_expected(rollup: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rollup with a row for every expected group; empty ones count as failed."""
    defaults = {"accuracy": 0.0, "average_score": 0.0, "std_score": 0.0, "total_samples": 0, "error_rate": 1.0}
    out = expected.select(*keys).join(rollup, list(keys), "left")
    return out.na.fill({c: v for c, v in defaults.items() if c in rollup.columns})


def latency_block(
    df: DataFrame, keys: Sequence[str], latency: str = "latency_s", method: str = "linear"
) -> DataFrame:
    """Mean, interpolated tail and throughput over latencies above 0."""
    timed = df.where(F.col(latency) > 0)
    means = timed.groupBy(*keys).agg(F.avg(latency).alias("avg_latency"), (1.0 / F.avg(latency)).alias("throughput"))
    return null_safe_join(means, order_statistics(timed, keys, latency, TAIL, method), keys)


def optional_means(df: DataFrame, keys: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """Means over the rows that have a value."""
    return df.groupBy(*keys).agg(*[F.avg(c).alias(name) for c, name in columns.items()])


def simple_rollup(df: DataFrame, keys: Sequence[str], score: str = "score", correct: str = "correct") -> DataFrame:
    """Accuracy, mean score over all rows (failed rows as 0) and counts."""
    n = F.count(F.lit(1))
    return df.groupBy(*keys).agg(
        (F.count_if(F.col(correct)) / n).alias("accuracy"),
        (F.coalesce(F.sum(score), F.lit(0.0)) / n).alias("average_score"),
        n.alias("total_samples"),
        F.count_if(F.col(correct)).alias("correct_count"),
    )


def index_percentiles(df: DataFrame, keys: Sequence[str], latency: str = "latency_s") -> DataFrame:
    """p50, p95 and p99 by rank floor(n * p), without interpolation."""
    return order_statistics(df, keys, latency, POINTS, method="index")


def iteration_metrics(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Speed, memory, wall-clock throughput and index percentiles per iteration."""
    wall = seconds_between(F.min("ts"), F.max("ts"))
    base = df.groupBy(*keys).agg(
        F.avg("tokens_per_second").alias("tokens_per_second"),
        F.max("memory_usage_mb").alias("memory_usage_mb"),
        F.when(wall > 0, F.count(F.lit(1)) / wall).otherwise(0.0).alias("throughput"),
    )
    return null_safe_join(base, index_percentiles(df, keys), keys)


def across_iterations(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean of per-iteration values, largest memory; zeros where none."""
    names = ["tokens_per_second", "latency_p50", "latency_p95", "latency_p99", "throughput"]
    out = metrics.groupBy(*keys).agg(
        *[F.avg(c).alias(c) for c in names], F.max("memory_usage_mb").alias("memory_usage_mb")
    )
    return out.na.fill(0.0)


def run_metrics(df: DataFrame, keys: Sequence[str], extra: Sequence[Column] = ()) -> DataFrame:
    """Speed, latency, memory and throughput of a run over all its responses."""
    latency = F.when(F.col("latency_s") > 0, F.col("latency_s"))
    base = df.groupBy(*keys).agg(
        F.avg("tokens_per_second").alias("tokens_per_second"),
        F.coalesce(F.avg(latency), F.lit(0.0)).alias("latency_avg"),
        F.max("memory_usage_mb").alias("memory_usage_mb"),
        F.coalesce(F.try_divide(F.count(F.lit(1)), F.sum(latency)), F.lit(0.0)).alias("throughput"),
        *extra,
    )
    points = order_statistics(df.where(F.col("latency_s") > 0), keys, "latency_s", POINTS)
    return null_safe_join(base, points, keys, "left").na.fill(0.0, list(POINTS))


def mean_accuracy(df: DataFrame, keys: Sequence[str], iteration: str, correct: str = "correct") -> DataFrame:
    """Mean over iterations of the share of correct rows."""
    per = df.groupBy(*keys, iteration).agg((F.count_if(F.col(correct)) / F.count(F.lit(1))).alias("_a"))
    return per.groupBy(*keys).agg(F.avg("_a").alias("accuracy"))


def batch_stats(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tokens, tokens per second, peak memory, throughput and outcome counts of a batch."""
    ok = ~F.col("error")
    wall = seconds_between(F.min("ts"), F.max("ts"))
    tokens = F.coalesce(F.sum(F.when(ok, F.col("output_tokens"))), F.lit(0))
    return df.groupBy(*keys).agg(
        tokens.alias("total_tokens"),
        F.when(wall > 0, tokens / wall).otherwise(0.0).alias("avg_tokens_per_second"),
        F.max("memory_usage_mb").alias("peak_memory_usage"),
        wall.alias("total_latency"),
        F.when(wall > 0, F.count_if(ok) / wall).otherwise(0.0).alias("throughput"),
        F.count_if(ok).alias("success_count"),
        F.count_if(F.col("error")).alias("error_count"),
    )


def weighted_score(df: DataFrame, keys: Sequence[str], batch: str, correct: str = "correct") -> DataFrame:
    """Accuracy of batches weighted by their size, beside the plain accuracy."""
    per = df.groupBy(*keys, batch).agg(
        F.count(F.lit(1)).alias("_n"), (F.count_if(F.col(correct)) / F.count(F.lit(1))).alias("_a")
    )
    return per.groupBy(*keys).agg(
        F.coalesce(F.try_divide(F.sum(F.col("_a") * F.col("_n")), F.sum("_n")), F.lit(0.0)).alias("score"),
        F.sum("_n").alias("total_samples"),
        F.count(F.lit(1)).alias("batches"),
    )


def power_watts(cpu_avg: Column) -> Column:
    return 50 + cpu_avg / 100 * 150


def efficiency_by_power(tps: Column, memory_mb: Column, power: Column) -> dict[str, Column]:
    return {
        "tokens_per_watt": tps / F.greatest(power, F.lit(1.0)),
        "memory_efficiency": tps / F.greatest(memory_mb, F.lit(1.0)),
        "overall_efficiency": tps / F.greatest(power * memory_mb / 1000, F.lit(1.0)),
    }


def efficiency_by_cpu(tps: Column, memory_mb: Column, cpu_avg: Column) -> dict[str, Column]:
    return {
        "tokens_per_mb": F.when(memory_mb > 0, tps / memory_mb).otherwise(0.0),
        "memory_efficiency": F.when(memory_mb > 0, tps / (memory_mb / 1024)).otherwise(0.0),
        "cpu_efficiency": tps / F.greatest(cpu_avg, F.lit(1.0)),
        "overall_efficiency": tps / F.greatest(memory_mb * cpu_avg / 1000, F.lit(1.0)),
    }


def cost_by_power(tps: Column, memory_mb: Column, power: Column) -> dict[str, Column]:
    per_hour = power / 1000 * 0.1 + memory_mb / 1024 * 0.01
    per_token = F.when(tps > 0, per_hour / (tps * 3600)).otherwise(0.0)
    return {
        "cost_per_hour_usd": per_hour,
        "cost_per_token_usd": per_token,
        "cost_per_1k_tokens_usd": per_token * 1000,
        "estimated_monthly_cost_usd": per_hour * 24 * 30,
    }


def cost_by_rental(tps: Column, memory_mb: Column, duration_h: Column) -> dict[str, Column]:
    per_hour = 0.5 + memory_mb / 1024 * 0.01
    tokens = tps * duration_h * 3600
    per_token = F.when(tokens > 0, per_hour * duration_h / tokens).otherwise(0.0)
    return {
        "cost_per_hour_usd": per_hour,
        "cost_per_token_usd": per_token,
        "cost_per_1k_tokens_usd": per_token * 1000,
        "estimated_monthly_cost_usd": per_hour * 24 * 30,
    }


def host_summary(df: DataFrame, keys: Sequence[str], elapsed: str | None = None) -> DataFrame:
    """CPU, memory and GPU means and peaks; GPU only where any reading is not 0.

    Duration is last minus first tick, or the last value of ``elapsed``.
    """
    duration = F.max(elapsed) if elapsed else seconds_between(F.min("ts"), F.max("ts"))
    gpu = F.coalesce(F.col("gpu_memory_gb"), F.lit(0.0))
    used = F.max((gpu != 0).cast("int")) == 1
    return df.groupBy(*keys).agg(
        F.avg("cpu_percent").alias("cpu_avg"),
        F.max("cpu_percent").alias("cpu_peak"),
        F.avg("memory_percent").alias("memory_avg"),
        F.max("memory_percent").alias("memory_peak"),
        duration.alias("duration"),
        F.when(used, F.avg(gpu)).alias("gpu_memory_avg"),
        F.when(used, F.max(gpu)).alias("gpu_memory_peak"),
    )


def memory_growth(df: DataFrame, keys: Sequence[str], order: Column, tolerance_mb: float = 50.0) -> DataFrame:
    """Last minus first resident size, flagged above a tolerance."""
    out = df.groupBy(*keys).agg(
        F.min_by("rss_mb", order).alias("initial_memory_mb"), F.max_by("rss_mb", order).alias("current_memory_mb")
    )
    increase = F.col("current_memory_mb") - F.col("initial_memory_mb")
    return out.withColumns(
        {
            "increase_mb": increase,
            "tolerance_mb": F.lit(tolerance_mb),
            "has_leak": increase > tolerance_mb,
            "leak_percentage": F.when(
                F.col("initial_memory_mb") > 0, increase / F.col("initial_memory_mb") * 100
            ).otherwise(0.0),
        }
    )


def success_rate(df: DataFrame, keys: Sequence[str], error: str = "error") -> DataFrame:
    n = F.count(F.lit(1))
    return df.groupBy(*keys).agg(
        F.count_if(~F.col(error)).alias("total_results"),
        F.count_if(F.col(error)).alias("total_exceptions"),
        (F.count_if(~F.col(error)) / n).alias("success_rate"),
    )


def task_stats(df: DataFrame, now: Column, max_age_s: float = 3600) -> DataFrame:
    """Open tasks by executor type and finished ones by state, up to an age."""
    open_task = F.col("state").isin("pending", "running")
    age = seconds_between(F.col("completed_at"), now)
    fresh = ~open_task & F.col("completed_at").isNotNull() & (age <= max_age_s) & (age >= 0)
    return (
        df.where(open_task | fresh)
        .groupBy(
            F.when(open_task, "active").otherwise("completed").alias("status"),
            F.when(open_task, F.col("executor_type")).otherwise(F.col("state")).alias("kind"),
        )
        .agg(F.count(F.lit(1)).alias("tasks"))
    )
