"""Summaries of responses that can be stored per day and united per week, month or model.

A summary holds sums, peaks and two sketches, one of latencies (KLL, for quantiles) and
one of ids (HyperLogLog, for distinct counts).  Uniting summaries gives what one pass
over all their rows would give, for the sketches within their error, so a longer
period is read from daily rows and never from the log.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUANTILE_SIZE = 400  # of the KLL sketches: ranks within 0.7 % for 99 of 100 questions
RANK_ERROR = 0.02  # what callers may rely on
DISTINCT_SIZE = 14  # registers of the HyperLogLog sketches, as a power of two: a standard error of 0.8 %
DISTINCT_ERROR = 0.04
SUMMARY = ("responses", "timed", "tokens_per_second_sum", "latency_sum", "memory_usage_mb", "latencies", "ids")


def summaries(df: DataFrame, keys: Sequence[str], distinct: str = "sample_id") -> DataFrame:
    """One mergeable row per key; only latencies above 0 count as timed.  Works on streams as well."""
    latency = F.when(F.col("latency_s") > 0, F.col("latency_s"))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("responses"),
        F.count(latency).alias("timed"),
        F.sum("tokens_per_second").alias("tokens_per_second_sum"),
        F.coalesce(F.sum(latency), F.lit(0.0)).alias("latency_sum"),
        F.max("memory_usage_mb").alias("memory_usage_mb"),
        F.kll_sketch_agg_double(latency, QUANTILE_SIZE).alias("latencies"),
        F.hll_sketch_agg(F.col(distinct), DISTINCT_SIZE).alias("ids"),
    )


def united(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Summaries of fewer keys from summaries of more, combined before the shuffle like any sum."""
    return parts.groupBy(*keys).agg(
        F.sum("responses").alias("responses"),
        F.sum("timed").alias("timed"),
        F.sum("tokens_per_second_sum").alias("tokens_per_second_sum"),
        F.sum("latency_sum").alias("latency_sum"),
        F.max("memory_usage_mb").alias("memory_usage_mb"),
        F.kll_merge_agg_double("latencies").alias("latencies"),
        F.hll_union_agg("ids").alias("ids"),
    )


def figures(parts: DataFrame, quantiles: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Means, peak and throughput of summaries, exact; quantiles and distinct ids from the sketches.

    Quantiles are within ``RANK_ERROR`` of their rank, null without timed responses;
    the distinct count is within ``DISTINCT_ERROR`` of the true one.
    """
    keys = [c for c in parts.columns if c not in SUMMARY]
    timed = F.col("timed") > 0
    points = [
        F.when(timed, F.kll_sketch_get_quantile_double("latencies", F.lit(q))).alias(f"latency_p{round(q * 100)}") for q in quantiles
    ]
    return parts.select(
        *keys, "responses",
        (F.col("tokens_per_second_sum") / F.col("responses")).alias("tokens_per_second"),
        F.coalesce(F.try_divide("latency_sum", "timed"), F.lit(0.0)).alias("latency_avg"),
        "memory_usage_mb",
        F.coalesce(F.try_divide("responses", "latency_sum"), F.lit(0.0)).alias("throughput"),
        *points, F.hll_sketch_estimate("ids").alias("distinct_ids"),
    )


def rank_range(log: DataFrame, estimates: DataFrame, keys: Sequence[str], value: str, estimate: str) -> DataFrame:
    """``keys, low, high``: the share of a group's values below an estimate, and of those not above it."""
    met = log.join(estimates.select(*keys, estimate), list(keys))
    return met.groupBy(*keys).agg(
        (F.count_if(F.col(value) < F.col(estimate)) / F.count(value)).alias("low"),
        (F.count_if(F.col(value) <= F.col(estimate)) / F.count(value)).alias("high"),
    )
