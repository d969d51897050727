"""Run tables, model comparison, leaderboards and report rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions.sequence import with_row_number
from tallymark.operators import rollup


def bench_runs(
    responses: DataFrame,
    hosts: DataFrame | None = None,
    keys: Sequence[str] = ("model", "dataset", "day"),
    cpu: Column | None = None,
) -> DataFrame:
    """One row per run: performance, accuracy, efficiency and cost.

    CPU load is a column expression ``cpu`` of the responses, averaged in the same
    pass, or comes as ``cpu_avg`` per run key in ``hosts``.
    """
    keys = list(keys)
    perf = rollup.run_metrics(
        responses,
        keys,
        extra=(
            (F.count_if(F.col("correct")) / F.count(F.lit(1))).alias("accuracy"),
            F.max("ts").alias("ts"),
            (rollup.seconds_between(F.min("ts"), F.max("ts")) / 3600).alias("duration_h"),
            *([] if cpu is None else [F.avg(cpu).alias("cpu_avg")]),
        ),
    )
    if hosts is not None:
        perf = perf.join(hosts, keys)
    tps, mem = F.col("tokens_per_second"), F.col("memory_usage_mb")
    return perf.withColumns(
        {**rollup.efficiency_by_cpu(tps, mem, F.col("cpu_avg")), **rollup.cost_by_rental(tps, mem, F.col("duration_h"))}
    )


def leaderboard(df: DataFrame, metric: str, by: Sequence[str] = ("dataset",), name: str = "model") -> DataFrame:
    """Rank rows in each group by a metric, best first; cost ranks cheapest first.

    Takes rollup rows, one per model and group, so a group is as long as the
    list of models however many responses stand behind it.
    """
    ascending = metric.startswith("cost")
    order = F.col(metric).asc() if ascending else F.col(metric).desc()
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(order, name)))


def merge_by_model(opt: DataFrame, bench: DataFrame) -> DataFrame:
    """Best score, speed, memory, cost and datasets per model over both run kinds."""
    both = opt.select("model", "dataset", "best_score").unionByName(
        bench.select("model", "dataset", "tokens_per_second", "memory_usage_mb", "cost_per_1k_tokens_usd"),
        allowMissingColumns=True,
    )
    return both.groupBy("model").agg(
        F.greatest(F.coalesce(F.max("best_score"), F.lit(0.0)), F.lit(0.0)).alias("best_score"),
        F.greatest(F.coalesce(F.max("tokens_per_second"), F.lit(0.0)), F.lit(0.0)).alias("best_speed"),
        F.min("memory_usage_mb").alias("min_memory"),
        F.min("cost_per_1k_tokens_usd").alias("min_cost"),
        F.countDistinct(F.when(F.col("dataset") != "", F.col("dataset"))).alias("datasets"),
    )


def _floor0(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.coalesce(value, F.lit(0.0)))


def comparison_vector(merged: DataFrame) -> DataFrame:
    """Five scores from 0 to 1 per model; missing memory or cost scores 0."""
    return merged.select(
        "model",
        F.col("best_score").alias("accuracy"),
        F.least(F.col("best_speed") / 100, F.lit(1.0)).alias("speed"),
        _floor0(1.0 - F.col("min_memory") / 10000).alias("memory"),
        _floor0(1.0 - F.col("min_cost") * 10000).alias("cost"),
        F.least(F.col("datasets") / 5, F.lit(1.0)).alias("versatility"),
    )


def efficiency_score(tps: Column, memory_mb: Column, cost_per_1k: Column, p95: Column) -> Column:
    return (
        F.least(tps / 100, F.lit(1.0)) * 0.3
        + F.greatest(F.lit(0.0), 1.0 - memory_mb / 10000) * 0.25
        + F.greatest(F.lit(0.0), 1.0 - cost_per_1k * 10000) * 0.25
        + F.greatest(F.lit(0.0), 1.0 - p95) * 0.2
    )


def report_summary(runs: DataFrame) -> DataFrame:
    """Best and mean score, fastest and mean speed and counts, in one pass.

    ``runs`` is the union of both run kinds; ties go to the smallest run id.
    """
    opt, bench = F.col("run_type") == "optimize", F.col("run_type") == "benchmark"
    best = F.struct(-F.col("best_score"), F.col("run_id"))
    fast = F.struct(-F.col("tokens_per_second"), F.col("run_id"))
    return runs.agg(
        F.count_if(opt).alias("optimizations"),
        F.count_if(bench).alias("benchmarks"),
        F.max(F.when(opt, F.col("best_score"))).alias("best_score"),
        F.min_by("model", F.when(opt, best)).alias("best_model"),
        F.avg(F.when(opt, F.col("best_score"))).alias("average_score"),
        F.max(F.when(bench, F.col("tokens_per_second"))).alias("fastest_speed"),
        F.min_by("model", F.when(bench, fast)).alias("fastest_model"),
        F.avg(F.when(bench, F.col("tokens_per_second"))).alias("average_speed"),
    )


def best_per_model(opt: DataFrame) -> DataFrame:
    return opt.groupBy("model").agg(F.max("best_score").alias("best_score"))


def score_series(runs: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Runs in time order with a sequence number from 0 per group."""
    return with_row_number(runs, keys, order, "_n").withColumn("sequence", F.col("_n") - 1).drop("_n")


def hardware_matrix(hosts: DataFrame) -> DataFrame:
    """Metric rows by model: mean CPU, memory peak, GPU peak (0 where none)."""
    return hosts.select(
        "model",
        F.explode(
            F.create_map(
                F.lit("cpu_avg"), F.coalesce("cpu_avg", F.lit(0.0)),
                F.lit("memory_peak"), F.coalesce("memory_peak", F.lit(0.0)),
                F.lit("gpu_memory_peak"), F.coalesce("gpu_memory_peak", F.lit(0.0)),
            )
        ).alias("metric", "value"),
    )


def parameter_correlation(opt: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Correlation of temperature and top_p with the score and each other."""
    return opt.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"),
        F.corr("temperature", "best_score").alias("temperature_score"),
        F.corr("top_p", "best_score").alias("top_p_score"),
        F.corr("temperature", "top_p").alias("temperature_top_p"),
    )


def filter_runs(runs: DataFrame, models: Sequence[str] = (), datasets: Sequence[str] = ()) -> DataFrame:
    """Runs of the named models and datasets; an empty list keeps all."""
    if models:
        runs = runs.where(F.col("model").isin(*models))
    if datasets:
        runs = runs.where(F.col("dataset").isin(*datasets))
    return runs


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Values of the newest row per key, combined before the shuffle."""
    newest = F.max(F.struct(*order, *[c for c in columns if c not in order])).alias("_r")
    return df.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in columns])


def last_n_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, since: Column | None = None, ts: str = "ts"
) -> DataFrame:
    """Newest ``n`` rows per key, inside a time range if one is given."""
    if since is not None:
        df = df.where(F.col(ts) >= since)
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)
