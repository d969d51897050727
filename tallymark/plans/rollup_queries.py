"""Rollups over responses, hosts, tasks and errors (aggregations)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.operators import rollup as ro, sketches
from tallymark.operators.compare import (
    bench_runs, comparison_vector, efficiency_score, leaderboard, merge_by_model, report_summary,
)
from tallymark.operators.errors import classify, error_stats
from tallymark.operators.trials import best_trial, study_summary
from tallymark.plans.registry import query, rounded
from tallymark.sources import views

RUN = ["model", "dataset"]


def scored(spark, d):
    return views.scored(spark, d).withColumn("correct", F.coalesce(F.col("score") > 0.8, F.lit(False)))


def cpu_load():
    """CPU load of the host while it answered, from the response's latency."""
    return F.least(F.lit(100.0), F.col("latency_s") * 100)


def bench(spark, d):
    """Benchmark run rows built from the response log."""
    return bench_runs(scored(spark, d), cpu=cpu_load())


def opt(spark, d):
    """Optimization run rows built from the trial log."""
    best = best_trial(views.trials(spark, d), ["study", "model", "dataset"])
    return best.withColumn("run_id", F.concat(F.lit("opt_"), F.col("study")))


EVAL = """
    count(*) FILTER (score > 0.8) / count(*) AS accuracy, coalesce(avg(score), 0) AS average_score,
    CASE WHEN count(score) > 1 THEN stddev_pop(score) ELSE 0 END AS std_score, count(*) AS total_samples,
    1 - count(score) / count(*) AS error_rate"""


@query(
    "flagship_leaderboard",
    """SELECT model, dataset, round(accuracy, 6) AS accuracy, round(tokens_per_second, 6) AS tokens_per_second,
              round(latency_avg, 6) AS latency_avg, round(latency_p50, 6) AS latency_p50,
              round(latency_p95, 6) AS latency_p95, round(latency_p99, 6) AS latency_p99,
              round(throughput, 6) AS throughput, memory_usage_mb, round(cost_per_hour_usd, 6) AS cost_per_hour_usd,
              round(cost_per_1k_tokens_usd, 6) AS cost_per_1k_tokens_usd,
              round(overall_efficiency, 6) AS overall_efficiency,
              row_number() OVER (PARTITION BY dataset ORDER BY accuracy DESC, model)::INTEGER AS "rank"
       FROM (SELECT *, CASE WHEN tokens > 0 THEN cost_per_hour_usd * duration_h / tokens * 1000 ELSE 0 END
                        AS cost_per_1k_tokens_usd
             FROM (SELECT *, tokens_per_second / greatest(memory_usage_mb * cpu_avg / 1000, 1) AS overall_efficiency,
                          0.5 + memory_usage_mb / 1024 * 0.01 AS cost_per_hour_usd,
                          tokens_per_second * duration_h * 3600 AS tokens
                   FROM (SELECT model, dataset, avg(tokens_per_second) AS tokens_per_second,
                                avg(latency_s) FILTER (latency_s > 0) AS latency_avg,
                                max(memory_usage_mb) AS memory_usage_mb,
                                count(*) / sum(latency_s) FILTER (latency_s > 0) AS throughput,
                                count(*) FILTER (score > 0.8) / count(*) AS accuracy,
                                (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000 / 3600 AS duration_h,
                                avg(least(100.0::DOUBLE, latency_s * 100)) AS cpu_avg,
                                quantile_cont(latency_s, 0.5) FILTER (latency_s > 0) AS latency_p50,
                                quantile_cont(latency_s, 0.95) FILTER (latency_s > 0) AS latency_p95,
                                quantile_cont(latency_s, 0.99) FILTER (latency_s > 0) AS latency_p99
                         FROM scored GROUP BY model, dataset)))""",
)
def flagship(spark, d):
    """Which model is best per dataset, and what does it cost?"""
    runs = bench_runs(scored(spark, d), keys=RUN, cpu=cpu_load())
    ranked = leaderboard(runs, "accuracy")
    return rounded(
        ranked.select(
            *RUN, "accuracy", "tokens_per_second", "latency_avg", "latency_p50", "latency_p95", "latency_p99",
            "throughput", "memory_usage_mb", "cost_per_hour_usd", "cost_per_1k_tokens_usd", "overall_efficiency", "rank",
        )
    )


@query(
    "a1_evaluation_rollup",
    f"""SELECT model, dataset, round(accuracy, 6) AS accuracy, round(average_score, 6) AS average_score,
               round(std_score, 6) AS std_score, total_samples, round(error_rate, 6) AS error_rate
        FROM (SELECT model, dataset, {EVAL} FROM scored GROUP BY model, dataset)""",
)
def a1(spark, d):
    return rounded(ro.evaluation_rollup(scored(spark, d), RUN))


@query(
    "a1_evaluation_rollup_failed_as_zero",
    """SELECT model, dataset, round(count(*) FILTER (score > 0.8) / count(*), 6) AS accuracy,
              round(avg(coalesce(score, 0)), 6) AS average_score,
              round(stddev_pop(coalesce(score, 0)), 6) AS std_score, count(*) AS total_samples,
              0.0::DOUBLE AS error_rate
       FROM scored GROUP BY model, dataset""",
)
def a1_parity(spark, d):
    return rounded(ro.evaluation_rollup(scored(spark, d), RUN, failed_as_zero=True))


@query(
    "a2_expected_groups",
    f"""SELECT model, dataset, day, round(coalesce(accuracy, 0), 6) AS accuracy,
               round(coalesce(average_score, 0), 6) AS average_score, round(coalesce(std_score, 0), 6) AS std_score,
               coalesce(total_samples, 0) AS total_samples, round(coalesce(error_rate, 1), 6) AS error_rate
        FROM (SELECT model, dataset, day
              FROM (SELECT DISTINCT model, dataset FROM responses),
                   (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM responses))
        LEFT JOIN (SELECT model, dataset, day, {EVAL} FROM scored GROUP BY model, dataset, day)
        USING (model, dataset, day)""",
)
def a2(spark, d):
    """A row per model, dataset and day from the log's first to its last, with or without rows."""
    s = scored(spark, d)
    first, last = s.agg(F.min("day"), F.max("day")).first()
    days = F.sequence(F.lit(first), F.lit(last)) if first else F.array().cast("array<date>")
    keys = [*RUN, "day"]
    expected = s.select(*RUN).distinct().withColumn("day", F.explode(days))
    return rounded(ro.with_expected(ro.evaluation_rollup(s, keys), expected, keys))


@query(
    "a3_latency_block",
    """SELECT model, dataset, round(avg(latency_s), 6) AS avg_latency, round(1 / avg(latency_s), 6) AS throughput,
              round(quantile_cont(latency_s, 0.95), 6) AS latency_p95, round(quantile_cont(latency_s, 0.99), 6) AS latency_p99
       FROM responses WHERE latency_s > 0 GROUP BY model, dataset""",
)
def a3(spark, d):
    return rounded(ro.latency_block(views.responses(spark, d), RUN))


@query(
    "a3_sketch_rollup",
    """SELECT model, dataset, count(*) AS responses, round(avg(latency_s) FILTER (latency_s > 0), 6) AS latency_avg,
              round(count(*) / sum(latency_s) FILTER (latency_s > 0), 6) AS throughput, true AS p95_within, true AS p99_within,
              true AS distinct_within
       FROM responses GROUP BY model, dataset""",
)
def a3_sketches(spark, d):
    """Daily summaries united by model and dataset, and whether their sketches keep to their error on the whole log."""
    log = views.responses(spark, d)
    daily = sketches.summaries(log, [*RUN, "day"])
    out = sketches.figures(sketches.united(daily, RUN))
    timed = log.where(F.col("latency_s") > 0).select(*RUN, "latency_s")
    for name, rank in (("p95", 0.95), ("p99", 0.99)):
        share = sketches.rank_range(timed, out, RUN, "latency_s", f"latency_{name}")
        near = (F.col("low") - sketches.RANK_ERROR <= rank) & (F.col("high") + sketches.RANK_ERROR >= rank)
        out = out.join(share.select(*RUN, near.alias(f"{name}_within")), RUN)
    seen = log.select(*RUN, "sample_id").distinct().groupBy(*RUN).agg(F.count(F.lit(1)).alias("seen"))
    near = F.abs(F.col("distinct_ids") - F.col("seen")) <= F.greatest(F.lit(1.0), F.col("seen") * sketches.DISTINCT_ERROR)
    out = out.join(seen, RUN).withColumn("distinct_within", near)
    return rounded(out.select(*RUN, "responses", "latency_avg", "throughput", "p95_within", "p99_within", "distinct_within"))


@query(
    "a4_optional_means",
    """SELECT model, dataset, round(avg(output_tokens / latency_s) FILTER (NOT error AND latency_s > 0), 6) AS avg_token_efficiency,
              round(avg(score), 6) AS avg_confidence
       FROM scored GROUP BY model, dataset""",
)
def a4(spark, d):
    s = scored(spark, d).withColumn("efficiency", F.when(~F.col("error") & (F.col("latency_s") > 0), F.col("output_tokens") / F.col("latency_s")))
    return rounded(ro.optional_means(s, RUN, {"efficiency": "avg_token_efficiency", "score": "avg_confidence"}))


@query(
    "a5_consistency",
    """SELECT model, dataset,
              round(CASE WHEN count(score) < 2 THEN 1 ELSE greatest(0, 1 - stddev_pop(score) / 0.5) END, 6)
                  AS consistency_score
       FROM scored GROUP BY model, dataset""",
)
def a5(spark, d):
    return rounded(scored(spark, d).groupBy(*RUN).agg(ro.consistency("score").alias("consistency_score")))


@query(
    "a6_simple_rollup",
    """SELECT model, dataset, round(count(*) FILTER (score > 0.8) / count(*), 6) AS accuracy,
              round(coalesce(sum(score), 0) / count(*), 6) AS average_score, count(*) AS total_samples,
              count(*) FILTER (score > 0.8) AS correct_count
       FROM scored GROUP BY model, dataset""",
)
def a6(spark, d):
    return rounded(ro.simple_rollup(scored(spark, d), RUN))


INDEX = """round(s[least(floor(n * 0.5), n - 1)::INT + 1], 6) AS latency_p50,
           round(s[least(floor(n * 0.95::DOUBLE), n - 1)::INT + 1], 6) AS latency_p95,
           round(s[least(floor(n * 0.99::DOUBLE), n - 1)::INT + 1], 6) AS latency_p99"""


@query(
    "a7_index_percentiles",
    f"""SELECT model, dataset, {INDEX}
        FROM (SELECT model, dataset, list(latency_s ORDER BY latency_s) AS s, count(*) AS n
              FROM responses GROUP BY model, dataset)""",
)
def a7(spark, d):
    return rounded(ro.index_percentiles(views.responses(spark, d), RUN))


ITERATION = f"""
    SELECT model, dataset, day, round(tps, 6) AS tokens_per_second, mem AS memory_usage_mb,
           round(CASE WHEN wall > 0 THEN n / wall ELSE 0 END, 6) AS throughput, {INDEX}
    FROM (SELECT model, dataset, day, avg(tokens_per_second) AS tps, max(memory_usage_mb) AS mem, count(*) AS n,
                 (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000 AS wall, list(latency_s ORDER BY latency_s) AS s
          FROM responses GROUP BY model, dataset, day)"""


@query("a8_iteration_metrics", ITERATION)
def a8(spark, d):
    return rounded(ro.iteration_metrics(views.responses(spark, d), [*RUN, "day"]))


@query(
    "a9_across_iterations",
    f"""SELECT model, dataset, round(avg(tokens_per_second), 4) AS tokens_per_second,
               round(avg(latency_p50), 4) AS latency_p50, round(avg(latency_p95), 4) AS latency_p95,
               round(avg(latency_p99), 4) AS latency_p99, round(avg(throughput), 4) AS throughput,
               max(memory_usage_mb) AS memory_usage_mb
        FROM ({ITERATION}) GROUP BY model, dataset""",
)
def a9(spark, d):
    per = ro.iteration_metrics(views.responses(spark, d), [*RUN, "day"])
    return rounded(ro.across_iterations(per, RUN), 4)


@query(
    "a10_run_metrics",
    """SELECT model, dataset, round(tps, 6) AS tokens_per_second, round(lat, 6) AS latency_avg, mem AS memory_usage_mb,
              round(thr, 6) AS throughput, round(p50, 6) AS latency_p50, round(p95, 6) AS latency_p95,
              round(p99, 6) AS latency_p99, round(accuracy, 6) AS accuracy
       FROM (SELECT model, dataset, avg(tokens_per_second) AS tps, avg(latency_s) FILTER (latency_s > 0) AS lat,
                    max(memory_usage_mb) AS mem, count(*) / sum(latency_s) FILTER (latency_s > 0) AS thr,
                    quantile_cont(latency_s, 0.5) FILTER (latency_s > 0) AS p50,
                    quantile_cont(latency_s, 0.95) FILTER (latency_s > 0) AS p95,
                    quantile_cont(latency_s, 0.99) FILTER (latency_s > 0) AS p99
             FROM scored GROUP BY model, dataset)
       JOIN (SELECT model, dataset, avg(a) AS accuracy
             FROM (SELECT model, dataset, day, count(*) FILTER (score > 0.8) / count(*) AS a FROM scored GROUP BY ALL)
             GROUP BY model, dataset) USING (model, dataset)""",
)
def a10(spark, d):
    s = scored(spark, d)
    return rounded(ro.run_metrics(s, RUN).join(ro.mean_accuracy(s, RUN, "day"), RUN))


@query(
    "a11_batch_stats",
    """SELECT model, dataset, day, total_tokens, round(CASE WHEN w > 0 THEN total_tokens / w ELSE 0 END, 6)
                  AS avg_tokens_per_second, mem AS peak_memory_usage, round(w, 6) AS total_latency,
              round(CASE WHEN w > 0 THEN ok / w ELSE 0 END, 6) AS throughput, ok AS success_count, bad AS error_count
       FROM (SELECT model, dataset, day, coalesce(sum(output_tokens) FILTER (NOT error), 0)::BIGINT AS total_tokens,
                    max(memory_usage_mb) AS mem, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000 AS w,
                    count(*) FILTER (NOT error) AS ok, count(*) FILTER (error) AS bad
             FROM responses GROUP BY model, dataset, day)""",
)
def a11(spark, d):
    return rounded(ro.batch_stats(views.responses(spark, d), [*RUN, "day"]))


@query(
    "a12_weighted_score",
    """SELECT model, dataset, round(count(*) FILTER (score > 0.8) / count(*), 6) AS score, count(*) AS total_samples,
              count(DISTINCT day) AS batches
       FROM scored GROUP BY model, dataset""",
)
def a12(spark, d):
    out = ro.weighted_score(scored(spark, d), RUN, "day")
    return rounded(out)


def run_with_hosts(spark, d):
    r = views.responses(spark, d)
    return r.groupBy(*RUN).agg(
        F.avg("tokens_per_second").alias("tokens_per_second"),
        F.max("memory_usage_mb").alias("memory_usage_mb"),
        F.avg(F.least(F.lit(100.0), F.col("latency_s") * 100)).alias("cpu_avg"),
        (ro.seconds_between(F.min("ts"), F.max("ts")) / 3600).alias("duration_h"),
    )


HOSTED = """(SELECT model, dataset, avg(tokens_per_second) AS tps, max(memory_usage_mb) AS mem,
                    avg(least(100.0::DOUBLE, latency_s * 100)) AS cpu,
                    (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000 / 3600 AS hours
             FROM responses GROUP BY model, dataset)"""


def _measures():
    return F.col("tokens_per_second"), F.col("memory_usage_mb"), F.col("cpu_avg")


def _with(df, columns):
    return rounded(df.select(*RUN, *[c.alias(n) for n, c in columns.items()]))


@query(
    "a13_efficiency_by_power",
    f"""SELECT model, dataset, round(power, 6) AS power_consumption, round(tps / greatest(power, 1), 6) AS tokens_per_watt,
               round(tps / greatest(mem, 1), 6) AS memory_efficiency,
               round(tps / greatest(power * mem / 1000, 1), 6) AS overall_efficiency
        FROM (SELECT *, 50 + cpu / 100 * 150 AS power FROM {HOSTED})""",
)
def a13(spark, d):
    tps, mem, cpu = _measures()
    power = ro.power_watts(cpu)
    columns = {"power_consumption": power, **ro.efficiency_by_power(tps, mem, power)}
    return _with(run_with_hosts(spark, d), columns)


@query(
    "a14_efficiency_by_cpu",
    f"""SELECT model, dataset, round(tps / mem, 6) AS tokens_per_mb, round(tps / (mem / 1024), 6) AS memory_efficiency,
               round(tps / greatest(cpu, 1), 6) AS cpu_efficiency,
               round(tps / greatest(mem * cpu / 1000, 1), 6) AS overall_efficiency
        FROM {HOSTED}""",
)
def a14(spark, d):
    return _with(run_with_hosts(spark, d), ro.efficiency_by_cpu(*_measures()))


@query(
    "a15_cost_by_power",
    f"""SELECT model, dataset, round(ph, 6) AS cost_per_hour_usd, round(ph / (tps * 3600), 6) AS cost_per_token_usd,
               round(ph / (tps * 3600) * 1000, 6) AS cost_per_1k_tokens_usd,
               round(ph * 24 * 30, 6) AS estimated_monthly_cost_usd
        FROM (SELECT *, (50 + cpu / 100 * 150) / 1000 * 0.1 + mem / 1024 * 0.01 AS ph FROM {HOSTED})""",
)
def a15(spark, d):
    tps, mem, cpu = _measures()
    return _with(run_with_hosts(spark, d), ro.cost_by_power(tps, mem, ro.power_watts(cpu)))


@query(
    "a16_cost_by_rental",
    f"""SELECT model, dataset, round(ph, 6) AS cost_per_hour_usd, round(ph * hours / (tps * hours * 3600), 6)
                   AS cost_per_token_usd,
               round(ph * hours / (tps * hours * 3600) * 1000, 6) AS cost_per_1k_tokens_usd,
               round(ph * 24 * 30, 6) AS estimated_monthly_cost_usd
        FROM (SELECT *, 0.5 + mem / 1024 * 0.01 AS ph FROM {HOSTED})""",
)
def a16(spark, d):
    tps, mem, _ = _measures()
    return _with(run_with_hosts(spark, d), ro.cost_by_rental(tps, mem, F.col("duration_h")))


@query(
    "a17_host_summary",
    """SELECT deployment, round(avg(cpu_percent), 6) AS cpu_avg, max(cpu_percent) AS cpu_peak,
              round(avg(memory_percent), 6) AS memory_avg, max(memory_percent) AS memory_peak,
              round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000, 6) AS duration,
              CASE WHEN max(gpu_memory_gb) <> 0 THEN round(avg(gpu_memory_gb), 6) END AS gpu_memory_avg,
              CASE WHEN max(gpu_memory_gb) <> 0 THEN max(gpu_memory_gb) END AS gpu_memory_peak
       FROM host_metrics GROUP BY deployment""",
)
def a17(spark, d):
    return rounded(ro.host_summary(views.host_metrics(spark, d), ["deployment"]))


MERGED = """(SELECT model, coalesce(max(best_score), 0) AS best_score, coalesce(max(tokens_per_second), 0) AS best_speed,
                    min(memory_usage_mb) AS min_memory, min(cost_per_1k_tokens_usd) AS min_cost,
                    count(DISTINCT dataset) AS datasets
             FROM (SELECT model, dataset, best_score, NULL AS tokens_per_second, NULL AS memory_usage_mb,
                          NULL AS cost_per_1k_tokens_usd FROM opt_runs
                   UNION ALL
                   SELECT model, dataset, NULL, tokens_per_second, memory_usage_mb, cost_per_1k_tokens_usd
                   FROM bench_runs) GROUP BY model)"""


@query(
    "a18_comparison_vector",
    f"""SELECT model, round(best_score, 6) AS accuracy, round(least(best_speed / 100, 1), 6) AS speed,
               round(greatest(0, 1 - min_memory / 10000), 6) AS memory,
               round(greatest(0, 1 - min_cost * 10000), 6) AS cost, round(least(datasets / 5, 1), 6) AS versatility
        FROM {MERGED}""",
)
def a18(spark, d):
    return rounded(comparison_vector(merge_by_model(opt(spark, d), bench(spark, d))))


@query(
    "a19_efficiency_score",
    """SELECT model, dataset, day, round(least(tokens_per_second / 100, 1) * 0.3 + greatest(0, 1 - memory_usage_mb / 10000) * 0.25
              + greatest(0, 1 - cost_per_1k_tokens_usd * 10000) * 0.25 + greatest(0, 1 - latency_p95) * 0.2, 6)
              AS efficiency_score
       FROM bench_runs""",
)
def a19(spark, d):
    tps, mem, _ = _measures()
    score = efficiency_score(tps, mem, F.col("cost_per_1k_tokens_usd"), F.col("latency_p95"))
    return rounded(bench(spark, d).select(*RUN, "day", score.alias("efficiency_score")))


def all_runs(spark, d):
    o = opt(spark, d).select("run_id", "model", "dataset", "best_score", F.lit("optimize").alias("run_type"))
    b = bench(spark, d).select(
        F.concat_ws("_", F.lit("bench"), "model", "dataset", "day").alias("run_id"), "model", "dataset",
        "tokens_per_second", F.lit("benchmark").alias("run_type"),
    )
    return o.unionByName(b, allowMissingColumns=True)


@query(
    "a20_report_summary",
    """SELECT o.n AS optimizations, b.n AS benchmarks, round(o.best_score, 6) AS best_score, o.best_model,
              round(o.average_score, 6) AS average_score, round(b.fastest_speed, 6) AS fastest_speed, b.fastest_model,
              round(b.average_speed, 6) AS average_speed
       FROM (SELECT count(*) AS n, max(best_score) AS best_score, avg(best_score) AS average_score,
                    (list(model ORDER BY best_score DESC, run_id))[1] AS best_model FROM opt_runs) o,
            (SELECT count(*) AS n, max(tokens_per_second) AS fastest_speed, avg(tokens_per_second) AS average_speed,
                    (list(model ORDER BY tokens_per_second DESC, 'bench_' || model || '_' || dataset || '_' || day))[1]
                        AS fastest_model FROM bench_runs) b""",
)
def a20(spark, d):
    return rounded(report_summary(all_runs(spark, d)))


def rules_sql():
    from tallymark.functions.lexicons import ERROR_PATTERNS
    from tallymark.plans.oracle_views import quoted

    body = ", ".join(f"({i}, {quoted(p)}, {quoted(c)}, {quoted(s)})" for i, (p, c, s, _) in enumerate(ERROR_PATTERNS))
    return f"(SELECT * FROM (VALUES {body}) AS t(priority, pattern, category, severity))"


INFERRED = """
    CASE WHEN contains(lower(message), 'memory') OR contains(lower(message), 'cuda') THEN 'memory'
         WHEN exception_type IN ('ImportError', 'ModuleNotFoundError') THEN 'dependency'
         WHEN exception_type IN ('OSError', 'ConnectionResetError', 'BrokenPipeError', 'PermissionError', 'FileNotFoundError',
                                 'TimeoutError', 'NotADirectoryError') THEN 'permission'
         WHEN contains(lower(message), 'config') OR contains(lower(message), 'setting') THEN 'configuration'
         WHEN contains(lower(message), 'model') OR contains(lower(message), 'load') THEN 'model_loading'
         WHEN contains(lower(message), 'network') OR contains(lower(message), 'connection') THEN 'network'
         ELSE 'unknown' END"""
SEVERITY = """
    CASE WHEN contains(lower(message), 'memory') OR contains(lower(message), 'permission denied') THEN 'high'
         WHEN exception_type IN ('ImportError', 'ModuleNotFoundError', 'ValueError', 'TypeError', 'JSONDecodeError',
                                 'UnicodeDecodeError') THEN 'medium' ELSE 'low' END"""
CLASSIFIED = f"""(
    SELECT error_id, ts, source, message, exception_type, resolved, pattern,
           coalesce(category, {INFERRED}) AS category, coalesce(severity, {SEVERITY}) AS severity
    FROM (SELECT e.*, p.pattern, p.category, p.severity
          FROM errors e LEFT JOIN {rules_sql()} p ON contains(lower(e.message), p.pattern)
          QUALIFY row_number() OVER (PARTITION BY error_id ORDER BY priority NULLS LAST) = 1))"""


ERROR_STATS = f"""
    WITH c AS (SELECT * FROM {CLASSIFIED})
    SELECT 'all' AS dimension, NULL AS value, count(*) AS errors, count(*) FILTER (resolved) AS resolved_count FROM c
    UNION ALL SELECT 'category', category, count(*), count(*) FILTER (resolved) FROM c GROUP BY category
    UNION ALL SELECT 'severity', severity, count(*), count(*) FILTER (resolved) FROM c GROUP BY severity"""


@query("a21_error_stats", ERROR_STATS)
def a21(spark, d):
    return error_stats(classify(views.errors(spark, d)))


@query(
    "a22_task_stats",
    """SELECT CASE WHEN state IN ('running', 'pending') THEN 'active' ELSE 'completed' END AS status,
              CASE WHEN state IN ('running', 'pending') THEN executor_type ELSE state END AS kind, count(*) AS tasks
       FROM task_log
       WHERE state IN ('running', 'pending')
          OR (completed_at <= (SELECT max(completed_at) FROM task_log)
              AND completed_at >= (SELECT max(completed_at) FROM task_log) - INTERVAL 4000 HOURS)
       GROUP BY ALL""",
)
def a22(spark, d):
    log = views.task_log(spark, d)
    # one row beside every task: no value passes through the driver
    newest = log.agg(F.max("completed_at").alias("now"), F.lit(0).alias("all"))
    dated = log.withColumn("all", F.lit(0)).join(F.broadcast(newest), "all")
    return ro.task_stats(dated, F.col("now"), max_age_s=4000 * 3600)


@query(
    "a23_study_summary",
    """SELECT study, count(*) AS n_trials, count(*) FILTER (state = 'complete') AS successful_trials,
              count(*) FILTER (state = 'pruned') AS pruned_trials, count(*) FILTER (state = 'failed') AS failed_trials,
              round(max(score) FILTER (state = 'complete'), 6) AS best_value,
              (list(o ORDER BY score DESC, o, l, p, x) FILTER (state = 'complete'))[1] AS best_order,
              round(count(*) FILTER (state = 'complete') / count(*), 6) AS success_rate
       FROM trials GROUP BY study""",
)
def a23(spark, d):
    out = study_summary(views.trials(spark, d), ["study"])
    return rounded(out.withColumn("best_order", F.col("best_trial.o")).drop("best_trial"))


@query(
    "a24_memory_growth",
    """SELECT worker, round(a, 6) AS initial_memory_mb, round(b, 6) AS current_memory_mb, round(b - a, 6) AS increase_mb,
              50.0::DOUBLE AS tolerance_mb, b - a > 50 AS has_leak,
              round(CASE WHEN a > 0 THEN (b - a) / a * 100 ELSE 0 END, 6) AS leak_percentage
       FROM (SELECT worker, (list(rss_mb ORDER BY created_at, task_id))[1] AS a,
                    (list(rss_mb ORDER BY created_at DESC, task_id DESC))[1] AS b
             FROM task_log GROUP BY worker)""",
)
def a24(spark, d):
    at = F.struct("created_at", "task_id")
    return rounded(ro.memory_growth(views.task_log(spark, d), ["worker"], at))


@query(
    "a25_success_rate",
    """SELECT model, count(*) FILTER (NOT error) AS total_results, count(*) FILTER (error) AS total_exceptions,
              round(count(*) FILTER (NOT error) / count(*), 6) AS success_rate
       FROM responses GROUP BY model""",
)
def a25(spark, d):
    return rounded(ro.success_rate(views.responses(spark, d), ["model"]))
