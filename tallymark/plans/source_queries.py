"""Sample and run files: written by Spark from the driver's tables, then read back."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tallymark.operators import compare
from tallymark.operators.trials import PARAMS, parameter_bins
from tallymark.plans.registry import query, rounded
from tallymark.plans.rollup_queries import bench, opt, scored
from tallymark.session import scratch_path
from tallymark.sources import runs, sample_source, samples_io, views
from tallymark.streaming.telemetry import append_to


def items(spark, d):
    """Documents as sample-file entries; some lack an answer or a language."""
    docs = views.table(spark, d, "documents")
    return docs.select(
        "doc_id",
        F.floor(F.col("doc_id") / 100).alias("part"),
        F.concat(F.lit("Q"), F.col("doc_id"), F.lit(': "'), F.col("source"), F.lit('"')).alias("problem"),
        F.when(F.col("doc_id") % 7 != 0, F.concat(F.col("n_chars"), F.lit(" chars"))).alias("solution"),
        F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("language"),
        F.col("source").alias("category"),
        F.col("n_chars"),
        F.md5("text").alias("digest"),
    )


ITEMS = """(SELECT doc_id, doc_id // 100 AS part, 'Q' || doc_id || ': "' || source || '"' AS problem,
                   n_chars || ' chars' AS solution, CASE WHEN doc_id % 5 <> 0 THEN lang ELSE 'ko' END AS language,
                   source AS category, n_chars, md5(text) AS digest,
                   row_number() OVER (PARTITION BY doc_id // 100 ORDER BY doc_id) - 1 AS pos
            FROM documents)"""
FIELDS = {"problem": "problem", "solution": "solution", "language": "language", "category": "category",
          "n_chars": "n_chars", "digest": "digest"}
SHAPE = ["part", "sample_id", "question", "answer", "language", "category", "metadata"]
META = "'digest=' || digest || ';n_chars=' || n_chars AS metadata"


def _flat(df):
    pairs = F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return df.withColumn("metadata", F.array_join(pairs, ";"))


def _part(df):
    return df.withColumn("part", F.regexp_extract("file", r"part=(\d+)", 1).cast("bigint"))


@query(
    "s1_list_files",
    f"""SELECT part, pos::VARCHAR AS sample_id, problem AS question, solution AS answer, language, category, {META}
        FROM {ITEMS} WHERE doc_id % 7 <> 0""",
)
def s1(spark, d):
    """JSON array files: ids are positions, entries without an answer are dropped."""
    path = scratch_path(spark, "list-files")
    samples_io.write_array_files(items(spark, d), path, "part", "doc_id", FIELDS)
    loaded = samples_io.load_samples(spark, "korean_math", path)
    return _part(_flat(loaded)).select(SHAPE)


@query(
    "s1_files_with_rejects",
    f"""SELECT part, pos::VARCHAR AS sample_id, problem AS question, solution AS answer, language, category, {META}, false AS rejected
        FROM {ITEMS} WHERE doc_id % 7 <> 0 AND part % 4 <> 1
        UNION ALL SELECT DISTINCT part, NULL, NULL, NULL, NULL, NULL, NULL, true FROM {ITEMS} WHERE part % 4 = 1""",
)
def s1_rejects(spark, d):
    """Array files of which every fourth is cut short: samples of the others, and a reject row for each."""
    path = scratch_path(spark, "list-files")
    whole = samples_io.array_files(items(spark, d), "part", "doc_id", FIELDS)
    cut = F.when(F.col("part") % 4 == 1, F.expr("substring(value, 1, length(value) - 9)")).otherwise(F.col("value"))
    whole.withColumn("value", cut).write.partitionBy("part").text(path)
    good, rejects = sample_source.read_samples(spark, path, "list", samples_io.FORMATS["korean_math"])
    told = _part(_flat(good)).select(SHAPE).withColumn("rejected", F.lit(False))
    lost = _part(rejects).select("part", *[F.lit(None).cast("string").alias(c) for c in SHAPE if c != "part"], F.lit(True).alias("rejected"))
    return told.unionByName(lost)


@query(
    "s2_stream_of_files",
    f"""SELECT part, doc_id::VARCHAR AS sample_id, problem AS question, solution AS answer, language, category, {META}
        FROM {ITEMS} WHERE doc_id % 7 <> 0""",
)
def s2_stream(spark, d):
    """Object files as a stream: half of them first, the others after a restart from the same checkpoint."""
    path, out, state = (scratch_path(spark, n) for n in ("keyed-files", "keyed-rows", "keyed-state"))
    rows = items(spark, d)
    for half in (0, 1):
        samples_io.write_keyed_files(rows.where(F.col("part") % 2 == half), f"{path}/half={half}", "part", "doc_id", FIELDS)
        good, _ = sample_source.read_samples(spark, path, "keyed", samples_io.FORMATS["korean_math"], stream=True)
        append_to(good, out, state)
    return _part(_flat(spark.read.schema(good.schema).parquet(out))).select(SHAPE)


@query(
    "s2_keyed_files",
    f"""SELECT part, doc_id::VARCHAR AS sample_id, problem AS question, solution AS answer, language, category, {META}
        FROM {ITEMS} WHERE doc_id % 7 <> 0""",
)
def s2(spark, d):
    """JSON object files: the key is the id."""
    path = scratch_path(spark, "keyed-files")
    samples_io.write_keyed_files(items(spark, d), path, "part", "doc_id", FIELDS)
    loaded = samples_io.read_keyed(spark, path, samples_io.FORMATS["korean_math"])
    return _part(_flat(loaded)).select(SHAPE)


@query(
    "s3_mapped_columns",
    f"""SELECT doc_id::VARCHAR AS sample_id, problem AS question, solution AS answer, language, category, {META}
        FROM {ITEMS} WHERE doc_id % 7 <> 0 AND language IN ('ko', 'en')""",
)
def s3(spark, d):
    """JSON lines with mapped keys, kept metadata and a language list."""
    path = scratch_path(spark, "lines")
    items(spark, d).select(F.col("doc_id").alias("id"), *FIELDS).write.json(path)
    fmt = samples_io.SampleFormat("problem", "solution", languages=("ko", "en"))
    loaded = samples_io.load_samples(spark, "lines", path, id_key="id", fmt=fmt)
    out = loaded.withColumn("metadata", F.map_filter("metadata", lambda k, _: k != "id"))
    return _flat(out).select([c for c in SHAPE if c != "part"])


def run_documents(spark, d):
    """Run records of both kinds and schemas as JSON text; some cut short."""
    o = opt(spark, d).select(
        "run_id",
        F.to_json(
            F.struct(
                F.when(F.col("study") % 2 == 0, F.col("run_id")).alias("test_id"),
                F.when(F.col("study") % 2 == 1, F.col("run_id")).alias("trial_id"),
                F.col("model").alias("model_name"),
                F.col("dataset").alias("dataset_name"),
                F.round("best_score", 3).alias("best_score"),
                F.when(F.col("study") % 2 == 0, F.col("trials") * 2.0).alias("total_time"),
                F.when(F.col("study") % 2 == 1, F.col("trials") * 3.0).alias("optimization_time"),
                F.struct(*PARAMS).alias("best_params"),
                # the two schemas number their trials under different names
                F.transform(
                    F.sequence(F.lit(0), (F.col("study") % 4).cast("int")),
                    lambda i: F.struct(
                        F.when(F.col("study") % 2 == 0, i).alias("trial_number"),
                        F.when(F.col("study") % 2 == 1, i).alias("trial"),
                        F.struct((i * 0.5).alias("temperature"), (i * 10).alias("top_k")).alias("params"),
                        (i * 0.25).alias("score"), F.when(i == 2, F.lit("timeout")).alias("error"),
                        F.date_format("first_ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
                    ),
                ).alias("optimization_history"),
                F.array(F.lit("advice")).alias("recommendations"),
                F.date_format("last_ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
            )
        ).alias("value"),
    )
    measured = scored(spark, d).groupBy("model", "dataset").agg(
        F.max("memory_usage_mb").alias("memory"), F.avg("tokens_per_second").alias("speed")
    )
    b = measured.select(
        F.concat(F.lit("bench_"), "model", F.lit("_"), "dataset").alias("run_id"),
        F.to_json(
            F.struct(
                F.concat(F.lit("bench_"), "model", F.lit("_"), "dataset").alias("test_id"),
                F.col("model").alias("model_name"),
                F.col("dataset").alias("dataset_name"),
                F.create_map(
                    F.lit("memory_usage_mb"), F.col("memory"), F.lit("tokens_per_second"), F.col("speed")
                ).alias("performance_metrics"),
                F.create_map(F.lit("cost_per_1k_tokens_usd"), F.col("memory") / 1_000_000).alias("cost_analysis"),
                F.lit("2024-02-01T00:00:00").alias("timestamp"),
            )
        ).alias("value"),
    )
    both = o.unionByName(b)
    cut = F.col("run_id").rlike("[05]$")
    return both.select(
        "run_id", F.when(cut, F.expr("substring(value, 1, length(value) - 9)")).otherwise(F.col("value")).alias("value")
    )


def written_runs(spark, d):
    path = scratch_path(spark, "runs")
    runs.write_documents(run_documents(spark, d), path)
    return path


RUN_ROWS = """(
    SELECT run_id, model, dataset, round(best_score, 3) AS best_score,
           CASE WHEN study % 2 = 0 THEN trials * 2.0::DOUBLE ELSE trials * 3.0::DOUBLE END AS run_time_s,
           'optimize' AS run_type, study, strftime(last_ts, '%Y-%m-%dT%H:%M:%S') AS timestamp
    FROM opt_runs
    UNION ALL
    SELECT 'bench_' || model || '_' || dataset, model, dataset, NULL, NULL, 'benchmark', NULL, '2024-02-01T00:00:00'
    FROM responses GROUP BY model, dataset)"""


@query(
    "s4_run_files",
    f"""SELECT regexp_matches(run_id, '[05]$') AS rejected, count(*) AS files
        FROM {RUN_ROWS} GROUP BY ALL""",
)
def s4(spark, d):
    """One JSON document per file; unreadable ones become rejects."""
    parsed = runs.parsed_runs(spark, written_runs(spark, d))
    told = parsed.select(F.col(runs.CORRUPT).isNotNull().alias("rejected"))
    return told.groupBy("rejected").agg(F.count(F.lit(1)).alias("files"))


@query(
    "s5_unified_runs",
    f"""SELECT run_id, run_type, model, dataset, best_score, run_time_s, timestamp
        FROM {RUN_ROWS} WHERE NOT regexp_matches(run_id, '[05]$')""",
)
def s5(spark, d):
    path = scratch_path(spark, "run-lines")
    run_documents(spark, d).select("value").write.text(path)
    good, _ = runs.read_runs(spark, path, lines=True)
    return runs.unify_runs(good).select(
        "run_id", "run_type", F.col("model_name").alias("model"), F.col("dataset_name").alias("dataset"), "best_score",
        "run_time_s", "timestamp",
    )


@query(
    "s6_stored_runs",
    """SELECT run_type, model, count(*) AS total_samples, round(avg(score), 6) AS avg_score,
              round(count(*) FILTER (score > 0.8) / count(*), 6) AS accuracy
       FROM (SELECT CASE WHEN error THEN 'failed' ELSE 'benchmark' END AS run_type, model, score FROM scored)
       GROUP BY run_type, model""",
)
def s6(spark, d):
    """Runs appended to a table partitioned by kind, then summed up from it."""
    path = scratch_path(spark, "stored")
    results = scored(spark, d).withColumn("run_type", F.when(F.col("error"), "failed").otherwise("benchmark"))
    runs.store_runs(results.select("run_type", "request_id", "model", "score"), path)
    return rounded(runs.evaluation_summary(spark.read.parquet(path), ["run_type", "model"]))


@query(
    "s7_latest_runs",
    "SELECT run_id, model, dataset, last_ts FROM opt_runs ORDER BY last_ts DESC, run_id LIMIT 10",
)
def s7(spark, d):
    return runs.latest_runs(opt(spark, d).select("run_id", "model", "dataset", "last_ts"), by="last_ts")


@query("s7_run_by_id", "SELECT run_id, model, dataset, last_ts FROM opt_runs WHERE run_id = 'opt_7'")
def s7_lookup(spark, d):
    return runs.run_by_id(opt(spark, d), "opt_7").select("run_id", "model", "dataset", "last_ts")


@query(
    "s8_retention",
    """SELECT model, CASE WHEN ts < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAYS THEN 'expired' ELSE 'kept' END AS status,
              count(*) AS runs, max(ts) AS newest
       FROM bench_runs GROUP BY ALL""",
)
def s8(spark, d):
    now = F.to_timestamp_ntz(F.lit("2024-01-31 00:00:00"))
    aged = runs.retention(bench(spark, d).select("model", "ts"), now, days=7)
    return aged.groupBy("model", "status").agg(F.count(F.lit(1)).alias("runs"), F.max("ts").alias("newest"))


@query(
    "s8_store_by_day",
    """SELECT model, strftime(ts, '%Y-%m-%d') AS run_day, count(*) AS runs, max(ts) AS newest
       FROM responses WHERE ts >= TIMESTAMP '2024-01-20 12:00:00' GROUP BY ALL""",
)
def s8_days(spark, d):
    """Responses stored by day and expired: old days deleted, the border's day cut, all others untouched."""
    path = scratch_path(spark, "by-day")
    runs.store_by_day(views.responses(spark, d).select("request_id", "model", "ts"), path)
    runs.expire(spark, path, datetime(2024, 1, 27, 12), days=7)
    left = spark.read.option("basePath", path).parquet(path)
    return left.groupBy("model", F.date_format("ts", "yyyy-MM-dd").alias("run_day")).agg(F.count(F.lit(1)).alias("runs"), F.max("ts").alias("newest"))


@query(
    "s9_trial_history",
    f"""SELECT run_id, i AS position, i AS trial_number, CASE WHEN i IS NOT NULL THEN i * 0.25::DOUBLE END AS score,
               CASE WHEN i = 2 THEN 'timeout' END AS error
        FROM (SELECT run_id, unnest(range(0, study % 4 + 1))::INTEGER AS i FROM {RUN_ROWS}
              WHERE run_type = 'optimize' AND NOT regexp_matches(run_id, '[05]$')
              UNION ALL SELECT run_id, NULL FROM {RUN_ROWS}
              WHERE run_type = 'benchmark' AND NOT regexp_matches(run_id, '[05]$'))""",
)
def s9(spark, d):
    path = scratch_path(spark, "run-lines")
    run_documents(spark, d).select("value").write.text(path)
    good, _ = runs.read_runs(spark, path, lines=True)
    history = runs.explode_history(runs.unify_runs(good))
    return history.select("run_id", "position", "trial_number", "score", "error")


def _loaded(spark, d):
    """Run files written, read back and unified; cut ones are among the rejects."""
    path = scratch_path(spark, "run-lines")
    run_documents(spark, d).select("value").write.text(path)
    return runs.unify_runs(runs.read_runs(spark, path, lines=True)[0])


@query(
    "s9_history_with_params",
    f"""SELECT run_id, n AS total_trials, n - (n > 2)::INTEGER AS successful_trials, i AS trial_number, i * 0.5::DOUBLE AS temperature,
               i * 10 AS top_k, i * 0.25::DOUBLE AS score, strftime(first_ts, '%Y-%m-%dT%H:%M:%S') AS timestamp
        FROM (SELECT *, (study % 4 + 1)::INTEGER AS n, unnest(range(0, study % 4 + 1))::INTEGER AS i FROM opt_runs
              WHERE NOT regexp_matches(run_id, '[05]$'))""",
)
def s9_params(spark, d):
    """Trials of both schemas with their parameters, numbered and counted alike."""
    loaded = _loaded(spark, d).where(F.col("run_type") == "optimize")
    trials = runs.explode_history(loaded).select("run_id", "trial_number", "temperature", "top_k", "score", "timestamp")
    return loaded.select("run_id", "total_trials", "successful_trials").join(trials, "run_id")


@query(
    "s4_runs_to_bins",
    """SELECT parameter, round(bin, 6) AS bin, round(avg(score), 6) AS performance, count(*) AS sample_count
       FROM (SELECT s.n AS parameter, s.b::DOUBLE AS bin, score FROM (
                 SELECT round(best_score, 3) AS score, unnest([
                            {'n': 'temperature', 'b': floor(temperature * 10 + 0.5) / 10}, {'n': 'top_p', 'b': floor(top_p * 10 + 0.5) / 10},
                            {'n': 'top_k', 'b': floor(top_k / 10) * 10}, {'n': 'max_new_tokens', 'b': floor(max_new_tokens / 100) * 100},
                            {'n': 'repetition_penalty', 'b': floor(repetition_penalty * 100 + 0.5) / 100}]) AS s
                 FROM opt_runs WHERE NOT regexp_matches(run_id, '[05]$')))
       GROUP BY parameter, bin""",
)
def s4_bins(spark, d):
    """From run files to the mean best score per parameter bin."""
    return rounded(parameter_bins(runs.optimizations(_loaded(spark, d)), score="best_score"))


@query(
    "s4_runs_to_comparison",
    """SELECT model, round(coalesce(max(best_score), 0), 6) AS best_score, round(coalesce(max(speed), 0), 6) AS best_speed,
              min(memory) AS min_memory, round(min(cost), 6) AS min_cost, count(DISTINCT dataset) AS datasets
       FROM (SELECT model, dataset, round(best_score, 3) AS best_score, NULL::DOUBLE AS speed, NULL::DOUBLE AS memory,
                    NULL::DOUBLE AS cost
             FROM opt_runs WHERE NOT regexp_matches(run_id, '[05]$')
             UNION ALL
             SELECT model, dataset, NULL, avg(tokens_per_second), max(memory_usage_mb), max(memory_usage_mb) / 1000000
             FROM scored WHERE NOT regexp_matches(dataset, '[05]$') GROUP BY model, dataset)
       GROUP BY model""",
)
def s4_comparison(spark, d):
    """From run files of both kinds to one row per model."""
    loaded = _loaded(spark, d)
    return rounded(compare.merge_by_model(runs.optimizations(loaded), runs.benchmarks(loaded)))


@query(
    "j5_merge_by_model",
    """SELECT model, round(coalesce(max(best_score), 0), 6) AS best_score,
              round(coalesce(max(tokens_per_second), 0), 6) AS best_speed, min(memory_usage_mb) AS min_memory,
              round(min(cost_per_1k_tokens_usd), 6) AS min_cost, count(DISTINCT dataset) AS datasets
       FROM (SELECT model, dataset, best_score, NULL::DOUBLE AS tokens_per_second, NULL::DOUBLE AS memory_usage_mb,
                    NULL::DOUBLE AS cost_per_1k_tokens_usd FROM opt_runs
             UNION ALL
             SELECT model, dataset, NULL, tokens_per_second, memory_usage_mb, cost_per_1k_tokens_usd FROM bench_runs)
       GROUP BY model""",
)
def j5(spark, d):
    return rounded(compare.merge_by_model(opt(spark, d), bench(spark, d)))
