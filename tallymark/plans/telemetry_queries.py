"""Telemetry, error logs and capacity, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.functions.lexicons import ERROR_PATTERNS
from tallymark.operators import asof, capacity, compare, errors as er, sketches, telemetry as te
from tallymark.operators import rollup as ro
from tallymark.plans.registry import query, rounded
from tallymark.plans.rollup_queries import CLASSIFIED, ERROR_STATS, rules_sql
from tallymark.session import scratch_path
from tallymark.sources import views
from tallymark.streaming import scaling as sc
from tallymark.streaming import stateful as sf
from tallymark.streaming import telemetry as st


def ticks_stream(spark, d):
    return st.metric_ticks(st.read_events(spark, d, "events.parquet"))


UNSORTED_BATCHES = 8


def unsorted_events(spark, d, name):
    """Event files in no order of time, read in eight batches; a batch has a file for every core."""
    folder, cores = scratch_path(spark, name), spark.sparkContext.defaultParallelism
    views.table(spark, d, "events").repartition(UNSORTED_BATCHES * cores, "event_id").write.parquet(folder)
    return folder, st.read_events(spark, folder, files_per_trigger=cores)


def unsorted_ticks_stream(spark, d):
    """The same readings from files in no order of time, in eight batches."""
    return st.metric_ticks(unsorted_events(spark, d, "unsorted-events")[1])


def ended_ticks_stream(spark, d, late="60 days"):
    """The unsorted files and, after them, a heartbeat that is later than the bound on lateness."""
    folder, stream = unsorted_events(spark, d, "ended-events")
    events = views.table(spark, d, "events")
    beat = events.agg((F.max("ts") + F.expr(f"INTERVAL {late}") + F.expr("INTERVAL 2 DAYS")).alias("ts"))
    beat.select(*[F.col(f.name) if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema]).write.mode(
        "append"
    ).parquet(folder)
    return st.metric_ticks(stream)


def error_stream(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    texts = F.array(*[F.lit(t) for t in views.ERROR_TEXTS])
    kinds = F.array(*[F.lit(t) for t in views.EXCEPTION_TYPES])
    events = st.read_events(spark, d, "events.parquet")
    return events.where(F.col("event_type") == "error").select(
        F.col("event_id").alias("error_id"),
        "ts",
        F.get(texts, k % len(views.ERROR_TEXTS)).alias("message"),
        F.get(kinds, (F.col("event_id") % len(views.EXCEPTION_TYPES)).cast("int")).alias("exception_type"),
        (F.col("event_id") % 4 == 0).alias("resolved"),
    )


def _starts(df):
    return df.withColumn("window_start", F.date_format("window.start", "yyyy-MM-dd HH:mm")).drop("window")


_OK = "cpu_percent < 90 AND memory_percent < 95 AND disk_percent < 95"
TUMBLING = f"""
    SELECT deployment, strftime(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M') AS window_start,
           round(avg(cpu_percent), 6) AS cpu_avg, max(cpu_percent) AS cpu_peak, round(avg(memory_percent), 6) AS memory_avg,
           max(memory_percent) AS memory_peak, count(*) AS ticks, bool_and({_OK}) AS healthy
    FROM host_metrics GROUP BY ALL"""
SLIDING = f"""
    SELECT deployment, strftime(b - to_hours(6 * i::INTEGER), '%Y-%m-%d %H:%M') AS window_start,
           round(avg(cpu_percent), 6) AS cpu_avg, max(cpu_percent) AS cpu_peak, round(avg(memory_percent), 6) AS memory_avg,
           max(memory_percent) AS memory_peak, count(*) AS ticks, bool_and({_OK}) AS healthy
    FROM (SELECT *, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS b FROM host_metrics),
         (SELECT unnest([0, 1]) AS i) GROUP BY ALL"""


@query("t1_metric_ingest", "SELECT deployment, tick_id, cpu_percent, memory_percent FROM host_metrics")
def t1(spark, d):
    """The event files as a stream of parsed readings, stored as Parquet."""
    lean = ticks_stream(spark, d).select("deployment", "tick_id", "cpu_percent", "memory_percent")
    return st.run_append(spark, lean, "ticks")


@query("t2_windowed_summary_batch", TUMBLING)
def t2_batch(spark, d):
    hosts = views.host_metrics(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    return rounded(_starts(te.window_summary(hosts, ["deployment"], F.window("ts", "6 hours"))))


def _summary(ticks, spark):
    out = st.windowed_summary(ticks, ["deployment"], "6 hours")
    return rounded(_starts(st.run_upsert(spark, out, "summary", ["deployment", "window"])))


@query("t2_windowed_summary_stream", TUMBLING)
def t2_stream(spark, d):
    return _summary(ticks_stream(spark, d), spark)


@query("t2_windowed_summary_unsorted_files", TUMBLING)
def t2_unsorted(spark, d):
    return _summary(unsorted_ticks_stream(spark, d), spark)


@query("t2_sliding_summary_stream", SLIDING)
def t2_sliding(spark, d):
    out = st.windowed_summary(ticks_stream(spark, d), ["deployment"], "12 hours", slide="6 hours")
    return rounded(_starts(st.run_upsert(spark, out, "sliding", ["deployment", "window"])))


ALERTS = """
    SELECT DISTINCT deployment, rule, severity, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS second
    FROM (SELECT deployment, ts, 'high_cpu' AS rule, 'warning' AS severity FROM host_metrics WHERE cpu_percent > 80
          UNION ALL SELECT deployment, ts, 'high_memory', 'critical' FROM host_metrics WHERE memory_percent > 85)"""


def _alert_rows(df):
    second = F.date_format("second", "yyyy-MM-dd HH:mm:ss")
    return df.select("deployment", "rule", "severity", second.alias("second"))


@query("t3_alerts_batch", ALERTS)
def t3_batch(spark, d):
    return _alert_rows(te.alerts(views.host_metrics(spark, d), "deployment"))


@query("t3_alerts_stream", ALERTS)
def t3_stream(spark, d):
    return _alert_rows(st.run_append(spark, st.alert_stream(ticks_stream(spark, d), "deployment"), "alerts"))


@query("t3_alerts_unsorted_files", ALERTS)
def t3_unsorted(spark, d):
    return _alert_rows(st.run_append(spark, st.alert_stream(unsorted_ticks_stream(spark, d), "deployment"), "alerts"))


SCALING = """
    WITH RECURSIVE t AS (
           SELECT deployment, (epoch_us(ts) // 1000000 // 30 * 30)::BIGINT AS tick,
                  sum(cpu_percent) / count(*) / 100 AS load, avg(response_s) AS resp
           FROM host_metrics GROUP BY ALL),
       n AS (SELECT *, row_number() OVER (PARTITION BY deployment ORDER BY tick) AS i,
                    CASE WHEN load > 0.8 OR resp > 5 THEN 1 WHEN load < 0.3 AND resp < 1 THEN -1 ELSE 0 END AS want FROM t),
       walk AS (
           SELECT deployment, 0::BIGINT AS i, 1 AS replicas, -1000000000::BIGINT AS changed, 0::BIGINT AS tick, 0 AS step
           FROM (SELECT DISTINCT deployment FROM n)
           UNION ALL
           SELECT deployment, i, replicas + s, CASE WHEN s <> 0 THEN tick ELSE changed END, tick, s
           FROM (SELECT w.deployment, n.i, w.replicas, w.changed, n.tick,
                        CASE WHEN n.tick - w.changed < 300 THEN 0 WHEN n.want = 1 AND w.replicas < 10 THEN 1
                             WHEN n.want = -1 AND w.replicas > 1 THEN -1 ELSE 0 END AS s
                 FROM walk w JOIN n ON n.deployment = w.deployment AND n.i = w.i + 1))
       SELECT deployment, tick, CASE step WHEN 1 THEN 'up' ELSE 'down' END AS action, replicas FROM walk WHERE step <> 0"""


@query("t4_scaling_decisions", SCALING)
def t4(spark, d):
    return te.scaling_decisions(te.scaling_ticks(views.host_metrics(spark, d), ["deployment"]), "deployment")


@query("t4_scaling_stream", SCALING)
def t4_stream(spark, d):
    return sc.run_scaling(spark, ticks_stream(spark, d), "deployment")


@query("t4_scaling_unsorted_files", SCALING)
def t4_unsorted(spark, d):
    return sc.run_scaling(spark, unsorted_ticks_stream(spark, d), "deployment")


@query("t4_timers_stream", SCALING)
def t4_timers(spark, d):
    """Ticks and decisions in one stream: map state of open ticks, closed by event-time timers."""
    out = sf.scaling_decisions(ended_ticks_stream(spark, d), "deployment", "60 days")
    with sf.state_in_rocksdb(spark):
        return st.run_append(spark, out, "scaling-timers")


LEVEL = """CASE WHEN utilization < 0.7 THEN 'safe' WHEN utilization < 0.85 THEN 'warning'
                WHEN utilization < 0.95 THEN 'critical' ELSE 'emergency' END"""
COUNTS = f"""
    SELECT device, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M') AS window_start, {LEVEL} AS level, count(*) AS ticks
    FROM device_metrics GROUP BY ALL"""


@query("t5_level_counts_batch", COUNTS)
def t5_batch(spark, d):
    ticks = views.device_metrics(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    return _starts(te.level_counts(ticks, ["device"], F.window("ts", "1 day")))


def _levels(ticks, spark):
    out = st.windowed_levels(ticks, ["device"], "1 day")
    return _starts(st.run_upsert(spark, out, "levels", ["device", "window", "level"]))


@query("t5_level_counts_stream", COUNTS)
def t5_stream(spark, d):
    return _levels(ticks_stream(spark, d), spark)


@query("t5_level_counts_unsorted_files", COUNTS)
def t5_unsorted(spark, d):
    return _levels(unsorted_ticks_stream(spark, d), spark)


LEVEL_CHANGES = f"""
    SELECT device, tick, previous_level, level FROM (
        SELECT device, tick, level, lag(level) OVER (PARTITION BY device ORDER BY tick) AS previous_level
        FROM (SELECT device, tick, {LEVEL} AS level
              FROM (SELECT device, date_trunc('hour', ts) AS tick, max(utilization) AS utilization
                    FROM device_metrics GROUP BY ALL)))
    WHERE previous_level <> level"""


@query("t5_level_changes", LEVEL_CHANGES)
def t5_changes(spark, d):
    ticks = views.device_metrics(spark, d)
    out = te.level_changes(ticks, ["device"], F.date_trunc("hour", "ts"))
    return out.withColumn("tick", F.col("tick").cast("timestamp_ntz"))


@query("t5_level_changes_unsorted_files", LEVEL_CHANGES)
def t5_changes_unsorted(spark, d):
    """The same changes from one stream over unsorted files, closed by timers."""
    out = sf.level_changes(ended_ticks_stream(spark, d), "device", "60 days")
    with sf.state_in_rocksdb(spark):
        changes = st.run_append(spark, out, "level-changes")
    return changes.withColumn("tick", F.timestamp_seconds("second").cast("timestamp_ntz")).drop("second")


def latest_devices(spark, d):
    return compare.latest_per_key(
        views.device_metrics(spark, d), ["device"], ["ts", "tick_id"],
        ["ts", "tick_id", "total_gb", "free_gb", "utilization"],
    )


LATEST = f"""(SELECT device, total_gb, free_gb, utilization, {LEVEL} AS level FROM device_metrics
              QUALIFY row_number() OVER (PARTITION BY device ORDER BY ts DESC, tick_id DESC) = 1)"""


def need_sql(parity):
    """The catalog with its memory need, token by token."""
    from tallymark.functions.lexicons import MODEL_SIZES_GB

    order = MODEL_SIZES_GB if parity else sorted(MODEL_SIZES_GB, key=lambda s: -len(s[0]))
    tests = " ".join(f"WHEN contains(lower(model_path), '{t}') THEN {g}" for t, g in order)
    return f"""(SELECT model, load_in_4bit, (CASE {tests} ELSE 14.0 END)::DOUBLE
                       * CASE WHEN load_in_4bit THEN 0.5 WHEN load_in_8bit THEN 0.75 ELSE 1 END AS need_gb FROM models)"""


def models_on_devices(spark, d, parity=False):
    """Latest device rows, each once per catalog model with its need."""
    from tallymark.operators.samples import fan_out
    from tallymark.operators.catalog import MODELS

    rows = fan_out(latest_devices(spark, d), MODELS)
    four = F.col("model").isin(*[m.name for m in MODELS if m.load_in_4bit])
    eight = F.col("model").isin(*[m.name for m in MODELS if m.load_in_8bit])
    return capacity.with_need(rows.withColumn("load_in_4bit", four).withColumn("load_in_8bit", eight), parity)


@query(
    "t6_capacity_check",
    f"""SELECT device, model, round(need_gb, 6) AS need_gb, round(free_gb, 6) AS free_gb, level,
               free_gb >= need_gb + total_gb * 0.1 AND level <> 'emergency' AS safe
        FROM {LATEST}, {need_sql(False)}""",
)
def t6(spark, d):
    pairs = models_on_devices(spark, d).withColumn("level", te.memory_level(F.col("utilization")))
    return rounded(capacity.capacity_check(pairs).select("device", "model", "need_gb", "free_gb", "level", "safe"))


@query(
    "t6_capacity_as_of",
    f"""SELECT device, model, count(*) AS requests, count(*) FILTER (level IS NULL) AS unknown,
               count(*) FILTER (free_gb >= need_gb + total_gb * 0.1 AND level <> 'emergency') AS safe
        FROM (SELECT r.request_id, r.model, r.device, need_gb, free_gb, total_gb,
                     CASE WHEN utilization IS NULL THEN NULL ELSE {LEVEL} END AS level
              FROM (SELECT *, (request_id * 7) % 16 AS device, ts - INTERVAL 1 MINUTE AS asked FROM responses) r
              JOIN {need_sql(False)} n ON n.model = r.model
              ASOF LEFT JOIN (SELECT device, ts, arg_max(total_gb, tick_id) AS total_gb, arg_max(free_gb, tick_id) AS free_gb,
                                     arg_max(utilization, tick_id) AS utilization FROM device_metrics GROUP BY device, ts) m
              ON m.device = r.device AND r.asked >= m.ts)
        GROUP BY device, model""",
)
def t6_as_of(spark, d):
    """Every request against what its device had a minute before: one ordered pass, no inequality join."""
    asked = views.responses(spark, d).select(
        "model", ((F.col("request_id") * 7) % 16).alias("device"), (F.col("ts") - F.expr("INTERVAL 1 MINUTE")).alias("ts")
    )
    readings = views.device_metrics(spark, d).select("device", "ts", "tick_id", "total_gb", "free_gb", "utilization")
    met = asof.as_of(asked, readings, ["device"], "ts", ["tick_id"])
    known = met.join(F.broadcast(views.models(spark)), "model")  # the catalog is a few rows of configuration
    pairs = capacity.with_need(known).withColumn("level", F.when(F.col("utilization").isNotNull(), te.memory_level(F.col("utilization"))))
    checked = capacity.capacity_check(pairs)
    return checked.groupBy("device", "model").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col("level").isNull()).alias("unknown"), F.count_if(F.col("safe")).alias("safe")
    )


@query(
    "t7_health_flags",
    f"""SELECT deployment, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M') AS window_start,
               bool_and({_OK}) AS healthy, count(*) AS ticks, count(*) FILTER (NOT ({_OK})) AS unhealthy_ticks
        FROM host_metrics GROUP BY ALL""",
)
def t7(spark, d):
    ok = te.healthy(F.col("cpu_percent"), F.col("memory_percent"), F.col("disk_percent"))
    hosts = views.host_metrics(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    out = hosts.groupBy("deployment", F.window("ts", "1 day").alias("window")).agg(
        F.every(ok).alias("healthy"), F.count(F.lit(1)).alias("ticks"), F.count_if(~ok).alias("unhealthy_ticks")
    )
    return _starts(out)


CLASSES = f"SELECT error_id, category, severity, pattern FROM {CLASSIFIED}"


@query("t8_error_classes_batch", CLASSES)
def t8_batch(spark, d):
    return er.classify(views.errors(spark, d)).select("error_id", "category", "severity", "pattern")


@query("t8_error_classes_stream", CLASSES)
def t8_stream(spark, d):
    out = er.classify(error_stream(spark, d)).select("error_id", "category", "severity", "pattern")
    return st.run_append(spark, out, "classes")


@query("a21_error_stats_stream", ERROR_STATS)
def a21_stream(spark, d):
    out = st.running_error_stats(error_stream(spark, d))
    return st.run_upsert(spark, out, "error-stats", ["dimension", "value"])


@query(
    "j6_first_match",
    f"""SELECT category, pattern, count(*) AS errors
        FROM (SELECT e.error_id, p.pattern, p.category
              FROM errors e LEFT JOIN {rules_sql()} p ON contains(lower(e.message), p.pattern)
              QUALIFY row_number() OVER (PARTITION BY error_id ORDER BY priority NULLS LAST) = 1) GROUP BY ALL""",
)
def j6(spark, d):
    """Messages against a pattern table: the first pattern found names the category."""
    rows = [
        F.struct(F.lit(i).alias("priority"), F.lit(p).alias("pattern"), F.lit(c).alias("category"))
        for i, (p, c, _, _) in enumerate(ERROR_PATTERNS)
    ]
    patterns = spark.range(1).select(F.inline(F.array(*rows)))
    matched = er.first_match(views.errors(spark, d), patterns)
    return matched.groupBy("category", "pattern").agg(F.count(F.lit(1)).alias("errors"))


@query(
    "w9_error_history",
    f"""SELECT error_id, ts, source, category, severity FROM (
            SELECT * FROM {CLASSIFIED} QUALIFY row_number() OVER (PARTITION BY source ORDER BY ts DESC, error_id DESC) <= 10)
        WHERE category = 'memory' AND severity = 'high' ORDER BY ts DESC, error_id DESC LIMIT 50""",
)
def w9(spark, d):
    log = er.classify(views.errors(spark, d))
    out = er.error_history(log, "memory", "high", limit=50, per_source=10)
    return out.select("error_id", "ts", "source", "category", "severity")


@query(
    "t9_status_panel",
    """SELECT deployment, cpu_percent, memory_percent, CASE WHEN cpu_percent > 80 THEN 'alert' ELSE 'normal' END AS cpu_flag,
              CASE WHEN memory_percent > 80 THEN 'alert' ELSE 'normal' END AS memory_flag, points
       FROM (SELECT *, count(*) OVER (PARTITION BY deployment) AS points FROM host_metrics
             QUALIFY row_number() OVER (PARTITION BY deployment ORDER BY ts DESC, tick_id DESC) = 1)""",
)
def t9(spark, d):
    hosts = views.host_metrics(spark, d)
    newest = F.max(F.struct("ts", "tick_id", "cpu_percent", "memory_percent")).alias("_r")
    latest = hosts.groupBy("deployment").agg(newest, F.count(F.lit(1)).alias("points"))
    panel = te.status_panel(latest.select("deployment", "_r.cpu_percent", "_r.memory_percent", "points"))
    return panel.select("deployment", "cpu_percent", "memory_percent", "cpu_flag", "memory_flag", "points")


def _newest(spark, d, n, name):
    readings = unsorted_ticks_stream(spark, d).withColumn("us", F.unix_micros("ts"))
    return st.run_newest(spark, readings, "deployment", ["us", "tick_id"], ["cpu_percent", "memory_percent"], n, name)


@query(
    "w7_latest_unsorted_files",
    """SELECT deployment, tick_id, cpu_percent, memory_percent, CASE WHEN cpu_percent > 80 THEN 'alert' ELSE 'normal' END AS cpu_flag,
              CASE WHEN memory_percent > 80 THEN 'alert' ELSE 'normal' END AS memory_flag
       FROM host_metrics QUALIFY row_number() OVER (PARTITION BY deployment ORDER BY ts DESC, tick_id DESC) = 1""",
)
def w7_unsorted(spark, d):
    """The newest reading of every deployment, kept by a stream whose readings come late."""
    return te.status_panel(_newest(spark, d, 1, "newest").drop("rank", "us"))


@query(
    "w8_last_points_unsorted_files",
    """SELECT deployment, row_number() OVER (PARTITION BY deployment ORDER BY ts DESC, tick_id DESC)::INTEGER AS rank, tick_id,
              cpu_percent, memory_percent
       FROM host_metrics QUALIFY rank <= 100""",
)
def w8_unsorted(spark, d):
    """The last 100 points of every deployment from the same kind of stream."""
    return _newest(spark, d, 100, "last-points").drop("us")


def _period_sql(period):
    return f"""SELECT date_trunc('{period}', ts)::DATE AS period, model, round(avg(tokens_per_second), 6) AS tokens_per_second,
                      round(avg(latency_s) FILTER (latency_s > 0), 6) AS latency_avg, max(memory_usage_mb) AS memory_usage_mb,
                      round(count(*) / sum(latency_s) FILTER (latency_s > 0), 6) AS throughput,
                      round(quantile_cont(latency_s, 0.5) FILTER (latency_s > 0), 6) AS latency_p50,
                      round(quantile_cont(latency_s, 0.95) FILTER (latency_s > 0), 6) AS latency_p95,
                      round(quantile_cont(latency_s, 0.99) FILTER (latency_s > 0), 6) AS latency_p99
               FROM responses GROUP BY 1, 2"""


def _period(period):
    def run(spark, d):
        r = te.performance_by_period(views.responses(spark, d), period)
        return rounded(ro.run_metrics(r, ["period", "model"]))

    return run


for _p, _name in (("day", "daily"), ("week", "weekly")):
    query(f"t10_{_name}_performance", _period_sql(_p))(_period(_p))


MERGED = """
    SELECT date_trunc('{period}', ts)::DATE AS period, model, count(*) AS responses, round(avg(tokens_per_second), 6) AS tokens_per_second,
           round(avg(latency_s) FILTER (latency_s > 0), 6) AS latency_avg, max(memory_usage_mb) AS memory_usage_mb,
           round(count(*) / sum(latency_s) FILTER (latency_s > 0), 6) AS throughput
    FROM responses GROUP BY 1, 2"""


def _merged(daily, period):
    parts = daily.withColumn("period", F.to_date(F.date_trunc(period, "day"))).drop("day")
    out = sketches.figures(sketches.united(parts, ["period", "model"]))
    return rounded(out.select("period", "model", "responses", "tokens_per_second", "latency_avg", "memory_usage_mb", "throughput"))


@query("t10_weekly_from_daily", MERGED.format(period="week"))
def t10_merged(spark, d):
    """Weekly figures from stored daily summaries; the log is read once, for the daily ones."""
    path = scratch_path(spark, "daily")
    daily = sketches.summaries(views.responses(spark, d), ["day", "model"])
    daily.write.parquet(path)
    return _merged(spark.read.schema(daily.schema).parquet(path), "week")


@query("t10_monthly_stream_unsorted_files", MERGED.format(period="month"))
def t10_stream(spark, d):
    """Daily summaries kept by a stream over unsorted files, united by month."""
    log = views.responses_of(unsorted_events(spark, d, "unsorted-responses")[1])
    return _merged(st.run_upsert(spark, sketches.summaries(log, ["day", "model"]), "daily", ["day", "model"]), "month")


def _need(parity):
    def run(spark, d):
        log = views.responses(spark, d).groupBy("model").agg(F.count(F.lit(1)).alias("responses"))
        named = log.join(F.broadcast(views.models(spark)), "model")  # the catalog is a few rows of configuration
        return rounded(capacity.with_need(named, parity).select("model", "responses", "need_gb"))

    return run


for _flag, _suffix in ((False, ""), (True, "_listed_order")):
    query(
        f"f1_model_memory{_suffix}",
        f"""SELECT model, count(*) AS responses, round(need_gb, 6) AS need_gb
            FROM responses JOIN {need_sql(_flag)} USING (model) GROUP BY model, need_gb""",
    )(_need(_flag))


@query(
    "f2_fit_report",
    f"""SELECT model, plan, count(*) AS devices, count(*) FILTER (exceeds_90) AS over_90,
               count(*) FILTER (exceeds_total) AS over_total
        FROM (SELECT model, need_gb > total_gb * 0.9 AS exceeds_90, need_gb > total_gb AS exceeds_total,
                     CASE WHEN need_gb <= total_gb * 0.9 THEN 'fits'
                          WHEN NOT load_in_4bit AND need_gb * 0.5 <= total_gb * 0.9 THEN 'fits in 4-bit'
                          ELSE 'too large' END AS plan
              FROM {LATEST}, {need_sql(False)}) GROUP BY model, plan""",
)
def f2(spark, d):
    report = capacity.fit_report(models_on_devices(spark, d))
    return report.groupBy("model", "plan").agg(
        F.count(F.lit(1)).alias("devices"),
        F.count_if(F.col("exceeds_90")).alias("over_90"),
        F.count_if(F.col("exceeds_total")).alias("over_total"),
    )


@query(
    "f3_size_scores",
    """SELECT deployment, model_size, gpu_gb, score, round(greatest(least(gpu_gb * 5, 100) * factor, 0), 6) AS predicted_speed
       FROM (SELECT deployment, max(gpu_memory_gb) * 20 AS gpu_gb FROM host_metrics GROUP BY deployment),
            (SELECT * FROM (VALUES
                 ('7B', 0.9::DOUBLE, [1.0, 1.0, 1.0, 1.0, 0.8, 0.5]), ('13B', 0.7::DOUBLE, [1.0, 1.0, 1.0, 0.7, 0.3, 0.0]),
                 ('30B', 0.4::DOUBLE, [1.0, 1.0, 0.8, 0.2, 0.0, 0.0]), ('70B', 0.2::DOUBLE, [1.0, 0.7, 0.3, 0.0, 0.0, 0.0]))
             AS t(model_size, factor, scores)),
       LATERAL (SELECT scores[CASE WHEN gpu_gb >= 160 THEN 1 WHEN gpu_gb >= 80 THEN 2 WHEN gpu_gb >= 32 THEN 3
                                   WHEN gpu_gb >= 16 THEN 4 WHEN gpu_gb >= 8 THEN 5 ELSE 6 END]::DOUBLE AS score)""",
)
def f3(spark, d):
    hosts = views.host_metrics(spark, d).groupBy("deployment").agg((F.max("gpu_memory_gb") * 20).alias("gpu_gb"))
    return rounded(capacity.size_scores(hosts))


@query(
    "f3_size_scores_by_band",
    """SELECT deployment, day, model_size, gpu_gb, score, round(greatest(least(gpu_gb * 5, 100) * factor, 0), 6) AS predicted_speed
       FROM (SELECT deployment, ts::DATE AS day, max(gpu_memory_gb) * 20 AS gpu_gb FROM host_metrics GROUP BY ALL),
            (SELECT * FROM (VALUES
                 ('7B', 0.9::DOUBLE, [1.0, 1.0, 1.0, 1.0, 0.8, 0.5]), ('13B', 0.7::DOUBLE, [1.0, 1.0, 1.0, 0.7, 0.3, 0.0]),
                 ('30B', 0.4::DOUBLE, [1.0, 1.0, 0.8, 0.2, 0.0, 0.0]), ('70B', 0.2::DOUBLE, [1.0, 0.7, 0.3, 0.0, 0.0, 0.0]))
             AS t(model_size, factor, scores)),
       LATERAL (SELECT scores[CASE WHEN gpu_gb >= 160 THEN 1 WHEN gpu_gb >= 80 THEN 2 WHEN gpu_gb >= 32 THEN 3
                                   WHEN gpu_gb >= 16 THEN 4 WHEN gpu_gb >= 8 THEN 5 ELSE 6 END]::DOUBLE AS score)""",
)
def f3_bands(spark, d):
    """Every host day in the tier its memory lies in; tiers are a table, met by bands and not by a chain of cases."""
    hosts = views.host_metrics(spark, d).groupBy("deployment", F.to_date("ts").alias("day")).agg((F.max("gpu_memory_gb") * 20).alias("gpu_gb"))
    sizes = F.explode(F.array(*[F.lit(s) for s in capacity.SPEED_FACTORS])).alias("model_size")
    tiers = asof.tier_rows(spark, capacity.TIERS, capacity.SPEED_FACTORS)
    met = asof.banded(hosts.select("*", sizes), tiers, ["model_size"], "gpu_gb", "floor_gb")
    speed = F.greatest(F.least(F.col("gpu_gb") * 5, F.lit(100.0)) * F.col("factor"), F.lit(0.0))
    return rounded(met.select("deployment", "day", "model_size", "gpu_gb", "score", speed.alias("predicted_speed")))


HEALTH = f"""
    SELECT deployment, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M') AS window_start, bool_and({_OK}) AS healthy,
           count(*) AS ticks FROM host_metrics GROUP BY ALL"""


def _health(ticks, spark):
    out = st.windowed_summary(ticks, ["deployment"], "1 day")
    stored = st.run_upsert(spark, out, "health", ["deployment", "window"])
    return _starts(stored.select("deployment", "window", "healthy", "ticks"))


@query("t7_health_stream", HEALTH)
def t7_stream(spark, d):
    return _health(ticks_stream(spark, d), spark)


@query("t7_health_unsorted_files", HEALTH)
def t7_unsorted(spark, d):
    return _health(unsorted_ticks_stream(spark, d), spark)
