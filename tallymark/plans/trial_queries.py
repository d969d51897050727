"""Parameter trials, rankings, report rows and A/B comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.operators import abtest, compare
from tallymark.operators import rollup as ro
from tallymark.operators import trials as tr
from tallymark.plans.oracle_views import quoted
from tallymark.plans.registry import query, rounded
from tallymark.plans.rollup_queries import RUN, bench, cpu_load, opt, scored
from tallymark.sources import views

ORDER = "o, l, p, x"
FLAT = ["trial.o", "trial.l", "trial.p", "trial.x"]


def numbered(df):
    return df.select("*", *FLAT).drop("trial")


@query(
    "j4_grid_plan",
    """SELECT source AS dataset, samples, combination, t AS temperature, tp AS top_p, tk AS top_k, mt AS max_new_tokens,
              rp AS repetition_penalty, (samples * mt)::BIGINT AS token_budget
       FROM (SELECT source, least(count(*), 20) AS samples FROM documents GROUP BY source),
            (SELECT row_number() OVER (ORDER BY t, tp, tk, mt, rp)::INTEGER - 1 AS combination, *
             FROM (SELECT unnest([0.0, 0.1, 0.3, 0.7])::DOUBLE AS t), (SELECT unnest([0.3, 0.7, 0.9])::DOUBLE AS tp),
                  (SELECT unnest([10, 30, 50]) AS tk), (SELECT unnest([100, 200, 300]) AS mt),
                  (SELECT unnest([1.0, 1.1])::DOUBLE AS rp))""",
)
def j4(spark, d):
    """Work plan: every parameter combination for every dataset, at most 20 samples each."""
    datasets = views.samples(spark, d).groupBy(F.col("category").alias("dataset")).agg(
        F.least(F.count(F.lit(1)), F.lit(20)).alias("samples")
    )
    plan = tr.with_grid(datasets)
    return plan.withColumn("token_budget", F.col("samples") * F.col("max_new_tokens"))


@query(
    "p1_grid_sample",
    """SELECT dataset, combination FROM (
           SELECT source AS dataset, combination,
                  row_number() OVER (PARTITION BY source ORDER BY ((combination % 1000003) * 2654435761 + 42 * 40503)
                                     % 4294967296, combination) AS r
           FROM (SELECT DISTINCT source FROM documents), (SELECT unnest(range(0, 216))::INTEGER AS combination))
       WHERE r <= 20""",
)
def p1(spark, d):
    datasets = views.samples(spark, d).select(F.col("category").alias("dataset")).distinct()
    return tr.sample_grid(tr.with_grid(datasets), ["dataset"]).select("dataset", "combination")


def wild(spark, d):
    """Trials whose parameters partly leave their ranges."""
    t = numbered(views.trials(spark, d))
    return t.select(
        "study", "o", "l", "p", "x",
        (F.col("temperature") * 3 - 0.3).alias("temperature"),
        (F.col("top_p") * 1.2).alias("top_p"),
        (F.col("top_k") + 10).alias("top_k"),
        (F.col("max_new_tokens") * 5).alias("max_new_tokens"),
        (F.col("max_new_tokens") * 4 + F.col("top_k") * 6).alias("min_new_tokens"),
        (F.col("repetition_penalty") - 0.02).alias("repetition_penalty"),
    )


WILD = """(SELECT study, o, l, p, x, temperature * 3 - 0.3::DOUBLE AS temperature, top_p * 1.2::DOUBLE AS top_p,
                  top_k + 10 AS top_k, max_new_tokens * 5 AS max_new_tokens,
                  max_new_tokens * 4 + top_k * 6 AS min_new_tokens, repetition_penalty - 0.02::DOUBLE AS repetition_penalty
           FROM trials)"""
CLAMPED = f"""(SELECT study, o, l, p, x, least(greatest(temperature, 0), 2) AS t, least(greatest(top_p, 0.01::DOUBLE), 1) AS tp,
                      least(greatest(top_k, 1), 100) AS tk, least(greatest(max_new_tokens, 1), 2048) AS mx,
                      least(greatest(repetition_penalty, 1), 2) AS rp, temperature, top_p, top_k, max_new_tokens,
                      min_new_tokens, repetition_penalty FROM {WILD})"""
CHANGED = "t <> temperature OR tp <> top_p OR tk <> top_k OR mx <> max_new_tokens OR rp <> repetition_penalty"


@query(
    "p2_range_clamp",
    f"""SELECT study, o, l, p, x, round(t, 6) AS temperature, round(tp, 6) AS top_p, tk AS top_k, mx AS max_new_tokens,
               mn AS min_new_tokens, round(rp, 6) AS repetition_penalty, t <> 0 AS do_sample,
               {CHANGED} OR mn <> min_new_tokens AS was_changed
        FROM (SELECT *, CASE WHEN min_new_tokens > mx THEN 1 ELSE min_new_tokens END AS mn FROM {CLAMPED})""",
)
def p2(spark, d):
    return rounded(tr.clamp_params(wild(spark, d)))


@query(
    "p2_range_clamp_min_to_max",
    f"""SELECT study, o, l, p, x, mn AS min_new_tokens, {CHANGED} OR mn <> min_new_tokens AS was_changed
        FROM (SELECT *, greatest(1, least(mx, min_new_tokens)) AS mn FROM {CLAMPED})""",
)
def p2_min_to_max(spark, d):
    out = tr.clamp_params(wild(spark, d), min_to_max=True)
    return out.select("study", "o", "l", "p", "x", "min_new_tokens", "was_changed")


@query(
    "p3_range_audit",
    f"""SELECT study, violations, count(*) AS trials FROM (
            SELECT study, concat_ws(',', CASE WHEN temperature NOT BETWEEN 0 AND 2 THEN 'temperature' END,
                                    CASE WHEN top_p NOT BETWEEN 0.01::DOUBLE AND 1 THEN 'top_p' END,
                                    CASE WHEN top_k NOT BETWEEN 1 AND 100 THEN 'top_k' END,
                                    CASE WHEN min_new_tokens > max_new_tokens THEN 'min_new_tokens' END) AS violations
            FROM {WILD}) WHERE violations <> '' GROUP BY study, violations""",
)
def p3(spark, d):
    audited = tr.audit_params(wild(spark, d)).withColumn("violations", F.array_join("violations", ","))
    return audited.groupBy("study", "violations").agg(F.count(F.lit(1)).alias("trials"))


def trial_samples(spark, d):
    """Sample scores per (study, trial): some invalid, some failed."""
    t = numbered(views.trials(spark, d))
    return t.select(
        "study", F.col("o").alias("trial"), (F.col("score") - 0.05).alias("score"),
        (F.col("state") == "failed").alias("failed"),
    )


P4 = """SELECT study, o AS trial, count(*) AS samples, count(*) FILTER (state = 'failed') AS failures,
               round(CASE WHEN count(*) FILTER (state = 'failed') = count(*) THEN {empty}
                     ELSE avg(score - 0.05::DOUBLE) FILTER (state <> 'failed' AND score - 0.05::DOUBLE >= 0) END, 6) AS score
        FROM trials GROUP BY study, o"""


@query("p4_trial_score", P4.format(empty="0"))
def p4(spark, d):
    return rounded(tr.trial_scores(trial_samples(spark, d), ["study", "trial"]))


@query("p4_trial_score_failed_as_null", P4.format(empty="NULL"))
def p4_null(spark, d):
    return rounded(tr.trial_scores(trial_samples(spark, d), ["study", "trial"], failed_as_zero=False))


@query(
    "p5_best_trial",
    """SELECT study, round(temperature, 6) AS temperature, round(top_p, 6) AS top_p, top_k, max_new_tokens,
              round(repetition_penalty, 6) AS repetition_penalty, round(best_score, 6) AS best_score, trials,
              first_ts, last_ts FROM opt_runs""",
)
def p5(spark, d):
    return rounded(tr.best_trial(views.trials(spark, d), ["study"]))


@query(
    "p6_running_best",
    f"""SELECT study, o, l, p, x, round(greatest(max(score) OVER w, 0), 6) AS best_so_far,
               row_number() OVER w - 1 AS trial_number
        FROM trials WINDOW w AS (PARTITION BY study ORDER BY {ORDER} ROWS UNBOUNDED PRECEDING)""",
)
def p6(spark, d):
    t = numbered(views.trials(spark, d)).select("study", "o", "l", "p", "x", "score")
    return rounded(tr.running_best(t, ["study"], ["o", "l", "p", "x"]).drop("score"))


@query(
    "p7_median_rule",
    """SELECT study, trial, step, round(best_so_far, 6) AS best_so_far, n_before, round(median_before, 6) AS median_before,
              completed_before,
              coalesce(completed_before >= 3 AND step >= 2 AND best_so_far < median_before, false) AS stop
       FROM (SELECT *, max(value) OVER (PARTITION BY study, trial ORDER BY step) AS best_so_far,
                    count(*) FILTER (complete) OVER w AS n_before,
                    quantile_cont(value, 0.5) FILTER (complete) OVER w AS median_before
             FROM step_reports
             WINDOW w AS (PARTITION BY study, step ORDER BY trial ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
       JOIN (SELECT study, trial,
                    coalesce(sum(complete::INT) OVER (PARTITION BY study ORDER BY trial
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS completed_before
             FROM (SELECT DISTINCT study, trial, complete FROM step_reports)) USING (study, trial)""",
)
def p7(spark, d):
    out = tr.median_rule(views.step_reports(spark, d))
    return rounded(
        out.select("study", "trial", "step", "best_so_far", "n_before", "median_before", "completed_before", "stop")
    )


BINNED = """(SELECT study, parameter, bin, coalesce(score, 0) AS score FROM (
    SELECT study, score, unnest([{'n': 'temperature', 'b': floor(temperature * 10 + 0.5) / 10},
                                 {'n': 'top_p', 'b': floor(top_p * 10 + 0.5) / 10},
                                 {'n': 'top_k', 'b': floor(top_k / 10) * 10},
                                 {'n': 'max_new_tokens', 'b': floor(max_new_tokens / 100) * 100},
                                 {'n': 'repetition_penalty', 'b': floor(repetition_penalty * 100 + 0.5) / 100}]) AS s
    FROM trials), LATERAL (SELECT s.n AS parameter, s.b::DOUBLE AS bin))"""


@query(
    "p8_parameter_bins",
    f"""SELECT parameter, round(bin, 6) AS bin, round(avg(score), 6) AS performance, count(*) AS sample_count
        FROM {BINNED} GROUP BY parameter, bin""",
)
def p8(spark, d):
    return rounded(tr.parameter_bins(views.trials(spark, d)))


@query(
    "p8_best_bins",
    f"""SELECT study, parameter, round(bin, 6) AS value, round(performance, 6) AS performance, sample_count
        FROM (SELECT study, parameter, bin, avg(score) AS performance, count(*) AS sample_count FROM {BINNED} GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY study, parameter ORDER BY performance DESC, bin) = 1""",
)
def p8_best(spark, d):
    bins = tr.parameter_bins(views.trials(spark, d), ["study"])
    return rounded(tr.best_bins(bins, ["study"]))


@query(
    "p9_score_trend",
    """SELECT model, count(*) AS total_experiments, round(max(best_score), 6) AS top_score,
              round(min(best_score), 6) AS worst_score, round(avg(best_score), 6) AS average_score,
              round(var_pop(best_score), 6) AS score_variance,
              CASE WHEN b > a THEN 'improving' ELSE 'declining' END AS score_trend,
              round(CASE WHEN count(*) > 1 THEN (b - a) / count(*) ELSE 0 END, 6) AS improvement_rate
       FROM (SELECT *, first_value(best_score) OVER w AS a,
                    last_value(best_score) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS b
             FROM opt_runs WINDOW w AS (PARTITION BY model ORDER BY last_ts, run_id))
       GROUP BY model, a, b""",
)
def p9(spark, d):
    return rounded(tr.score_trend(opt(spark, d), ["model"], ["last_ts", "run_id"]))


@query(
    "p10_recommendations",
    """SELECT run_id, concat_ws(',', CASE WHEN temperature < 0.1::DOUBLE THEN 'low_temperature' END,
                                CASE WHEN temperature > 0.8::DOUBLE THEN 'high_temperature' END,
                                CASE WHEN top_p < 0.3::DOUBLE THEN 'low_top_p' END,
                                CASE WHEN memory_peak > 80 THEN 'high_memory' END,
                                CASE WHEN cpu_peak > 90 THEN 'high_cpu' END,
                                CASE WHEN success_rate < 0.5 THEN 'low_success' END,
                                CASE WHEN best_score < 0.7 THEN 'low_score' END,
                                CASE WHEN best_score > 0.9 THEN 'high_score' END) AS advice,
              (temperature < 0.1::DOUBLE)::INT + (temperature > 0.8::DOUBLE)::INT + (top_p < 0.3::DOUBLE)::INT
                  + (memory_peak > 80)::INT + (cpu_peak > 90)::INT + (success_rate < 0.5)::INT
                  + (best_score < 0.7)::INT + (best_score > 0.9)::INT AS texts
       FROM opt_runs
       JOIN (SELECT study, count(*) FILTER (state = 'complete') / count(*) AS success_rate FROM trials GROUP BY study)
           USING (study)
       JOIN (SELECT model, max(memory_percent) AS memory_peak, max(cpu_percent) AS cpu_peak
             FROM host_metrics GROUP BY model) USING (model)""",
)
def p10(spark, d):
    rates = tr.study_summary(views.trials(spark, d), ["study"]).select("study", "success_rate")
    hosts = ro.host_summary(views.host_metrics(spark, d), ["model"]).select("model", "memory_peak", "cpu_peak")
    advised = tr.recommendations(opt(spark, d).join(rates, "study").join(hosts, "model"))
    return advised.select(
        "run_id", F.array_join("advice", ",").alias("advice"), F.size(tr.advice_texts(F.col("advice"))).alias("texts")
    )


def _advice_sql():
    texts = {code: quoted(text) for code, text in tr.ADVICE.items()}
    rate = "printf('%.1f%%', success_rate * 100 + 1e-9)"
    use = "printf('%.1f%%', utilization * 100 + 1e-9)"
    low = f"replace({texts['low_success']}, '{{success_rate}}', {rate})"
    high = f"replace(replace({texts['high_utilization']}, '{{utilization}}', {use}), '{{device}}', 'cuda:' || device)"
    return f"""
        SELECT run_id, concat_ws(' | ', CASE WHEN success_rate < 0.5 THEN {low} END, CASE WHEN utilization > 0.9 THEN {high} END,
                   CASE WHEN best_score < 0.7 THEN {texts['low_score']} END, CASE WHEN best_score > 0.9 THEN {texts['high_score']} END) AS advice
        FROM opt_runs JOIN (SELECT study, count(*) FILTER (state = 'complete') / count(*) AS success_rate FROM trials GROUP BY study) USING (study)
        JOIN (SELECT device, avg(utilization) * 1.5 AS utilization FROM device_metrics GROUP BY device) ON device = study % 16"""


@query("p10_advice_texts", _advice_sql())
def p10_texts(spark, d):
    """The texts themselves, with each run's success rate and its device's utilisation in them."""
    rates = tr.study_summary(views.trials(spark, d), ["study"]).select("study", "success_rate")
    devices = views.device_metrics(spark, d).groupBy("device").agg((F.avg("utilization") * 1.5).alias("utilization"))
    runs = opt(spark, d).select("run_id", "study", "best_score").join(rates, "study").withColumn("device", F.col("study") % 16).join(devices, "device")
    figures = {
        "success_rate": tr.percent(F.col("success_rate")), "utilization": tr.percent(F.col("utilization")),
        "device": F.concat(F.lit("cuda:"), F.col("device").cast("string")),
    }
    advised = tr.recommendations(runs)
    return advised.select("run_id", F.array_join(tr.advice_texts(F.col("advice"), figures), " | ").alias("advice"))


def _board(metric, sql_order):
    return f"""SELECT model, dataset, day, round({metric}, 6) AS {metric},
                      row_number() OVER (PARTITION BY dataset, day ORDER BY {sql_order}, model)::INTEGER AS "rank"
               FROM bench_runs"""


def _leaderboard(metric):
    def run(spark, d):
        ranked = compare.leaderboard(bench(spark, d), metric, ["dataset", "day"])
        return rounded(ranked.select("model", "dataset", "day", metric, "rank"))

    return run


for _name, _metric, _order in (
    ("accuracy", "accuracy", "accuracy DESC"),
    ("speed", "tokens_per_second", "tokens_per_second DESC"),
    ("efficiency", "overall_efficiency", "overall_efficiency DESC"),
    ("cost", "cost_per_1k_tokens_usd", "cost_per_1k_tokens_usd"),
):
    query(f"w1_leaderboard_{_name}", _board(_metric, _order))(_leaderboard(_metric))


@query(
    "w2_optimization_report",
    """SELECT model, dataset, round(best_score, 6) AS best_score, round(temperature, 6) AS temperature,
              round(top_p, 6) AS top_p, round((epoch_us(last_ts) - epoch_us(first_ts)) / 1000000, 6) AS run_time_s, run_id
       FROM opt_runs ORDER BY best_score DESC, run_id""",
)
def w2_opt(spark, d):
    out = opt(spark, d).withColumn("run_time_s", ro.seconds_between(F.col("first_ts"), F.col("last_ts")))
    out = out.select(*RUN, "best_score", "temperature", "top_p", "run_time_s", "run_id")
    return rounded(out.orderBy(F.desc("best_score"), "run_id"))


@query(
    "w2_benchmark_report",
    """SELECT model, dataset, day, round(tokens_per_second, 6) AS tokens_per_second, round(latency_p95, 6) AS latency_p95,
              memory_usage_mb, round(cost_per_1k_tokens_usd, 6) AS cost_per_1k_tokens_usd,
              round(overall_efficiency, 6) AS overall_efficiency
       FROM bench_runs""",
)
def w2_bench(spark, d):
    out = bench(spark, d).select(
        *RUN, "day", "tokens_per_second", "latency_p95", "memory_usage_mb", "cost_per_1k_tokens_usd", "overall_efficiency"
    )
    return rounded(out.orderBy(F.desc("tokens_per_second"), *RUN, "day"))


@query("w3_best_per_model", "SELECT model, round(max(best_score), 6) AS best_score FROM opt_runs GROUP BY model")
def w3(spark, d):
    return rounded(compare.best_per_model(opt(spark, d)))


@query(
    "w4_score_series",
    """SELECT dataset, run_id, model, round(best_score, 6) AS best_score,
              row_number() OVER (PARTITION BY dataset ORDER BY last_ts, run_id) - 1 AS sequence
       FROM opt_runs""",
)
def w4(spark, d):
    runs = opt(spark, d).select("dataset", "run_id", "model", "best_score", "last_ts")
    return rounded(compare.score_series(runs, ["dataset"], ["last_ts", "run_id"]).drop("last_ts"))


@query(
    "w5_hardware_matrix",
    """WITH h AS (SELECT model, avg(cpu_percent) AS cpu_avg, max(memory_percent) AS memory_peak,
                         max(gpu_memory_gb) AS gpu_memory_peak FROM host_metrics GROUP BY model)
       SELECT model, 'cpu_avg' AS metric, round(cpu_avg, 6) AS value FROM h
       UNION ALL SELECT model, 'memory_peak', round(memory_peak, 6) FROM h
       UNION ALL SELECT model, 'gpu_memory_peak', round(gpu_memory_peak, 6) FROM h""",
)
def w5(spark, d):
    return rounded(compare.hardware_matrix(ro.host_summary(views.host_metrics(spark, d), ["model"])))


@query(
    "w6_parameter_scatter",
    """SELECT run_id, model, round(temperature, 6) AS temperature, round(top_p, 6) AS top_p,
              round(best_score, 6) AS best_score FROM opt_runs""",
)
def w6(spark, d):
    return rounded(opt(spark, d).select("run_id", "model", "temperature", "top_p", "best_score"))


@query(
    "w6_parameter_correlation",
    """SELECT model, count(*) AS runs, round(corr(temperature, score), 6) AS temperature_score,
              round(corr(top_p, score), 6) AS top_p_score, round(corr(temperature, top_p), 6) AS temperature_top_p
       FROM trials GROUP BY model""",
)
def w6_corr(spark, d):
    t = views.trials(spark, d).withColumnRenamed("score", "best_score")
    return rounded(compare.parameter_correlation(t, ["model"]))


@query(
    "w7_latest_per_key",
    """SELECT deployment, ts, tick_id, cpu_percent, memory_percent FROM host_metrics
       QUALIFY row_number() OVER (PARTITION BY deployment ORDER BY ts DESC, tick_id DESC) = 1""",
)
def w7(spark, d):
    return compare.latest_per_key(
        views.host_metrics(spark, d), ["deployment"], ["ts", "tick_id"], ["ts", "tick_id", "cpu_percent", "memory_percent"]
    )


@query(
    "w8_last_100_per_key",
    """SELECT deployment, ts, tick_id, cpu_percent, position::INTEGER AS position FROM (
           SELECT *, row_number() OVER (PARTITION BY deployment ORDER BY ts DESC, tick_id DESC) AS position
           FROM host_metrics WHERE ts >= TIMESTAMP '2024-01-08 00:00:00')
       WHERE position <= 100""",
)
def w8(spark, d):
    since = F.to_timestamp_ntz(F.lit("2024-01-08 00:00:00"))
    out = compare.last_n_per_key(views.host_metrics(spark, d), ["deployment"], ["ts", "tick_id"], 100, since)
    return out.select("deployment", "ts", "tick_id", "cpu_percent", "position")


@query(
    "w10_filtered_runs",
    """SELECT model, dataset, day, round(accuracy, 6) AS accuracy, round(tokens_per_second, 6) AS tokens_per_second,
              row_number() OVER (PARTITION BY dataset, day ORDER BY accuracy DESC, model)::INTEGER AS "rank"
       FROM bench_runs WHERE model IN ('m1', 'm3', 'm5') AND dataset IN ('d0', 'd2')""",
)
def w10(spark, d):
    kept = compare.filter_runs(scored(spark, d), ["m1", "m3", "m5"], ["d0", "d2"])
    ranked = compare.leaderboard(compare.bench_runs(kept, cpu=cpu_load()), "accuracy", ["dataset", "day"])
    return rounded(ranked.select(*RUN, "day", "accuracy", "tokens_per_second", "rank"))


def halves(spark, d):
    return abtest.assign_halves(scored(spark, d).select("dataset", "request_id", "score"), ["dataset"], "request_id")


HALVES = """(SELECT dataset, request_id, score,
                    CASE WHEN row_number() OVER (PARTITION BY dataset ORDER BY request_id)
                              <= count(*) OVER (PARTITION BY dataset) // 2 THEN 'a' ELSE 'b' END AS variant
             FROM scored)"""


@query("b1_assign_halves", f"SELECT dataset, request_id, variant FROM {HALVES}")
def b1(spark, d):
    return halves(spark, d).select("dataset", "request_id", "variant")


@query(
    "b1_assign_by_hash",
    "SELECT request_id, CASE WHEN md5('0:' || request_id::VARCHAR) < '8' THEN 'a' ELSE 'b' END AS variant FROM scored",
)
def b1_hash(spark, d):
    return abtest.assign_by_hash(scored(spark, d), "request_id").select("request_id", "variant")


@query(
    "b2_variant_summary",
    f"""SELECT dataset, variant, count(score) AS samples_count, round(avg(score), 6) AS avg_score,
               round(stddev_pop(score), 6) AS std_score FROM {HALVES} GROUP BY dataset, variant""",
)
def b2(spark, d):
    return rounded(abtest.variant_summary(halves(spark, d), ["dataset"]))


MOMENTS = f"""(SELECT dataset, count(score) FILTER (variant = 'a') AS na, avg(score) FILTER (variant = 'a') AS ma,
                      var_samp(score) FILTER (variant = 'a') AS va, count(score) FILTER (variant = 'b') AS nb,
                      avg(score) FILTER (variant = 'b') AS mb, var_samp(score) FILTER (variant = 'b') AS vb
               FROM {HALVES} GROUP BY dataset)"""


@query(
    "b3_winner",
    f"""SELECT dataset, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, CASE WHEN ma > mb THEN 'a' ELSE 'b' END AS winner
        FROM {MOMENTS}""",
)
def b3(spark, d):
    out = abtest.compare_variants(halves(spark, d), ["dataset"])
    return rounded(out.select("dataset", "mean_a", "mean_b", "winner"))


@query(
    "b4_t_statistic",
    f"""SELECT dataset, na + nb - 2 AS dof,
               round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1 / na + 1 / nb)), 6) AS t
        FROM {MOMENTS}""",
)
def b4(spark, d):
    return rounded(abtest.compare_variants(halves(spark, d), ["dataset"]).select("dataset", "dof", "t"))


# The same fraction, with the gamma function of the engine.
_EVEN = "(floor(k / 2)) * (q - floor(k / 2)) * y / ((p + 2 * (floor(k / 2)) - 1) * (p + 2 * (floor(k / 2))))"
_ODD = "-(p + floor(k / 2)) * (p + q + floor(k / 2)) * y / ((p + 2 * (floor(k / 2))) * (p + 2 * (floor(k / 2)) + 1))"
P_VALUE = f"""
    SELECT *, CASE WHEN swapped THEN 1 - tail ELSE tail END AS p_value
    FROM (SELECT *, CASE WHEN y <= 0 THEN 0
                         ELSE exp(lgamma(p + q) - lgamma(p) - lgamma(q) - ln(p) + p * ln(y) + q * ln(1 - y))
                              / list_reduce(
                                    list_prepend(1.0::DOUBLE, list_transform(range(200 + 4 * ceil(sqrt(dof))::INT, 0, -1), lambda k: k::DOUBLE)),
                                    lambda below, k: 1 + CASE WHEN k % 2 = 0 THEN {_EVEN} ELSE {_ODD} END / below) END AS tail
          FROM (SELECT *, CASE WHEN swapped THEN 0.5::DOUBLE ELSE dof / 2 END AS p,
                       CASE WHEN swapped THEN dof / 2 ELSE 0.5::DOUBLE END AS q,
                       CASE WHEN swapped THEN t * t / (dof + t * t) ELSE x END AS y
                FROM (SELECT *, x > (dof / 2 + 1) / (dof / 2 + 2.5) AS swapped
                      FROM (SELECT *, dof / (dof + t * t) AS x
                            FROM (SELECT dataset, ma, mb, na + nb - 2 AS dof,
                                         (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1 / na + 1 / nb)) AS t
                                  FROM {MOMENTS})))))"""


@query(
    "b4_confidence",
    f"""SELECT dataset, round(t, 6) AS t, dof, round(p_value, 6) AS p_value,
               round(coalesce(least((1 - p_value) * 100, 99.9), 50), 6) AS confidence,
               CASE WHEN ma > mb THEN 'a' ELSE 'b' END AS winner
        FROM ({P_VALUE})""",
)
def b4_confidence(spark, d):
    out = abtest.with_confidence(abtest.compare_variants(halves(spark, d), ["dataset"]))
    return rounded(out.select("dataset", "t", "dof", "p_value", "confidence", "winner"))
