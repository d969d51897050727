"""Rows that earlier versions lost: null keys, failed trials, late readings, exception subclasses."""

import pytest
from pyspark.sql import functions as F

from tallymark.functions.text import contains_match
from tallymark.operators import errors, rollup, trials
from tallymark.operators.telemetry import window_summary
from tallymark.plans.registry import nudged, rounded
from tallymark.session import scratch_path
from tallymark.sources import views
from tallymark.streaming import telemetry as st


def test_null_keys_are_groups(spark):
    rows = [(None, 1.0, 5.0, 10.0), (None, 3.0, 5.0, 10.0), ("a", 4.0, 5.0, 10.0)]
    df = spark.createDataFrame(rows, "model string, latency_s double, tokens_per_second double, memory_usage_mb double")
    got = {r.model: r.latency_p50 for r in rollup.run_metrics(df, ["model"]).collect()}
    assert got == {None: 2.0, "a": 4.0}
    assert {r.model: r.avg_latency for r in rollup.latency_block(df, ["model"]).collect()} == {None: 2.0, "a": 4.0}
    assert {r.model: r.latency_p50 for r in rollup.index_percentiles(df, ["model"]).collect()} == {None: 3.0, "a": 4.0}


def test_running_totals_keep_null_keys(spark):
    from tallymark.functions.sequence import with_row_number

    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "k string, o int")
    assert sorted((r.k or "", r.o, r.row_number) for r in with_row_number(df, ["k"], ["o"]).collect()) == [
        ("", 1, 1), ("", 2, 2), ("a", 1, 1)
    ]


def _trials(spark, rows):
    full = [(1, i, score, state, 0.1, 0.9, 10 + i, 100, 1.0, i) for i, (score, state) in enumerate(rows)]
    return spark.createDataFrame(
        full,
        "study int, trial int, score double, state string, temperature double, top_p double, top_k int, "
        "max_new_tokens int, repetition_penalty double, ts int",
    )


def test_only_completed_trials_win(spark):
    rows = [(0.4, "complete"), (0.99, "failed"), (0.98, "pruned"), (float("nan"), "complete"), (0.6, "complete"), (None, "complete")]
    df = _trials(spark, rows)
    best = trials.best_trial(df, ["study"]).first()
    assert (best.best_score, best.top_k, best.trials) == (0.6, 14, 6)
    so_far = [r.best_so_far for r in trials.running_best(df, ["study"], ["trial"]).orderBy("trial").collect()]
    assert so_far == [0.4, 0.4, 0.4, 0.4, 0.6, 0.6]
    summary = trials.study_summary(df, ["study"]).first()
    assert (summary.best_value, summary.best_trial, summary.successful_trials) == (0.6, 4, 4)


def test_best_trial_agrees_with_the_summary(spark, data):
    df = views.trials(spark, data)
    best = trials.best_trial(df, ["study"]).select("study", "best_score")
    both = best.join(trials.study_summary(df, ["study"]).select("study", "best_value"), "study").collect()
    assert both and all(r.best_score == (r.best_value or 0.0) for r in both)


def test_trend_passes_over_what_is_no_number(spark):
    df = spark.createDataFrame([("m", 1, 0.2), ("m", 2, float("nan")), ("m", 3, 0.5)], "model string, ts int, best_score double")
    row = trials.score_trend(df, ["model"], ["ts"]).first()
    assert row.top_score == 0.5 and row.average_score == pytest.approx(0.35) and row.score_trend == "improving"


def test_streams_over_unsorted_files_lose_nothing(spark, data):
    folder = scratch_path(spark, "unsorted")
    views.table(spark, data, "events").repartition(6, "event_id").write.parquet(folder)
    ticks = st.metric_ticks(st.read_events(spark, folder, files_per_trigger=1))
    stream = st.run_upsert(spark, st.windowed_summary(ticks, ["deployment"], "6 hours"), "summary", ["deployment", "window"])
    hosts = views.host_metrics(spark, data).withColumn("ts", F.col("ts").cast("timestamp"))
    batch = window_summary(hosts, ["deployment"], F.window("ts", "6 hours"))
    keys = ["deployment", "window", "ticks", "cpu_peak"]
    assert sorted(map(str, stream.select(keys).collect())) == sorted(map(str, batch.select(keys).collect()))


@pytest.mark.parametrize(
    "kind,category,severity",
    [("ConnectionResetError", "permission", "low"), ("BrokenPipeError", "permission", "low"), ("JSONDecodeError", "unknown", "medium"),
     ("UnicodeDecodeError", "unknown", "medium"), ("ModuleNotFoundError", "dependency", "medium"), ("KeyError", "unknown", "low")],
)
def test_exception_subclasses(spark, kind, category, severity):
    df = spark.createDataFrame([("something odd", kind)], "message string, exception_type string")
    row = errors.classify(df).first()
    assert (row.category, row.severity) == (category, severity)


def test_any_number_of_patterns(spark):
    patterns = spark.range(20_000).select(
        F.col("id").alias("priority"), F.format_string("p%05d", F.col("id")).alias("pattern"), F.lit("c").alias("category")
    )
    df = spark.createDataFrame([("has P19999 in it",), ("none",)], "message string")
    assert [(r.message, r.pattern) for r in errors.first_match(df, patterns).orderBy("message").collect()] == [
        ("has P19999 in it", "p19999"), ("none", None)
    ]


def test_small_costs_keep_their_digits(spark):
    df = spark.createDataFrame([(2.5e-8, 2.5e-8)], "cost_per_token_usd double, other double")
    row = rounded(df).first()
    assert row.cost_per_token_usd == pytest.approx(2.5e-8) and row.other == 0.0
    assert nudged("round(a, 6) AS cost_per_token_usd").endswith("/ 1000000.0 AS cost_per_token_usd")


def test_long_source_names_stay_whole(spark, tmp_path):
    from tallymark.plans.source_queries import items

    row = (1, "t", "en", "a-long-source", 1)
    spark.createDataFrame([row], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    assert items(spark, str(tmp_path)).first().problem == 'Q1: "a-long-source"'


def test_short_items_are_found(spark, tmp_path):
    docs = [(1, "He said: Concatenate the two lists now.", "s"), (2, "nothing here", "s"), (3, None, "s"), (4, "x the two lists", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    items = [(1, "cat"), (2, "the two lists"), (3, "CONCATENATE the two lists now."), (4, " "), (5, "lists now"), (6, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    pairs = views.pairs_contains(spark, str(tmp_path)).where(contains_match(F.col("prediction"), F.col("truth")) == 1)
    assert sorted((r.doc_id, r.item_id) for r in pairs.collect()) == [(1, 1), (1, 2), (1, 3), (1, 5), (4, 2)]


def test_exact_match_shuffles_no_text(spark, data):
    from tallymark.plans import QUERIES

    plan = QUERIES["e1_exact_match"](spark, data)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange" in line and "text" in line]
    assert not moved


def test_scratch_can_be_cleared(spark):
    from tallymark.session import clear_scratch

    path = scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    clear_scratch(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_advice_says_the_measured_figures(spark):
    from tallymark.operators import trials

    df = spark.createDataFrame([(0.125, 0.955, "cuda:3"), (0.9, 0.2, None)], "success_rate double, utilization double, device string")
    figures = {"success_rate": trials.percent(F.col("success_rate")), "utilization": trials.percent(F.col("utilization")), "device": F.col("device")}
    out = trials.recommendations(df).select(trials.advice_texts(F.col("advice"), figures).alias("t"), trials.advice_texts(F.col("advice")).alias("plain")).collect()
    assert out[0].t == ["Trial 성공률이 낮습니다 (12.5%). 메모리나 시간 제한을 확인하세요.", "cuda:3 사용률이 높습니다 (95.5%). 배치 크기를 줄이거나 양자화를 고려하세요."]
    assert out[1].t == [] and "(success_rate)" in out[0].plain[0]


def test_running_totals_by_key_equal_those_of_whole_rows(spark):
    from tallymark.functions.sequence import with_running

    rows = [(k, i, float((i * 7) % 5), "payload") for k in ("a", None) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, i int, v double, text string")
    totals = {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}
    one, two = (with_running(df, ["k"], ["i"], totals, 4, lean=x).select("k", "i", "text", "s", "m").collect() for x in (False, True))
    assert sorted(map(tuple, one), key=repr) == sorted(map(tuple, two), key=repr) and len(two) == 100
