"""Files, retention, trial rules and streams beyond what the queries cover."""

import json
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallymark.functions import lexicons as lx
from tallymark.operators import abtest, samples, telemetry, trials
from tallymark.operators.errors import classify
from tallymark.sources import runs, samples_io
from tallymark.streaming import scaling
from tallymark.streaming import telemetry as st

MATH = [
    {"problem": "24개에서 8개를 빼면?", "solution": "24 - 8 = 16", "answer": "16", "category": "기본", "language": "ko"},
    {"problem": "How many?", "solution": "5 + 3 = 8 fruits", "answer": "8", "language": "en"},
    {"problem": "답 없음"},
    {"problem": "言語なし", "solution": "1"},
    {"problem": "Autre", "solution": "2", "language": "fr"},
]


def test_list_samples(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(MATH, ensure_ascii=False, indent=2), encoding="utf-8")
    rows = samples_io.load_samples(spark, "korean_math", str(tmp_path)).orderBy("sample_id").collect()
    assert [r["sample_id"] for r in rows] == ["0", "1", "3", "4"]
    assert rows[0]["question"] == MATH[0]["problem"] and rows[0]["answer"] == "24 - 8 = 16"
    assert rows[0]["metadata"] == {"answer": "16"}
    assert rows[2]["language"] == "ko"
    some = samples_io.load_samples(spark, "multilingual_math", str(tmp_path)).collect()
    assert sorted(r["sample_id"] for r in some) == ["0", "1", "3"]


def test_keyed_samples_and_unknown_loader(spark, tmp_path):
    items = {"x1": {"question": "q", "answer": "a", "extra": [1, 2]}, "x2": {"question": "only"}}
    (tmp_path / "k.json").write_text(json.dumps(items), encoding="utf-8")
    rows = samples_io.load_samples(spark, "keyed", str(tmp_path)).collect()
    assert [(r["sample_id"], r["metadata"]) for r in rows] == [("x1", {"extra": "[1,2]"})]
    with pytest.raises(ValueError):
        samples_io.load_samples(spark, "nonesuch", str(tmp_path))


def test_run_files_by_pattern_with_rejects(spark, tmp_path):
    (tmp_path / "opt_1.json").write_text(
        json.dumps({"test_id": "opt_1", "model_name": "m", "best_score": 0.85, "total_time": 4.0,
                    "optimization_history": [{"trial_number": 0, "score": 0.5}]}, indent=2)
    )
    (tmp_path / "opt_2.json").write_text('{"test_id": "opt_2", "mod')
    (tmp_path / "grid_1.json").write_text(
        json.dumps({"trial_id": "grid_1", "model_name": "m", "best_score": 0.7, "optimization_time": 2.0})
    )
    (tmp_path / "bench_1.json").write_text(
        json.dumps({"test_id": "bench_1", "model_name": "m", "performance_metrics": {"tokens_per_second": 3.5}})
    )
    good, rejects = runs.read_runs(spark, str(tmp_path), "opt_*")
    assert [r["test_id"] for r in good.collect()] == ["opt_1"]
    assert [r["file"] for r in rejects.collect()] == ["opt_2.json"]
    everything, _ = runs.read_runs(spark, str(tmp_path))
    unified = {r["run_id"]: r for r in runs.unify_runs(everything).collect()}
    assert {k: v["run_type"] for k, v in unified.items()} == {
        "opt_1": "optimize", "grid_1": "optimize", "bench_1": "benchmark"
    }
    assert unified["grid_1"]["run_time_s"] == 2.0
    newest = runs.latest_runs(runs.unify_runs(everything), n=2).collect()
    assert len(newest) == 2 and newest[0]["modified_at"] >= newest[1]["modified_at"]


def test_store_and_retention(spark, tmp_path):
    df = spark.createDataFrame([("a", "optimize", 1), ("b", "benchmark", 40)], "run_id string, run_type string, age int")
    df = df.withColumn("ts", F.expr("timestamp_ntz'2024-03-01 00:00:00' - make_dt_interval(age)"))
    runs.store_runs(df, str(tmp_path / "all"))
    runs.store_runs(df, str(tmp_path / "all"))
    stored = spark.read.parquet(str(tmp_path / "all"))
    assert stored.count() == 4
    now = F.to_timestamp_ntz(F.lit("2024-03-01 00:00:00"))
    runs.keep_recent(stored, str(tmp_path / "kept"), now, days=30)
    assert {r["run_id"] for r in spark.read.parquet(str(tmp_path / "kept")).collect()} == {"a"}


def test_prompts(spark):
    df = spark.createDataFrame(
        [("llama3.1", "q {context}", "c"), ("llama2", "q", None), ("qwen2.5", "q", ""), ("unknown", "q", "c")],
        "family string, question string, context string",
    )
    out = [r[0] for r in df.select(samples.render_prompt(F.col("family"), F.col("question"), F.col("context"))).collect()]
    assert out[0] == lx.PROMPT_TEMPLATES["llama3"][1].replace("{context}", "c", 1).replace("{question}", "q {context}")
    assert out[1] == "<s>[INST] q [/INST]"
    assert out[2] == lx.PROMPT_TEMPLATES["qwen"][0].replace("{question}", "q")
    assert out[3] == "q"


def test_prompts_for_one_model(spark):
    df = spark.createDataFrame([("q", "c")], "question string, context string")
    want = lx.PROMPT_TEMPLATES["gemma"][1].replace("{context}", "c").replace("{question}", "q")
    assert samples.prompts_for_model(df, "google/Gemma-2-9b").first()["question"] == want


def test_trend_and_best_trial(spark):
    df = spark.createDataFrame([("m", 0.85, 1), ("m", 0.82, 2)], "model string, best_score double, ts int")
    row = trials.score_trend(df, ["model"], ["ts"]).first()
    assert row["score_trend"] == "declining"
    assert row["score_variance"] == pytest.approx(0.000225)
    assert row["improvement_rate"] == pytest.approx(-0.015)
    history = spark.createDataFrame(
        [("s", 0, 0.5, 0.4, 7, 8, 1.0, 0.9), ("s", 1, 0.7, 0.4, 7, 8, 1.0, 0.9), ("z", 0, 0.7, 0.4, 7, 8, 1.0, 0.0)],
        "study string, trial int, temperature double, top_p double, top_k int, max_new_tokens int, "
        "repetition_penalty double, score double",
    ).withColumn("ts", F.lit(0))
    best = {r["study"]: r for r in trials.best_trial(history, ["study"]).collect()}
    assert best["s"]["temperature"] == 0.5
    assert (best["z"]["temperature"], best["z"]["best_score"]) == (0.1, 0.0)


def test_advice(spark):
    df = spark.createDataFrame([(0.05, 0.95, 95.0)], "temperature double, best_score double, memory_peak double")
    codes = trials.recommendations(df).first()["advice"]
    assert codes == ["low_temperature", "high_memory", "high_score"]
    texts = trials.recommendations(df).select(trials.advice_texts(F.col("advice"))).first()[0]
    assert texts[0] == trials.ADVICE["low_temperature"]


@pytest.mark.parametrize("t, dof, p", [(2.0, 10, 0.07338803), (0.0, 5, 1.0), (1.96, 1e6, 0.04999575), (12.706205, 1, 0.05)])
def test_two_sided_p(spark, t, dof, p):
    row = spark.createDataFrame([(t, float(dof))], "t double, dof double")
    assert row.select(abtest.two_sided_p(F.col("t"), F.col("dof"))).first()[0] == pytest.approx(p, rel=1e-5)


def test_two_sided_p_agrees_with_closed_forms(spark):
    """One and two degrees have closed forms; very many are the normal distribution."""
    rows = [(t, dof) for t in (-40.0, -1.5, 0.0, 1e-6, 0.3, 2.0, 9.0) for dof in (1.0, 2.0, 1e9)]
    df = spark.createDataFrame(rows, "t double, dof double")
    for r in df.withColumn("p", abtest.two_sided_p(F.col("t"), F.col("dof"))).collect():
        want = {
            1.0: 1 - 2 * math.atan(abs(r.t)) / math.pi,
            2.0: 1 - abs(r.t) / math.sqrt(2 + r.t**2),
            1e9: math.erfc(abs(r.t) / math.sqrt(2)),
        }[r.dof]
        assert r.p == pytest.approx(want, abs=1e-8)
    nothing = spark.createDataFrame([(None, None), (1.0, 0.0)], "t double, dof double")
    assert {r[0] for r in nothing.select(abtest.two_sided_p(F.col("t"), F.col("dof"))).collect()} == {None}


def test_error_rules(spark):
    df = spark.createDataFrame(
        [("CUDA out of memory", "RuntimeError"), ("cuda failure", "RuntimeError"), ("x", "ModuleNotFoundError"),
         ("x", "FileNotFoundError"), ("bad setting", "KeyError"), ("loading", "KeyError"), ("connection lost", "KeyError")],
        "message string, exception_type string",
    )
    got = [(r["category"], r["severity"]) for r in classify(df).collect()]
    assert got == [
        ("memory", "high"), ("memory", "low"), ("dependency", "medium"), ("permission", "low"),
        ("configuration", "low"), ("model_loading", "low"), ("network", "low"),
    ]
    assert classify(df).first()["suggestions"][0] == "배치 크기를 줄여보세요"


def test_payload_parsing(spark):
    df = spark.createDataFrame([('{"cpu_percent": 12.5, "gpu_memory_used": 3}',), ("not json",)], "payload string")
    rows = st.parse_payload(df).collect()
    assert (rows[0]["cpu_percent"], rows[0]["gpu_memory_used"], rows[0]["disk_usage"]) == (12.5, 3.0, None)
    assert rows[1]["cpu_percent"] is None


def test_own_alert_rule(spark):
    df = spark.createDataFrame([(1, 5.0)], "k int, gpu double").withColumn("ts", F.current_timestamp())
    rule = telemetry.AlertRule("gpu", "gpu > 4", "too much", "critical")
    assert telemetry.alerts(df, "k", [rule]).first()["rule"] == "gpu"


def test_scaling_steps_honour_cooldown_and_limits():
    policy = telemetry.ScalingPolicy()
    ticks = pd.DataFrame({"tick": [0, 100, 300, 900], "load": [0.9, 0.9, 0.9, 0.1], "response_s": [0.5] * 4})
    changes, replicas, changed = telemetry.scale_steps(ticks, 1, float("-inf"), policy)
    assert list(changes.itertuples(index=False, name=None)) == [(0, "up", 2), (300, "up", 3), (900, "down", 2)]
    assert (replicas, changed) == (2, 900.0)
    full = pd.DataFrame({"tick": [0], "load": [0.9], "response_s": [9.0]})
    assert telemetry.scale_steps(full, 10, float("-inf"), policy)[0].empty


def test_scaling_stream_carries_state_over_batches(spark, tmp_path):
    schema = "deployment long, tick long, load double, response_s double"
    ticks = [(d, t, 0.9 if (t // 600 + d) % 3 else 0.1, 0.5) for d in range(4) for t in range(0, 6000, 30)]
    for part, (low, high) in enumerate([(0, 2000), (2000, 4000), (4000, 6000)]):
        rows = [r for r in ticks if low <= r[1] < high]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}"))
    whole = spark.createDataFrame(ticks, schema)
    batch = sorted(map(tuple, telemetry.scaling_decisions(whole, "deployment").collect()))
    out = str(tmp_path / "out")
    for seen in ("p0", "p[01]", "p[012]"):
        # a new run per folder: replicas and cooldowns come from the stored state
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / seen))
        st.append_to(scaling.scaling_stream(source, "deployment"), out, str(tmp_path / "state"))
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == batch and batch


def test_stream_over_many_batches_equals_batch(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.repartitionByRange(5, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "ev"))
    stream = st.metric_ticks(st.read_events(spark, str(tmp_path / "ev"), files_per_trigger=1))
    out = st.run_upsert(
        spark, st.windowed_summary(stream, ["deployment"], "1 day", "40 days"), "many", ["deployment", "window"]
    )
    batch = telemetry.window_summary(
        st.metric_ticks(events.withColumn("ts", F.col("ts").cast("timestamp"))), ["deployment"], F.window("ts", "1 day")
    )

    def plain(df):
        return sorted(tuple(x) for x in df.select("deployment", "window.start", "cpu_peak", "ticks", "healthy").collect())

    assert plain(out) == plain(batch)


def test_run_documents_get_a_file_each_in_a_bounded_number_of_folders(spark, tmp_path):
    rows = [(f"r{i}", '{"test_id": "r%d"}' % i if i % 3 else '{"test') for i in range(200)]
    rows += [("r7", '{"test_id": "again"}'), (None, '{"test_id": "no id"}'), (None, '{"test')]
    path = str(tmp_path / "runs")
    runs.write_documents(spark.createDataFrame(rows, "run_id string, value string").coalesce(1), path, folders=40)
    folders = [p for p in (tmp_path / "runs").iterdir() if p.is_dir()]
    files = [f.read_text() for p in folders for f in p.glob("part-*")]
    assert len(folders) <= 40
    assert sorted(files) == sorted(value + "\n" for _, value in rows)
    parsed = runs.parsed_runs(spark, path).groupBy(runs.CORRUPT).count().collect()
    bad = sum(value == '{"test' for _, value in rows)
    assert {(r[0] or "").strip(): r["count"] for r in parsed} == {"": len(rows) - bad, '{"test': bad}
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        runs.write_documents(spark.createDataFrame(rows, "run_id string, value string"), path)


def test_no_run_documents_leave_no_file(spark, tmp_path):
    path = str(tmp_path / "none")
    runs.write_documents(spark.createDataFrame([], "run_id string, value string"), path)
    assert not list((tmp_path / "none").rglob("part-*"))
