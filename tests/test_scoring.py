"""Fixed-value cases of the scoring rules and the dispatch."""

import difflib

import pytest
from pyspark.sql import functions as F

from tallymark.functions import text as tx
from tallymark.operators import capacity, rollup, scoring
from tallymark.operators.telemetry import memory_level


def value(spark, column, **columns):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()] or [F.lit(1).alias("_")])
    return df.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "text, number",
    [
        ("24 - 8 = 16이므로 답은 16개입니다.", 16.0),
        ("16", 16.0),
        ("24 - 8 = 16\n따라서 철수에게 남은 사탕은 16개입니다.", 16.0),
        ("합계 1,234원", 1.234),
        ("끝은 7\n", 7.0),
        ("숫자 없음", None),
    ],
)
def test_numeric_answer(spark, text, number):
    assert value(spark, tx.numeric_answer(F.col("t")), t=text) == number


@pytest.mark.parametrize(
    "text, expected", [("24 - 8 = 16이므로 답은 16개입니다.", 0.7), ("확실히 7", 0.7), ("아마 불확실", 0.4)]
)
def test_math_confidence(spark, text, expected):
    assert value(spark, tx.math_confidence(F.col("t")), t=text) == pytest.approx(expected)


@pytest.mark.parametrize(
    "a, b, ratio, correct",
    [
        ("16개", "16", 0.8, False),
        ("100도", "100", 0.857143, True),
        ("서울은 대한민국의 수도입니다.", "서울", 0.222222, False),
        ("", "", 1.0, True),
    ],
)
def test_similarity(spark, a, b, ratio, correct):
    df = spark.createDataFrame([(a, b)], "p string, t string")
    row = df.select(
        scoring.similarity(F.col("p"), F.col("t")).alias("s"),
        scoring.similar_enough(F.col("p"), F.col("t")).alias("c"),
        tx.similarity_bound(F.col("p"), F.col("t")).alias("bound"),
    ).first()
    assert row["s"] == pytest.approx(ratio, abs=1e-6)
    assert row["c"] is correct
    assert row["bound"] >= row["s"]


def test_similarity_agrees_with_brute_force_on_whole_texts(spark, data):
    from tallymark.sources.views import pairs_similar

    rows = pairs_similar(spark, data).select(
        "prediction", "truth", scoring.similarity(F.col("prediction"), F.col("truth")).alias("s"),
        scoring.similar_enough(F.col("prediction"), F.col("truth")).alias("c"),
    ).collect()
    assert rows
    for r in rows:
        want = difflib.SequenceMatcher(None, r["prediction"].lower(), r["truth"].lower()).ratio()
        assert r["s"] == pytest.approx(want)
        assert r["c"] == (want > 0.8)


def test_keywords(spark):
    assert sorted(value(spark, tx.keywords(F.col("t")), t="대한민국의 수도는 서울입니다.")) == sorted(
        ["대한민국의", "수도는", "서울입니다"]
    )


def test_performance_score(spark):
    assert value(spark, tx.performance_score(F.lit(75.5), F.lit(6400.0))) == pytest.approx(0.755)
    assert value(spark, tx.performance_score(F.lit(0.0), F.lit(None).cast("double"))) == 1.0


def test_exact_and_contains(spark):
    assert value(spark, tx.exact_match(F.lit("  ABC\t"), F.lit("abc "))) == 1.0
    assert value(spark, tx.exact_match(F.lit(" "), F.lit(""))) == 0.0
    assert value(spark, tx.exact_match(F.lit(" "), F.lit(""), True)) == 1.0
    assert value(spark, tx.contains_match(F.lit("The ANSWER is 5"), F.lit(" answer "))) == 1.0


def test_fluency_completeness_confidence(spark):
    assert value(spark, tx.fluency(F.lit("aaaa b"))) == pytest.approx(0.5 + 0.15 - 0.1)
    assert value(spark, tx.completeness(F.lit("서울은 수도입니다"))) == pytest.approx(1.0)
    assert value(spark, tx.completeness(F.lit("  "))) == 0.0
    assert value(spark, tx.qa_confidence(F.lit("확실히 7"))) == pytest.approx(0.7)


def test_rollup_fixed_values(spark):
    df = spark.createDataFrame([(1.0, True), (0.0, False), (1.0, True)], "score double, correct boolean")
    row = rollup.evaluation_rollup(df, []).first()
    assert row["average_score"] == pytest.approx(0.666667, abs=1e-6)
    assert row["std_score"] == pytest.approx(0.471405, abs=1e-6)
    consistency = df.agg(rollup.consistency("score").alias("c")).first()["c"]
    assert consistency == pytest.approx(0.057191, abs=1e-6)


def test_latency_percentiles_fixed_values(spark):
    df = spark.range(1, 21).select(F.lit("m").alias("model"), F.col("id").cast("double").alias("latency_s"))
    assert rollup.latency_block(df, ["model"]).first()["latency_p95"] == pytest.approx(19.05)
    assert rollup.index_percentiles(df, ["model"]).first()["latency_p95"] == 20.0


def test_efficiency_and_cost_fixed_values(spark):
    tps, mem, cpu = F.lit(75.5), F.lit(6400.0), F.lit(45.2)
    power = rollup.power_watts(cpu)

    def numbers(columns):
        row = spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()
        return [row[n] for n in columns]

    assert value(spark, power) == pytest.approx(117.8)
    assert numbers(rollup.efficiency_by_power(tps, mem, power)) == pytest.approx([0.640917, 0.011797, 0.100143], abs=1e-6)
    assert numbers(rollup.efficiency_by_cpu(tps, mem, cpu)) == pytest.approx([0.011797, 12.08, 1.670354, 0.260993], abs=1e-6)
    hour, _, per_1k, month = numbers(rollup.cost_by_power(tps, mem, power))
    assert (hour, per_1k, month) == (pytest.approx(0.07428), pytest.approx(0.000273, abs=1e-6), pytest.approx(53.4816))
    hour, _, per_1k, _ = numbers(rollup.cost_by_rental(tps, mem, F.lit(1.0)))
    assert (hour, per_1k) == (pytest.approx(0.5625), pytest.approx(0.002070, abs=1e-6))


def test_efficiency_score_and_levels(spark):
    from tallymark.operators.compare import efficiency_score

    assert value(spark, efficiency_score(F.lit(75.5), F.lit(6400.0), F.lit(0.000025), F.lit(1.2))) == pytest.approx(0.504)
    for used, level in ((0.70, "warning"), (0.85, "critical"), (0.95, "emergency"), (0.5, "safe")):
        assert value(spark, memory_level(F.lit(used))) == level


def test_model_memory_token_order(spark):
    path, no = F.lit("org/Model-13B"), F.lit(False)
    assert value(spark, capacity.model_memory_gb(path, no, no)) == 26.0
    assert value(spark, capacity.model_memory_gb(path, no, no, parity=True)) == 6.0


def test_dispatch_reports_missing_text_and_falls_back(spark):
    df = spark.createDataFrame(
        [("korean_math", "답은 3", "3"), ("nonesuch", "same", "same"), ("basic", None, "x"), ("performance", "a", "a")],
        "evaluator string, prediction string, truth string",
    )
    rows = {r["evaluator"]: r for r in scoring.evaluate(df).collect()}
    assert rows["korean_math"]["score"] == 1.0
    assert rows["nonesuch"]["used"] == "basic" and rows["nonesuch"]["correct"]
    assert rows["basic"]["error"] == "missing text" and rows["basic"]["score"] == 0.0
    assert rows["performance"]["score"] == pytest.approx(1.0)


def test_own_evaluator_can_be_registered(spark):
    scoring.register_evaluator("length", lambda p, t, row: scoring._result(F.length(p) / 10, F.length(p) > 5, F.lit(0.5)))
    try:
        df = spark.createDataFrame([("length", "abcdefg", "x")], "evaluator string, prediction string, truth string")
        assert scoring.evaluate(df).first()["score"] == pytest.approx(0.7)
    finally:
        del scoring.EVALUATORS["length"]


def test_one_failing_row_of_a_thousand_costs_itself_only(spark):
    from tallymark.operators import scoring

    def picky(prediction, truth, row):
        if row["n"] == 417:
            raise ValueError("no such answer")
        return {"score": 1, "correct": True, "confidence": 0.5, "details": {"seen": row["n"], "nothing": None}}

    rows = [(n, f"p{n}" if n != 5 else None, "t", "picky" if n % 2 or n == 4 else "korean_math") for n in range(1000)]
    df = spark.createDataFrame(rows, "n int, prediction string, truth string, kind string")
    scoring.register_row_evaluator("picky", picky)
    try:
        out = {r.n: r for r in scoring.evaluate(df, "kind", details=True).collect()}
        lean = scoring.evaluate(df, "kind").columns
    finally:
        scoring.unregister_evaluator("picky")
    assert len(out) == 1000 and "details" not in lean
    assert (out[417].score, out[417].correct, out[417].error, out[417].details) == (0.0, False, "no such answer", {"error": "no such answer"})
    assert (out[5].score, out[5].error) == (0.0, "missing text")
    assert out[4].details == {"seen": "4", "nothing": None} and out[4].used == "picky"
    assert out[2].used == "korean_math" and set(out[2].details) == {"extracted_pred", "extracted_gt", "reasoning_quality", "language"}
    assert sum(r.error is not None for r in out.values()) == 2


def test_turn_numbers_with_gaps_keep_their_pairs(spark, tmp_path):
    from tallymark.sources import views

    turns = [(1, 0, "user", "q"), (1, 4, "assistant", "a"), (1, 9, "user", "r"), (1, 10, "system", "s"), (1, 11, "assistant", "b"),
             (2, 3, "assistant", "c"), (2, 5, "user", "t"), (2, 50, "assistant", None)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(tuple(r) for r in views.chat_pairs(spark, str(tmp_path)).collect())
    assert got == [(1, 4, "q", "a"), (2, 50, "t", None)]
