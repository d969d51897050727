"""Skew-proof building blocks against brute force on lopsided data."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tallymark.functions.order_stats import order_statistics
from tallymark.functions.running_median import with_median_before
from tallymark.functions.sequence import with_row_number, with_running
from tallymark.operators.joins import hot_keys, salted_join, small_side
from tallymark.sources import views


def lopsided(n=3000, seed=5):
    """Rows where one group has two thirds of all rows and one value a third."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if r.random() < 0.66 else f"k{r.randrange(40)}"
        kind = r.random()
        value = 0.25 if kind < 0.33 else (r.lognormvariate(0, 4) if kind < 0.8 else -r.random() * 1e-6 * (kind < 0.9))
        rows.append((key, i, float(value)))
    return rows


def groups(rows):
    out = {}
    for key, i, v in rows:
        out.setdefault(key, []).append((i, v))
    return out


@pytest.mark.parametrize("method, cell_rows", [("linear", 1_000_000), ("linear", 20), ("index", 20)])
def test_order_statistics(spark, method, cell_rows):
    rows = lopsided()
    df = spark.createDataFrame(rows, "key string, id long, v double")
    points = {"lo": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "hi": 1.0}
    got = {r["key"]: r for r in order_statistics(df, ["key"], "v", points, method, cell_rows).collect()}
    for key, items in groups(rows).items():
        s = sorted(v for _, v in items)
        for name, p in points.items():
            if method == "index":
                want = s[min(int(len(s) * p), len(s) - 1)]
            else:
                at = p * (len(s) - 1)
                low = int(at)
                want = s[low] + (s[min(low + 1, len(s) - 1)] - s[low]) * (at - low)
            assert got[key][name] == pytest.approx(want, rel=1e-12), (key, name)


def test_order_statistics_of_integers_past_double_precision(spark):
    base = 2**60
    df = spark.range(101).select(F.lit(1).alias("k"), (F.col("id") + base).alias("v"))
    for cell_rows in (10, 1000):
        got = order_statistics(df, ["k"], "v", {"mid": 0.5}, "index", cell_rows).first()["mid"]
        assert got == base + 50


def test_approximate_percentiles_are_close(spark):
    df = spark.range(10_001).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("v"))
    assert order_statistics(df, ["k"], "v", {"mid": 0.5}, "approx").first()["mid"] == pytest.approx(5000, abs=5)


def test_row_numbers_and_running_totals(spark):
    rows = lopsided()
    df = spark.createDataFrame(rows, "key string, id long, v double").repartition(5)
    numbered = {(r["key"], r["id"]): r["n"] for r in with_row_number(df, ["key"], ["id"], "n", slices=7).collect()}
    running = {
        (r["key"], r["id"]): (r["top"], r["total"])
        for r in with_running(
            df, ["key"], ["id"], {"top": ("max", F.col("v")), "total": ("sum", F.col("id"))}, slices=7
        ).collect()
    }
    for key, items in groups(rows).items():
        top, total = float("-inf"), 0
        for n, (i, v) in enumerate(items, 1):
            top, total = max(top, v), total + i
            assert numbered[key, i] == n
            assert running[key, i] == (top, total)


@pytest.mark.parametrize("window_group", [0, 45, 10_000])
def test_running_median_of_large_and_small_groups(spark, window_group):
    r = random.Random(11)
    rows = [(k, i, round(v, 1) if i % 3 else v, r.random() < 0.8) for k, i, v in lopsided(1500, 9)]
    df = spark.createDataFrame(rows, "key string, id long, v double, done boolean").repartition(6)
    out = with_median_before(df, ["key"], "id", "v", "done", max_group=60, slices=9, window_group=window_group).collect()
    got = {(x["key"], x["id"]): (x["n_before"], x["median_before"]) for x in out}
    assert len(got) == len(rows)
    earlier = {}
    for key, i, v, done in rows:
        seen = earlier.setdefault(key, [])
        n, median = got[key, i]
        assert n == len(seen)
        assert median == (pytest.approx(statistics.median(seen), rel=1e-12, abs=1e-15) if seen else None)
        if done:
            seen.append(v)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_splits_a_hot_key_and_loses_nothing(spark, how):
    rows = lopsided()
    big = spark.createDataFrame(rows, "key string, id long, v double")
    small = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3)], "key string, x int")
    plain = sorted(map(tuple, big.join(small, ["key"], how).select("key", "id", "x").collect()), key=repr)
    assert [r["key"] for r in hot_keys(big, ["key"], ["id"], 500, one_in=1).collect()] == ["hot"]
    salted = salted_join(big, small, ["key"], ["id"], how, min_rows=500, salts=8, one_in=1)
    assert "_salt" in salted._jdf.queryExecution().analyzed().toString()
    assert "_salt" not in salted_join(big, small, ["key"], ["id"], how)._jdf.queryExecution().analyzed().toString()
    assert sorted(map(tuple, salted.select("key", "id", "x").collect()), key=repr) == plain


def test_small_side_marks_only_what_is_small(spark):
    def joined(limit):
        plan = spark.range(1000).join(small_side(spark.range(50), limit), "id")
        return plan._jdf.queryExecution().optimizedPlan().toString()

    assert "strategy=broadcast" in joined(100)
    assert "strategy=broadcast" not in joined(10)


def test_small_side_is_bounded_in_rows_and_bytes(spark):
    rows = spark.createDataFrame([(i, "x" * 100, ["y" * 100]) for i in range(10)], "id long, text string, held array<string>")

    def marked(**bounds):
        plan = small_side(rows, **bounds)._jdf.queryExecution().analyzed().toString()
        return "ResolvedHint" in plan

    assert marked()
    assert not marked(max_rows=9)
    assert not marked(max_bytes=2_000)
    assert small_side(rows, max_bytes=2_000).count() == 10


def test_similar_pairs_need_no_common_opening(spark, tmp_path):
    texts = [(1, "Opening one.\nthe same second line\nend", "en"), (2, "Another start!\nthe same second line\nend", "en"),
             (3, "the same second line", "de"), (4, None, "en"), (5, "", "en"), (6, "alone", "en")]
    spark.createDataFrame(texts, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in views.pairs_similar(spark, str(tmp_path)).collect()]
    assert got == [(2, 1, "en", texts[1][1], texts[0][1])]


def test_a_shared_line_hides_no_copy(spark, tmp_path):
    from tallymark.plans import QUERIES

    licence = "Licensed to all who read it"
    texts = [(1, f"first\n{licence}", "en"), (2, f"true text\nmore of it\n{licence}", "en"), (3, f"True text\nmore of it\n{licence}", "en"),
             (4, "  ALL in other case\nhere ", "en"), (5, "all in OTHER case\nHERE", "en"), (6, "ALL in other case\nhere", "de"), (7, None, "en")]
    spark.createDataFrame(texts, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    pairs = sorted((r.doc_id, r.ref_id) for r in views.partners(spark, str(tmp_path)).collect())
    assert pairs == [(2, 1), (3, 1), (3, 2), (5, 4)]
    scores = {(r.doc_id, r.ref_id): r.score for r in QUERIES["e3_sequence_similarity"](spark, str(tmp_path)).collect()}
    assert sorted(scores) == pairs and scores[3, 2] == 1.0 and scores[3, 1] < 0.8


@pytest.mark.parametrize("max_group", [1, 400, 100_000])
def test_median_rule_walks_studies_whole_or_cut_alike(spark, max_group):
    from tallymark.operators.trials import median_rule

    r = random.Random(5)
    rows = [
        (s, t, p, None if r.random() < 0.05 else round(r.random(), 2), t % 5 != 0)
        for s, trials in ((1, 150), (2, 30), (3, 1)) for t in range(trials) for p in range(r.randrange(1, 5))
    ]
    r.shuffle(rows)
    if max_group < 100_000:  # the bands of cut groups hold numbers only
        rows = [(s, t, p, 0.5 if v is None else v, c) for s, t, p, v, c in rows]
    df = spark.createDataFrame(rows, "study long, trial long, step int, value double, complete boolean").repartition(5)
    out = median_rule(df, max_group=max_group, slices=5, window_group=20)
    assert out.columns == [
        "study", "trial", "step", "completed_before", "value", "best_so_far", "n_before", "median_before", "stop"
    ]
    got = {(x["study"], x["trial"], x["step"]): tuple(x)[3:] for x in out.collect()}
    assert len(got) == len(rows)
    for s, t, p, v, c in rows:
        earlier = [x for x in rows if x[0] == s and x[1] < t]
        own = [x[3] for x in rows if x[:2] == (s, t) and x[2] <= p and x[3] is not None]
        at = [x[3] for x in earlier if x[2] == p and x[4]]
        told = [x for x in at if x is not None]
        done, best = len({x[1] for x in earlier if x[4]}), max(own, default=None)
        median = statistics.median(told) if told else None
        stop = done >= 3 and p >= 2 and best is not None and median is not None and best < median
        assert got[s, t, p] == (done, v, best, len(at), median if median is None else pytest.approx(median), stop)


def test_median_rule_of_usual_studies_has_one_pass_and_no_window_over_earlier_trials(spark):
    from tallymark.operators.trials import median_rule

    rows = [(s, t, p, float(t), True) for s in range(3) for t in range(4) for p in range(2)]
    plan = median_rule(spark.createDataFrame(rows, "study long, trial long, step int, value double, complete boolean"))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in text and "Join" not in text and "percentile" not in text
