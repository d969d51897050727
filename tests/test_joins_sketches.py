"""As-of joins, the vector join and sketches against brute force."""

import random

import numpy as np
import pytest

from tallymark.operators import asof, sketches, vector_join


@pytest.mark.parametrize("slices", [1, 6])
def test_as_of_meets_the_last_row_before(spark, slices):
    dice = random.Random(2)
    left = [(dice.choice(["x", "y", None, "alone"]), dice.choice([None, *range(40)]), n) for n in range(200)]
    right = [(dice.choice(["x", "y", None]), dice.choice([None, *range(0, 40, 3)]), dice.choice("abc"), n) for n in range(90)]
    l, r = spark.createDataFrame(left, "k string, at int, n int"), spark.createDataFrame(right, "k string, at int, seen string, tick int")
    want = []
    for k, at, n in left:
        before = [(a, t, s) for kk, a, s, t in right if kk == k and at is not None and a is not None and a <= at]
        a, t, s = max(before, default=(None, None, None))
        want.append((k, at, n, s, t))
    out = asof.as_of(l, r, ["k"], "at", ["tick"], slices)
    assert out.columns == ["k", "at", "n", "seen", "tick"]
    assert sorted((tuple(x) for x in out.collect()), key=repr) == sorted(want, key=repr)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert asof.as_of(l.limit(0), r, ["k"], "at", ["tick"]).count() == 0
    assert asof.as_of(l, r.limit(0), ["k"], "at", ["tick"]).where("seen is not null").count() == 0


@pytest.mark.parametrize("rows,threshold", [(1024, 0.6), (7, 0.6), (7, 0.97)])
def test_vector_pairs_equal_all_pairs(spark, monkeypatch, rows, threshold):
    monkeypatch.setattr(vector_join, "BLOCK_ROWS", rows)
    dice = np.random.default_rng(3)
    centres = dice.normal(size=(6, 12))
    made = [(i, int(i % 3) if i % 11 else None, (centres[i % 6] + dice.normal(0, 0.3, 12)).tolist()) for i in range(160)]
    made += [(500, 0, made[3][2]), (500, 0, made[3][2]), (501, 0, None), (502, 0, [0.0] * 12), (503, 0, [float("nan")] * 12), (504, 0, [1.0, 2.0]), (505, 0, [1.0, 2.1]), (506, 0, [])]
    table = spark.createDataFrame(made, "id long, label int, vector array<double>")
    own = [(i, k, np.array(v)) for i, k, v in made if v and np.isfinite(v).all() and any(v)]
    want = []
    for n, (i, k, v) in enumerate(own):
        for j, m, w in own[:n]:
            if k == m and len(v) == len(w):
                cosine = v @ w / np.sqrt((v @ v) * (w @ w))
                if cosine >= threshold:
                    want.append((k, min(i, j), max(i, j), round(float(cosine), 6)))
    got = [(r.label, r.a, r.b, round(r.cosine, 6)) for r in vector_join.pairs_above(table, threshold).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and want
    assert vector_join.pairs_above(table.limit(0), threshold).count() == 0


def test_boxes_keep_far_blocks_apart(spark, monkeypatch):
    monkeypatch.setattr(vector_join, "BLOCK_ROWS", 10)
    dice = np.random.default_rng(1)
    table = spark.createDataFrame([(i, 0, v) for i, v in enumerate(dice.normal(size=(300, 4)).tolist())], "id long, label int, vector array<double>")
    boxes = vector_join.blocks(table).select("low", "high").collect()
    reach = 2 - 2 * 0.995
    near = sum(
        sum(max(a.low[k] - b.high[k], b.low[k] - a.high[k], 0) ** 2 for k in range(4)) <= reach
        for i, a in enumerate(boxes) for b in boxes[: i + 1]
    )
    assert near < 0.6 * len(boxes) * (len(boxes) + 1) / 2


def test_united_summaries_equal_one_pass(spark):
    dice = random.Random(7)
    rows = [(d, dice.choice("ab"), dice.choice([0.0, None, *[dice.expovariate(1) for _ in range(8)]]), 1.5, 10.0 + d, dice.randrange(3000)) for d in range(9) for _ in range(1500)]
    rows.append((0, "none timed", None, 1.0, 1.0, 1))
    log = spark.createDataFrame(rows, "day int, model string, latency_s double, tokens_per_second double, memory_usage_mb double, sample_id int")
    daily = sketches.summaries(log, ["day", "model"])
    for r in sketches.figures(sketches.united(daily, ["model"])).collect():
        own = [x for x in rows if x[1] == r.model]
        timed = sorted(x[2] for x in own if x[2])
        assert (r.responses, r.memory_usage_mb) == (len(own), max(x[4] for x in own))
        assert r.latency_avg == pytest.approx(sum(timed) / len(timed) if timed else 0.0)
        seen = len({x[5] for x in own})
        assert abs(r.distinct_ids - seen) <= max(1, seen * sketches.DISTINCT_ERROR)
        for name, rank in (("latency_p50", 0.5), ("latency_p95", 0.95), ("latency_p99", 0.99)):
            if timed:
                below = sum(x <= r[name] for x in timed) / len(timed)
                assert abs(below - rank) <= sketches.RANK_ERROR
            else:
                assert r[name] is None
