"""The pattern index against looking for every pattern in every text."""

import random

import pytest
from pyspark.sql import functions as F

from tallymark.operators import pattern_index
from tallymark.operators.errors import first_match


def some_tables():
    dice = random.Random(4)
    letters = "abcdeé 한"
    texts = [(i, "".join(dice.choice(letters) for _ in range(dice.randrange(0, 60)))) for i in range(300)]
    texts += [(900, None), (901, ""), (902, "x" * 50_000 + "needle"), (903, "a"), (903, "b"), (904, "\U0001f600 face")]
    patterns = ["", "a", "é", "한", "ab", "needle", "\U0001f600", "xx", "zzz", None, "a", "x" * 400]
    patterns += ["".join(dice.choice(letters) for _ in range(dice.randrange(1, 6))) for _ in range(200)]
    return texts, [(p, i) for i, p in enumerate(patterns)]


@pytest.mark.parametrize("block,share", [(1 << 18, 200_000), (40, 20)])
def test_occurrences_equal_all_with_all(spark, monkeypatch, block, share):
    monkeypatch.setattr(pattern_index, "BLOCK_BYTES", block)
    monkeypatch.setattr(pattern_index, "TEXTS_PER_SHARE", share)
    texts, patterns = some_tables()
    t, p = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(patterns, "pattern string, rank int")
    want = sorted({(i, r, q) for i, x in texts if x is not None for q, r in patterns if q is not None and q in x})
    assert sorted(tuple(r) for r in pattern_index.occurrences(t, p).collect()) == want
    first = {}
    for i, r, q in want:
        first[i] = min(first.get(i, (r, q)), (r, q))
    got = {r.id: (r.rank, r.pattern) for r in pattern_index.occurrences(t, p, first_only=True).collect()}
    assert got == first
    assert pattern_index.occurrences(t, p.limit(0)).count() == 0 and pattern_index.occurrences(t.limit(0), p).count() == 0


def test_first_match_over_a_hundred_thousand_patterns(spark):
    many = spark.range(100_000).select(
        F.concat(F.lit("E"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("pattern"), (F.col("id") + 10).alias("priority"), F.lit("code").alias("category")
    )
    own = [("Z", 5, "letter"), ("z", 5, "letter too"), ("e000042 at", 1, "exact"), ("", 1_000_000, "none")]
    patterns = many.unionByName(spark.createDataFrame(own, "pattern string, priority long, category string"))
    said = ["E000042 at line 3", "e000043", "fuzz E000044 and e000009", None, "nothing", "E000042 at line 3", "E000045 E000043"]
    log = spark.createDataFrame(list(enumerate(said)), "error_id int, message string")
    got = {r.error_id: (r.pattern, r.category) for r in first_match(log, patterns).collect()}
    assert got == {
        0: ("e000042 at", "exact"), 1: ("e000043", "code"), 2: ("z", "letter"), 3: (None, None), 4: ("", "none"),
        5: ("e000042 at", "exact"), 6: ("e000043", "code"),
    }


def test_grams_are_told_apart():
    assert len(pattern_index.grams("abc")) == 7  # nothing, three letters, two pairs, one run of three
    assert set(pattern_index.grams("ab").tolist()) & set(pattern_index.grams("ba").tolist()) == {0, 98, 99}
