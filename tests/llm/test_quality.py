"""Quality rules and classifier: counts against brute force, held-out accuracy."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tallymark.llm import features, quality_classifier, quality_rules
from tallymark.llm.common import table

ODD = [None, "", " \n ", "one", "a b " * 40, "x" * 5000, "é à\x0b\x0c\r b\x85c\xa0d", "l\nl\n\n \nl\nm", "w " * 30000]


def brute(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    runs = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if runs[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_brute_force():
    dice = random.Random(3)
    made = [" ".join(dice.choice("abcd") for _ in range(dice.randrange(60))) + dice.choice(["", "\n"]) * 2 for _ in range(300)]
    for text in [*(t for t in ODD if t is not None), *made]:
        assert quality_rules.counts(text) == brute(text), text[:60]


@pytest.fixture(scope="module")
def tables(spark):
    folder = "/root/testdata/sf0.01"
    return table(spark, folder, "documents"), table(spark, folder, "labels")


def test_rules_keep_good_documents_and_reject_bad_ones(tables):
    documents, labels = tables
    judged = quality_rules.judge(documents, quality_rules.fit(documents, labels)).join(labels, "doc_id").collect()
    bad = [r for r in judged if r.quality == 0]
    good = [r for r in judged if r.quality == 1 and not r.base_failed]
    assert bad and good
    assert all(not r.kept for r in judged if r.base_failed)
    assert np.mean([r.kept for r in bad]) < 0.1 and np.mean([r.kept for r in good]) > 0.97


def test_classifier_is_right_on_held_out_documents(tables):
    documents, labels = tables
    scored = quality_classifier.score(documents, quality_classifier.fit(documents, labels)).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scored)
    held = [r for r in scored if r.held_out]
    assert len(held) > 40 and np.mean([r.predicted == r.quality for r in held]) > 0.93


def test_held_out_labels_are_not_learned(tables):
    documents, labels = tables
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = quality_classifier.fit(documents, labels), quality_classifier.fit(documents, turned)
    assert np.array_equal(one.weights, two.weights) and one.bias == two.bias


@pytest.mark.parametrize("module", [quality_rules, quality_classifier])
def test_odd_rows_and_missing_labels(spark, module):
    rows = [(i, t, "x", 0.5, True) for i, t in enumerate(ODD)] + [(None, "some words", "x", 0.5, True), (1, "", "x", 0.5, True)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, n_words string, score double, kept boolean")
    apply = quality_rules.judge if module is quality_rules else quality_classifier.score
    for given in ([], [(0, None, 0), (None, 1, 0)], [(4, 1, 0)], [(1, 1, 0), (5, 0, 1), (5, 0, 1), (3, 1, 0), (8, 0, 0)]):
        labels = spark.createDataFrame(given, "doc_id long, quality int, toxic int")
        out = apply(documents, module.fit(documents, labels)).collect()
        assert len(out) == len(rows)
    empty = documents.limit(0)
    assert apply(empty, module.fit(empty, labels)).count() == 0
    if module is quality_rules:
        assert {r.doc_id: r.base_failed for r in out}[0] is True


def test_rejected_documents_go_and_columns_stay(spark, tables):
    documents, labels = tables
    model = quality_classifier.fit(documents, labels)
    kept = quality_classifier.keep_good(documents, model)
    assert kept.schema == documents.schema
    want = quality_classifier.score(documents, model).where("predicted = 1")
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(r.doc_id for r in want.collect())


def test_mean_weight_is_the_mean_over_all_features():
    weights = np.random.default_rng(5).normal(size=1 << 10).astype(np.float32)
    texts = [t.encode() for t in ODD if t is not None] + [b"ab cd " * 90_000, b"y" * 600_000]
    for text, mean in zip(texts, features.mean_weights(texts, weights)):
        keys, counts = features.counted(text, 10)
        assert mean == pytest.approx((weights[keys].astype(float) * counts).sum() / max(counts.sum(), 1), abs=1e-5)


def test_features_do_not_reach_into_the_next_text():
    alone = features.counted(b"some words here", 16)
    weights = np.zeros(1 << 16, np.float32)
    weights[alone[0]] = alone[1]
    a = features.mean_weights([b"some words here"], weights)[0]
    assert features.mean_weights([b"other", b"some words here", b"", b"last one"], weights)[1] == pytest.approx(a)


def test_sample_is_bounded_whatever_repeats(spark):
    from tallymark.llm import labelled

    rows = [(1, f"text {i}") for i in range(500)] + [(2, "same text")] * 300 + [(3, "x " * 3000), (4, None)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 0), (2, 1, 0), (3, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    kept = [i for i in (1, 2, 3, 4) if zlib.crc32(str(i).encode()) % 5]
    assert 1 in kept and 2 in kept
    found = labelled.sample(documents, labels, 10, 100)
    assert len(found) == 100
    assert len(labelled.sample(documents, labels, 10, 10_000)) == 500 + 2 + len(set(kept) & {3, 4})
    assert len(labelled.sample(documents, labels, 10, 10_000, text_bytes=200)) < 40


def test_sample_comes_to_the_driver_packed_and_whole(spark, monkeypatch):
    from tallymark.llm import labelled

    dice = random.Random(3)
    rows = [(i, " ".join(f"word{dice.randrange(900)}" for _ in range(700))) for i in range(40)] + [(40, "a " * 40_000), (41, None)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    came, plain = [], type(documents).toArrow
    monkeypatch.setattr(type(documents), "toArrow", lambda df: came.append(plain(df)) or came[-1])
    found = labelled.sample(documents, labels, 17, 100)
    want = Counter()
    for i, text in rows:
        if zlib.crc32(str(i).encode()) % 5:
            keys, counts = features.counted((text or "").encode(), 17)
            want[i % 2, tuple(keys.tolist()), tuple(counts.tolist())] += 1
    assert Counter((y, tuple(k.tolist()), tuple(n.tolist())) for y, _, k, n in found) == want
    assert [place for _, place, _, _ in found] == sorted(place for _, place, _, _ in found)
    pairs = sum(len(k) for _, _, k, _ in found)
    assert came[0].nbytes < 8 * pairs / 2


def test_hashing_tables_are_made_where_texts_are_hashed():
    import subprocess
    import sys

    said = "import tallymark.llm.queries; from tallymark.llm import features; print(features._powers.cache_info().currsize)"
    assert subprocess.run([sys.executable, "-c", said], capture_output=True, text=True, check=True).stdout.strip() == "0"
