"""Jaccard join against all pairs, also where regions are crowded."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallymark.llm import jaccard


def brute_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def brute_join(rows):
    sets, at = [brute_set(t) for _, t in rows], defaultdict(list)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, own in enumerate(sets):
        for other, both in Counter(o for s in own for o in at[s]).items():
            if 100 * both >= 90 * (len(own) + len(sets[other]) - both):
                a, b = find(other), find(k)
                root[max(a, b)] = min(a, b)
        for s in own:
            at[s].append(k)
    least = defaultdict(lambda: (True, 0))
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least[find(k)], (i is None, i or 0))
    named = [(i, len(sets[k]), least[find(k)][1] if not least[find(k)][0] else None) for k, (i, _) in enumerate(rows)]
    return sorted([(i, n, c if n else i) for i, n, c in named], key=repr)


def some_rows():
    dice = random.Random(3)
    words = ["".join(dice.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "two words"), (5, "Two  words"), (6, "a b c d e"), (7, "a b c d e f"), (8, "é É x y")]
    common = " ".join(dice.choices(words, k=60))

    def add(text):
        rows.append((len(rows) + 1, text))

    for n in (11, 14, 20, 30, 60, 150, 400):
        for _ in range(4):
            base = dice.choices(words, k=n)
            add(" ".join(base))
            for changes in (1, 1, max(1, n // 90), max(1, n // 60), max(1, n // 40), n // 12):
                own = list(base)
                for _ in range(changes):
                    own[dice.randrange(n)] = dice.choice(words)
                add(" ".join(own))
            add(" ".join(base[: n * 9 // 10]))  # on the edge of the size that can link
            add(" ".join(base + base[: n // 10]))
    chain = dice.choices(words, k=200)
    for k in range(60):  # a chain: neighbours are linked, far ones are not
        add(" ".join(chain[k * 3 : k * 3 + 120]))
    crowd = dice.choices(words, k=90)
    for _ in range(150):  # some within reach of each other, many not
        own = list(crowd)
        for _ in range(dice.randrange(1, 4)):
            own[dice.randrange(90)] = dice.choice(words)
        add(" ".join(own))
    for k in range(60):
        add(common + " " + " ".join(dice.choices(words, k=dice.randrange(3, 40))))
    for _ in range(40):
        add(" ".join(dice.choices(words[:4], k=30)))
    rows += [(None, rows[40][1]), (None, "only here and nowhere else"), (20, rows[60][1]), (20, rows[60][1]), (9000, "w " * 40_000 + "end of it")]
    return rows


@pytest.mark.parametrize("held", [4096, 20])
def test_join_equals_all_pairs(spark, monkeypatch, held):
    monkeypatch.setattr(jaccard, "ROWS", held)
    rows = some_rows()
    documents = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, keys string, n int")
    got = sorted((tuple(r) for r in jaccard.near_duplicates(documents).collect()), key=repr)
    want = brute_join(rows)
    assert got == want
    assert len({c for _, _, c in want}) < len(rows) - 150


def test_linked_sets_have_an_equal_part():
    dice = np.random.default_rng(4)
    for _ in range(400):
        n = int(dice.integers(10, 300))
        a = np.unique(dice.integers(0, 1 << 63, n, dtype=np.uint64))
        shared = int(np.ceil(0.9 * len(a)))  # the farthest that a subset can be and still be linked
        b = dice.choice(a, shared, replace=False)
        if 100 * len(b) >= 90 * len(a):
            assert np.intersect1d(jaccard.part_keys(np.sort(b)), jaccard.part_keys(a)).size


def test_regions_are_joined_exactly_at_any_leaf(monkeypatch):
    rows = [t for _, t in some_rows() if t]
    hashes = [jaccard.shingles(t.encode()) for t in rows]
    want = [c for _, _, c in sorted((k, n, c) for k, n, c in brute_join(list(enumerate(rows))))]
    for leaf, pivots in ((24, 8), (2, 3), (10_000, 8)):
        monkeypatch.setattr(jaccard, "LEAF", leaf)
        monkeypatch.setattr(jaccard, "PIVOTS", pivots)
        kept = [k for k, h in enumerate(hashes) if len(h)]
        own = jaccard.Sets([hashes[k] for k in kept])
        own.join(np.arange(len(kept)))
        assert own.label.tolist() == [kept.index(want[k]) for k in kept]


def test_empty_table(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
