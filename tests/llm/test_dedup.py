"""Near-dedup, components and line dedup against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tallymark.llm import line_dedup, quality_classifier, simhash
from tallymark.llm.components import components


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def pairs_within(prints, radius=3):
    return [(a, b) for i, a in enumerate(prints) for b in prints[:i] if bin(a ^ b).count("1") <= radius]


def some_documents():
    dice = random.Random(1)
    words = ["".join(dice.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    texts = [None, "", " \n", "one", "One", "two words", "A B c", "x" * 40_000]
    base = [" ".join(dice.choices(words, k=n)) for n in (40, 200, 400, 3000)]
    for text in base:
        texts += [text, text, text.upper()]
        for _ in range(12):
            own = text.split()
            for _ in range(dice.randrange(1, 4)):
                own[dice.randrange(len(own))] = dice.choice(words)
            texts.append(" ".join(own))
    return texts + [" ".join(dice.choices(words, k=30)) for _ in range(60)]


def test_fingerprint_equals_the_definition():
    for text in some_documents():
        assert simhash.fingerprint((text or "").encode()) == brute_print(text)


@pytest.mark.parametrize("options", [{}, {"blocks": 5}, {"tree_nodes": 4}])
def test_components_equal_all_pairs(spark, options):
    texts = some_documents()
    rows = [(100 - i, t, "f") for i, t in enumerate(texts)] + [(7, texts[-1], "f"), (7, texts[-1], "f")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, print string")
    prints = {i: brute_print(t) for i, t, _ in rows}
    distinct = sorted({brute_print(t) for _, t, _ in rows})
    of = brute_components(distinct, pairs_within(distinct))
    least = defaultdict(lambda: 10**9)
    for i, t, _ in rows:
        least[of[brute_print(t)]] = min(least[of[brute_print(t)]], i)
    want = sorted((i, f"{brute_print(t):016x}", least[of[brute_print(t)]]) for i, t, _ in rows)
    got = sorted(tuple(r) for r in simhash.near_duplicates(documents, **options).collect())
    assert got == want and len(set(prints.values())) > 50


def test_dense_groups_lose_no_link(spark):
    dice = random.Random(2)
    centre = dice.getrandbits(64)
    near = {centre}
    while len(near) < 400:
        value = dice.choice(sorted(near))
        for _ in range(dice.randrange(1, 5)):
            value ^= 1 << dice.randrange(64)
        near.add(value)
    prints = sorted(near | {dice.getrandbits(64) for _ in range(300)})
    rows = [(int(np.uint64(p).view(np.int64)),) for p in prints]
    for tree_nodes in (1024, 16):
        found = simhash.links(spark.createDataFrame(rows, "print long"), tree_nodes=tree_nodes).collect()
        got = brute_components([r[0] for r in rows], [(r.a, r.b) for r in found])
        signed = dict(zip(prints, (r[0] for r in rows)))
        want = brute_components([r[0] for r in rows], [(signed[a], signed[b]) for a, b in pairs_within(prints)])
        assert got == want
        assert len(found) <= 4 * len(rows) * (1 if tree_nodes == 1024 else 40)


def test_trees_hold_every_row_once_and_search_is_exact():
    dice = np.random.default_rng(4)
    prints = np.unique(dice.integers(0, 1 << 12, 300, dtype=np.uint64))
    shard = np.sort(dice.integers(0, 5, len(prints)))
    trees = simhash.grow(prints, shard)
    assert len(trees[0]) == 5 and (trees[1] < 0).sum() == 5
    found = {(int(q), int(n)) for qs, ns in simhash.search(prints, trees, prints, trees[0][shard], 2) for q, n in zip(qs, ns)}
    want = {(i, j) for i in range(len(prints)) for j in range(len(prints))
            if shard[i] == shard[j] and bin(int(prints[i] ^ prints[j])).count("1") <= 2}
    assert found == want


def test_one_of_each_group_stays(spark):
    rows = [(5, "a b c d e f", 1), (3, "A b c d e f", 2), (3, "A b c d e f", 2), (9, "q w e r t y u", 3), (None, "a b c d e f", 4), (None, None, 5)]
    out = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, `odd.name` int"))
    assert out.columns == ["doc_id", "text", "odd.name"]
    assert sorted((r[0] or -1, r[2]) for r in out.collect()) == [(-1, 5), (3, 2), (9, 3)]


def test_rows_that_share_an_id_but_no_group_are_documents_of_their_own(spark):
    rows = [(1, "a b c d e f", 1), (1, "q w e r t y u", 2), (1, "q w e r t y u", 2), (2, "A b c d e f", 3), (3, None, 4), (3, "", 5)]
    out = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, _body int")).collect()
    assert sorted((r.doc_id, r._body) for r in out if r.doc_id < 3) == [(1, 1), (1, 2)]
    # null and empty texts are one group; of its two texts one stays
    assert len([r for r in out if r.doc_id == 3]) == 1


def test_rows_without_an_id_are_copies_like_others(spark):
    rows = [(None, "a b c d e f", 1), (5, "A b c d e f", 2), (None, "p q r s t", 3), (None, "p q r s t", 3), (None, None, 4), (None, "", 4)]
    out = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, _kept_id int")).collect()
    assert sorted((r.doc_id or 0, r._kept_id) for r in out) == [(0, 3), (0, 4), (5, 2)]


def test_columns_with_dots_pass_through(spark):
    documents = spark.createDataFrame([(1, "p\nq\nr", 7), (2, "p\nq\nr\ns", 8)], "doc_id long, text string, `odd.name` int")
    out = line_dedup.dedup(documents)
    assert out.columns == ["doc_id", "text", "odd.name", "removed", "n_lines"]
    assert sorted(tuple(r)[:4] for r in out.collect()) == [(1, "p\nq\nr", 7, []), (2, "s", 8, [0, 1, 2])]
    everything = quality_classifier.Model(np.zeros(1 << quality_classifier.BITS, np.float32), 1.0)
    kept = quality_classifier.keep_good(documents, everything)
    assert kept.columns == documents.columns and sorted(map(tuple, kept.collect())) == sorted(map(tuple, documents.collect()))


def test_empty_documents_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0 and simhash.one_of_each(empty).count() == 0
    assert line_dedup.dedup(empty).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    dice = random.Random(6)
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    loose = [(dice.randrange(2000, 2100), dice.randrange(2000, 2100)) for _ in range(60)]
    links = chain + star + loose + [(5, 5), (3, 2), (3, 2)]
    dice.shuffle(links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = brute_components({n for a, b in links if a != b for n in (a, b)}, [(a, b) for a, b in links if a != b])
    assert got == want


def brute_lines(rows, size=3):
    """Row -> (removed lines, text), occurrences in order of (doc_id, text hash, line)."""
    windows = defaultdict(set)
    for i, text in rows:
        lines = (text or "").split("\n")
        worded = [k for k, line in enumerate(lines) if line.encode().strip()]
        for k in range(len(worded) - size + 1):
            span = worded[k : k + size]
            windows[tuple(lines[x] for x in span)].add((i is not None, i or 0, text, span[0], span[-1]))
    gone = defaultdict(set)
    for places in windows.values():
        for _, i, text, first, last in sorted(places)[1:]:
            gone[i, text] |= set(range(first, last + 1))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        own = gone[i or 0, text]
        out.append((i, sorted(own), None if text is None else "\n".join(x for k, x in enumerate(lines) if k not in own)))
    return out


def test_line_dedup_equals_brute_force(spark):
    dice = random.Random(8)
    lines = ["alpha", "beta gamma", "  ", "", "delta", "été", "x" * 500]
    rows = [(i, "\n".join(dice.choice(lines) for _ in range(dice.randrange(0, 12)))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, "a\nb"), (502, "a\nb"), (503, "p\nq\nr"), (504, "p\n\nq\nr\ns"), (505, "l\n" * 2000), (503, "p\nq\nr")]
    documents = spark.createDataFrame([(i, t, "r") for i, t in rows], "doc_id long, text string, removed string")
    out = line_dedup.dedup(documents)
    assert out.columns == ["doc_id", "text", "removed", "n_lines"]
    got = sorted(((r.doc_id, r.removed, r.text) for r in out.collect()), key=repr)
    assert got == sorted(brute_lines(rows), key=repr)
    kept = {r.doc_id: r.text for r in out.collect()}
    assert kept[503] == "p\nq\nr" and kept[504] == "s"
