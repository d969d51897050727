"""Source divergence against sums over every term of every pair."""

import random
import re
from collections import Counter, defaultdict

import pytest

from tallymark.llm import divergence


def brute_audit(rows, top=200):
    docs, n = defaultdict(Counter), defaultdict(Counter)
    groups = sorted({(lang or "", source or "") for _, lang, source in rows})
    for text, lang, source in rows:
        terms = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]
        docs[lang or ""].update(set(terms))
        n[lang or "", source or ""].update(terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, c in docs[lang].items() if c >= 3)
        own = [s for g, s in groups if g == lang]

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (total + len(kept)) for t in kept}

        p = {s: shares(n[lang, s]) for s in own}
        whole = Counter()
        for s in own:
            whole.update(n[lang, s])
        q = shares(whole)
        for s in own:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in own if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:limit]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(out)


def some_documents():
    dice = random.Random(3)
    words = ["alpha", "Beta", "été", "naïve", "don't", "x1y", "ñ", "GAMMA", "delta_e", "日本"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]
    rows = []
    for lang in ("en", "fr", None):
        for k, source in enumerate(["a", "b", "web", None, "z"]):
            for _ in range(12):
                rows.append((" ".join(dice.choices(words[k * 4 :], k=dice.randrange(0, 40))), lang, source))
    rows += [(None, "en", "a"), ("", "en", "silent"), ("one two", "xx", "a"), ("three", "xx", "b"), ("alpha " * 30_000, "en", "a")]
    return rows + [("alpha beta", "en", "web")] * 40


@pytest.mark.parametrize("nodes,flush,packs", [(1 << 18, 1 << 18, 256), (5, 10, 2)])
def test_audit_equals_all_terms_of_all_pairs(spark, monkeypatch, nodes, flush, packs):
    for name, value in (("TREE_NODES", nodes), ("FLUSH_TERMS", flush), ("SOURCES_AT_ONCE", packs)):
        monkeypatch.setattr(divergence, name, value)
    rows = some_documents()
    documents = spark.createDataFrame([(*r, "t", 1) for r in rows], "text string, lang string, source string, term string, n int")
    out = divergence.audit(documents)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in out.collect()) == brute_audit(rows)
    few = divergence.audit(documents, top_terms=3)
    assert few.where("part = 'term'").agg({"rank": "max"}).first()[0] == 3


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_tree_shares_beginnings_and_meets_each_ancestor_once():
    tree = divergence.Tree()

    def item(source, n):
        return {"source": source, "n": n, "p": 100 * n + 7, "base": 7}

    tree.insert([item("a", 1), item("b", 2), item("c", 1)], 3)
    tree.insert([item("a", 1), item("b", 2), item("d", 5)], 2)
    tree.insert([item("b", 2), item("c", 1)], 1)
    assert len(tree.parent) == 6 and tree.times[:2] == [5, 5]
    f = lambda p, q: (p - q) ** 2 // q
    want = f(107, 207) - f(107, 7) - f(7, 207) + f(7, 7)
    assert {(a, b): x for a, b, x in tree.corrections()}["a", "b"] == 5 * want


def test_large_sums_are_exact():
    import numpy as np

    dice = random.Random(2)
    values, times = [dice.randrange(-10**18, 10**18) for _ in range(200)], [dice.randrange(1, 10**9) for _ in range(200)]
    keys = [dice.randrange(3) for _ in range(200)]
    got = divergence._exact_sums(np.array(values), np.array(times), np.array(keys), 3)
    assert got == [sum(v * t for v, t, k in zip(values, times, keys) if k == j) for j in range(3)]
