"""Mixing, chat formatting, URL filter and top-k search against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.llm import chat, mixing, queries, topk, url_filter


def poisson(rate, u):
    """Inversion, number by number."""
    n, term = 0, math.exp(-rate)
    total = term
    while total <= u:
        n += 1
        term *= rate / n
        total += term
    return n


def uniform(*parts):
    return int(hashlib.md5("|".join(parts).encode()).hexdigest()[:13], 16) / float(1 << 52)


@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_copies_follow_the_rates(spark, monkeypatch, limit):
    real = mixing.sized_broadcast
    monkeypatch.setattr(mixing, "sized_broadcast", lambda df, size: real(df, size, limit))
    rows = [(i, f"t{i}", "big" if i % 3 else ("small" if i % 7 else None), i) for i in range(600)]
    rows += [(None, "no id", "big", 0), (None, None, "big", 0), (1, "t1", "big", 1), (900, "", "tiny", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copy int")
    out = mixing.mix(docs).collect()
    sizes = {s: sum(r[2] == s for r in rows) for s in {r[2] for r in rows}}
    whole = sum(n**0.7 for n in sizes.values())
    rates = {s: len(rows) * n**0.7 / whole / n for s, n in sizes.items()}
    want = []
    for i, text, source, _ in rows:
        name = str(i) if i is not None else hashlib.md5((text or "").encode()).hexdigest()
        for copy in range(1, poisson(rates[source], uniform("mix", name, "1")) + 1):
            want.append((i, text, source, copy, hashlib.md5(f"mix|place|{name}|{copy}".encode()).hexdigest()))
    assert sorted((tuple(r) for r in out), key=repr) == sorted(want, key=repr)


def test_given_weights_and_large_rates(spark):
    docs = spark.createDataFrame([(i, "t", "a" if i else "rare") for i in range(200)], "doc_id long, text string, source string")
    out = mixing.mix(docs, {"rare": 0.9, "a": 0.1, "absent": 5.0}, total=1000.0).groupBy("source").count().collect()
    counts = {r.source: r["count"] for r in out}
    assert 750 < counts["rare"] < 1050 and 60 < counts["a"] < 150
    assert mixing.mix(docs, {"rare": 1.0}).where("source = 'a'").count() == 0
    assert mixing.mix(docs.limit(0)).count() == 0


def brute_paths(rows):
    up = {i: p for i, p, *_ in rows}
    parents = {p for i, p, *_ in rows if p in up}
    out = {}
    for leaf in up.keys() - parents:
        path, node = [], leaf
        while node in up and node not in path:
            path.append(node)
            node = up[node]
        if node not in path:
            out[leaf] = path
    return out


def test_branches_are_enumerated_ranked_and_formatted(spark):
    dice = random.Random(5)
    odd = ["</s>", "a\\</s>", "<s>", "[INST] x [/INST]", "[\\\\/INST]", "", None, "plain\nlines", "<\\s>", "<<s>>", "été"]
    rows = [(f"m{i}", f"m{dice.randrange(i)}" if i % 9 else None, dice.choice(["user", "assistant", "sys%0A\ntem", None]),
             dice.choice(odd), dice.choice([None, 0.5, 1.0, 2.0])) for i in range(120)]
    rows += [(f"c{i}", f"c{i - 1}" if i else None, "assistant" if i % 2 else "user", f"turn {i}", 0.0) for i in range(70)]
    rows += [("x", "y", "user", "circle", 9.0), ("y", "x", "user", "circle", 9.0), ("z", "y", "user", "hangs on it", 9.0)]
    rows += [("lost", "nobody", "user", "orphan", 1.0), (None, "m1", "user", "no id", 1.0)]
    messages = spark.createDataFrame(rows, "message_id string, parent_id string, role string, text string, score double")
    by = {r[0]: r for r in rows}
    paths = brute_paths([r for r in rows if r[0]])
    got = {}
    for r in chat.paths(messages).collect():
        got.setdefault(r.leaf, {})[r.up] = r.message_id
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == paths
    trees = {}
    for leaf, path in paths.items():
        trees.setdefault(path[-1], []).append((-sum(by[m][4] or 0.0 for m in path), leaf))
    want = {leaf: (root, n + 1) for root, leaves in trees.items() for n, (_, leaf) in enumerate(sorted(leaves)[:2])}
    out = chat.conversations(messages.withColumn("formatted", F.lit(1)), branches=2).collect()
    assert {r.leaf: (r.root, r.branch) for r in out} == want
    for r in out:
        path = [by[m] for m in reversed(paths[r.leaf])]
        assert chat.read_turns(r.formatted) == [(m[2] or "", m[3] or "") for m in path]
        assert chat.read_loss(r.formatted, [(s.start, s.length) for s in r.loss]) == [m[3] or "" for m in path if m[2] == "assistant"]
        assert r.n_turns == len(path) and r.formatted.count("</s>") == len(path)


def test_no_messages(spark):
    empty = spark.createDataFrame([], "message_id string, parent_id string, role string, text string, score double")
    assert chat.conversations(empty).count() == 0


def test_odd_conversations(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (1, None, "user", "x"), (None, 0, "assistant", "y"), (2, 5, "a\nb", "[/INST]")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.conversations(queries.reply_chains(turns)).collect()
    assert sorted(r.n_turns for r in out) == [1, 1, 3]


URLS = [
    None, "", "no scheme", "http://", "://x", "http://ORG", "http://ORG/", "http://a.Org/x?y#z", "https://www.example.org/es/1",
    "https://example.org/en/17", "https://example.org/en/2", "https://notexample.org/es/", "http://x.com/fr/a", "http://com/de/",
    "http://x.com/de", "http://com.net/de/", "http://a.net#frag", "http://a.net?q=http://b.org/", "http://É.COM/fr/É", "a://b://c/d",
    "http://net/" + "p" * 60_000, "http://a.net/x\ny/z", "http://ａ.net/",
]


def brute_rule(host, path):
    fits = [r for r in queries.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.place), default=None)


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(None, URLS[6], "h"), (6, URLS[6], "h")], "page_id long, url string, host string")
    out = url_filter.judge(pages, queries.RULES, url_filter.labelled_by_rules(pages, queries.RULES)).collect()
    assert len(out) == len(URLS) + 2
    for r in out:
        url = (URLS[r.page_id if r.page_id is not None else 6]) or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        rule = brute_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule.place if rule else None), url[:60]
        assert r.verdict in ("allow", "block") and (rule is None or r.verdict == rule.verdict)


def test_model_learns_from_n_grams(spark):
    bad = [(f"h{i}.net", f"/casino/{i}", True) for i in range(60)]
    good = [(f"h{i}.net", f"/library/{i}", False) for i in range(60)]
    labelled = spark.createDataFrame(bad + good, "host string, path string, blocked boolean")
    pages = spark.createDataFrame([(i, f"http://x{i}.net/{'casino' if i % 2 else 'library'}/z{i}") for i in range(40)], "page_id long, url string")
    out = url_filter.judge(pages, [], labelled).collect()
    assert all(r.verdict == ("block" if r.page_id % 2 else "allow") for r in out)
    for given, verdict in ((labelled.limit(0), "allow"), (labelled.where("blocked"), "block"), (labelled.where("not blocked"), "allow")):
        assert {r.verdict for r in url_filter.judge(pages, [], given).collect()} == {verdict}
    assert url_filter.judge(pages.limit(0), queries.RULES, url_filter.labelled_by_rules(pages.limit(0), queries.RULES)).count() == 0


def test_model_is_right_on_urls_held_out_of_the_labelled_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    labelled = url_filter.labelled_by_rules(pages, queries.RULES).withColumn("fold", F.pmod(F.xxhash64("host", "path"), F.lit(5)))
    held = labelled.where("fold = 0").select(F.xxhash64("host", "path").alias("page_id"), F.concat(F.lit("http://"), "host", "path").alias("url"), "blocked")
    judged = url_filter.judge(held.select("page_id", "url"), [], labelled.where("fold <> 0").drop("fold")).join(held.select("page_id", "blocked"), "page_id").collect()
    right = sum((r.verdict == "block") == r.blocked for r in judged)
    assert len(judged) > 50 and right > 0.9 * len(judged)


def test_url_filter_runs_no_python(spark):
    pages = spark.createDataFrame([(1, "http://a.com/de/"), (2, "http://b.org/")], "page_id long, url string")
    plan = url_filter.judge(pages, queries.RULES, url_filter.labelled_by_rules(pages, queries.RULES))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def brute_top(rows, k, every=20):
    own = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows
           if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, query) in enumerate(own):
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(query, v)), i) for n, (i, v) in enumerate(own) if n != at)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return out


@pytest.mark.parametrize("block,chunk", [(8192, 512), (70, 2)])
def test_top_k_equals_brute_force(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    monkeypatch.setattr(topk, "CHUNK_QUERIES", chunk)
    dice = np.random.default_rng(9)
    rows = [(i, dice.normal(0, 0.2, 12).astype(np.float32).tolist()) for i in range(300)]
    rows += [(400 + i, rows[20][1]) for i in range(60)]  # ties
    rows += [(20, rows[21][1]), (7, rows[7][1]), (7, rows[7][1]), (1000, None), (1001, [None] * 12), (1020, [float("nan")] * 12)]
    rows += [(1040, [float("inf")] + [0.0] * 11), (None, [0.1] * 12), (1060, []), (1061, [0.5]), (1062, [0.1] * 15), (-20, [3.0] * 12)]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    vectors = topk.quantised(table)
    got = [tuple(r) for r in topk.search(vectors, vectors.where("vec_id % 20 = 0"), 20).collect()]
    assert sorted(got) == sorted(brute_top(rows, 20))


def test_large_components_keep_their_order(spark):
    rows = [(20, [2.0**21, 1.0]), (1, [2.0**21, 0.0]), (2, [2.0**20, 5.0]), (3, [2.0**22, -1.0]), (40, [2.0**24, 2.0**25]), (41, [-(2.0**24), 3.0])]
    vectors = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = [tuple(r) for r in topk.search(vectors, vectors.where("vec_id % 20 = 0"), 20).collect()]
    assert sorted(got) == sorted(brute_top(rows, 20))
    with pytest.raises(Exception, match="2\\*\\*57"):
        topk.quantised(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>"))


def test_rows_of_one_id_are_queries_each(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 1.0]), (20, [0.0, 1.0])]
    vectors = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = [tuple(r) for r in topk.search(vectors, vectors.where("vec_id % 20 = 0"), 20).collect()]
    assert sorted(got) == sorted(brute_top(rows, 20)) and len(got) == 9


def test_top_k_of_few_rows(spark):
    table = spark.createDataFrame([(0, [0.5, -0.5]), (1, [0.25, 0.0]), (2, [-1.0, 1.0])], "vec_id long, embedding array<float>")
    vectors = topk.quantised(table)
    got = sorted(tuple(r) for r in topk.search(vectors, vectors.where("vec_id = 0"), 20).collect())
    assert got == [(0, 1, 1, 512), (0, 2, 2, -4096)]
    assert topk.search(vectors.limit(0), vectors.limit(0)).count() == 0
    assert topk.search(vectors, vectors.limit(0)).count() == 0


def test_groups_of_queries_meet_groups_of_blocks_without_a_join(spark, monkeypatch):
    for name, value in (("BLOCK_ROWS", 16), ("CHUNK_QUERIES", 2), ("CELL_QUERIES", 4), ("CELL_BYTES", 600)):
        monkeypatch.setattr(topk, name, value)
    dice = np.random.default_rng(3)
    rows = [(i % 350, dice.normal(0, 0.2, 8).astype(np.float32).tolist()) for i in range(400)]
    vectors = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    found = topk.search(vectors, vectors.where("vec_id % 20 = 0"), 20)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan  # copies of all queries went through the driver
    assert sorted(tuple(r) for r in found.collect()) == sorted(brute_top(rows, 20))


def test_cells_are_bounded_and_copy_little():
    for blocks, chunks in ((1, 1), (1, 900), (2_000, 1), (75, 61), (2_000, 1_500)):
        size, asked = blocks * (448 << 10), chunks * (256 << 10)
        b, c = topk.grid(blocks, chunks, size, asked, chunks * 512 * 20 * topk.ANSWER_BYTES, 24)
        assert 1 <= b <= blocks and 1 <= c <= chunks and b * c >= min(24, blocks * chunks)
        assert size / b <= topk.CELL_BYTES and asked / c <= topk.CELL_BYTES and chunks * 512 / c <= topk.CELL_QUERIES
    assert topk.grid(1, 1, 0, 0, 0, 24) == (1, 1)


def test_best_of_two_lists_of_any_width():
    wide = np.array([7, 2]), np.array([1 << 70, -(1 << 70)], object)
    plain = np.array([9, 3, 5]), np.array([4, 4, -1])
    ids, scores = topk.better(plain, wide, 4)
    assert ids.tolist() == [7, 3, 9, 5] and scores.tolist() == [1 << 70, 4, 4, -1]
    assert topk.better(plain, (np.array([1]), np.array([4])), 2)[0].tolist() == [1, 3]


def test_sums_of_bitmaps():
    dice = np.random.default_rng(1)
    columns = {w: [dice.integers(0, 1 << 63, (n, 3), dtype=np.uint64)] for w, n in ((0, 1), (2, 9), (3, 2), (5, 13))}
    want = np.zeros(192, np.int64)
    for w, stacks in columns.items():
        for row in stacks[0]:
            want += np.unpackbits(row.view(np.uint8), bitorder="little").astype(np.int64) << w
    sums = topk.added({w: list(s) for w, s in columns.items()})
    got = np.zeros(192, np.int64)
    for w, row in enumerate(sums):
        if row is not None:
            got += np.unpackbits(row.view(np.uint8), bitorder="little").astype(np.int64) << w
    assert (got == want).all()
