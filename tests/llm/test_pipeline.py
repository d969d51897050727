"""Every stage of the pipeline, and all of them in a row, against plain Python."""

import hashlib
import math
import random
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
import tokenizers
import xxhash

from tallymark.llm import quality_classifier
from test_dedup import brute_components, brute_lines, brute_print, pairs_within

STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `odd.name` int, score int"


def some_documents():
    dice = random.Random(12)
    words = ["".join(dice.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    passage = "\n".join(" ".join(dice.choices(words, k=8)) for _ in range(4))
    rows = []

    def add(text, doc_id=None, source="a", named=True):
        rows.append((len(rows) if named and doc_id is None else doc_id, text, "en", source, None if text is None else len(text), len(rows), 1))

    for n in range(60):
        body = "\n".join(" ".join(dice.choices(words, k=dice.randrange(6, 12))) for _ in range(dice.randrange(3, 7)))
        add(body + ("\n" + passage if n % 5 == 0 else ""), source=dice.choice(["a", "a", "a", "b", None]))
        if n % 6 == 0:  # copies: letter case, one changed word, none
            add(body.upper())
            add(body.replace(words[3], words[4], 1))
            add(body)
    for n in range(20):
        add("$$$ ### " * 10 + "junk " * n, source="bad")
    for text in (None, "", " \n ", "word"):
        add(text)
        add(text, named=False)
    rows += [rows[1], rows[1], (rows[2][0], "another text of this id", "en", None, 23, 900, 1), rows[-1]]
    return rows


def sorted_rows(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    rows = some_documents()
    labels = [(r[0], 0 if r[3] == "bad" else 1, 0) for r in rows if r[0] is not None and r[1]]
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


@pytest.fixture(scope="module")
def model(spark, tables):
    folder, rows = tables
    return quality_classifier.fit(frame(spark, rows), spark.read.parquet(f"{folder}/labels.parquet"))


def brute_good(rows, model):
    scores = model.scores([(r[1] or "").encode() for r in rows])
    return [r for r, s in zip(rows, scores) if s >= quality_classifier.THRESHOLD]


def brute_cut(rows):
    out = []
    for r, (_, gone, text) in zip(rows, brute_lines([r[:2] for r in rows])):
        if not gone or text.encode().strip():
            out.append((r[0], text, *r[2:4], len(text) if gone else r[4], *r[5:]))
    return out


def brute_one_of_each(rows):
    distinct = sorted({brute_print(r[1]) for r in rows})
    of = brute_components(distinct, pairs_within(distinct))

    def body(text):  # what Spark's xxhash64 gives: its seed for null
        value = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
        return value - (1 << 64) if value >= 1 << 63 else value

    first = {}
    for r in rows:
        key = (r[0] is None, r[0] or 0, body(r[1]))
        first[of[brute_print(r[1])]] = min(first.get(of[brute_print(r[1])], key), key)
    out = {}
    for r in rows:
        key = (r[0] is None, r[0] or 0, body(r[1]))
        if first[of[brute_print(r[1])]] == key:
            out.setdefault(key, []).append(r)
    return out


def brute_mix(rows):
    n = Counter(r[3] for r in rows)
    whole = sum(v**0.7 for v in n.values())
    out = []
    for r in rows:
        rate = len(rows) * n[r[3]] ** 0.7 / whole / n[r[3]]
        name = str(r[0]) if r[0] is not None else hashlib.md5((r[1] or "").encode()).hexdigest()
        dice = int(hashlib.md5(f"mix|{name}|1".encode()).hexdigest()[:13], 16) / (1 << 52)
        copies, term, up_to = 0, math.exp(-rate), math.exp(-rate)
        while up_to <= dice:
            copies += 1
            term *= rate / copies
            up_to += term
        out += [r] * copies
    return out


def brute_encoded(rows):
    library = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    library.no_truncation()
    library.no_padding()
    out = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        out.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    return out


def test_good_documents(spark, tables, model):
    folder, rows = tables
    out = STAGES["quality classifier"](spark, frame(spark, rows), folder)
    want = brute_good(rows, model)
    assert out.columns == frame(spark, rows).columns and sorted_rows(out.collect()) == sorted_rows(want)
    assert not [r for r in want if r[3] == "bad"] and len(want) > 60


def test_lines_cut(spark, tables):
    folder, rows = tables
    out = STAGES["line dedup"](spark, frame(spark, rows), folder)
    assert out.columns == frame(spark, rows).columns
    assert sorted_rows(out.collect()) == sorted_rows(brute_cut(rows))


def test_one_of_near_copies(spark, tables):
    folder, rows = tables
    out = [tuple(r) for r in STAGES["near-dedup"](spark, frame(spark, rows), folder).collect()]
    groups = list(brute_one_of_each(rows).values())
    assert len(out) == len(groups) and all(any(o in g for o in out) for g in groups)


def test_mixed(spark, tables):
    folder, rows = tables
    out = STAGES["mixing"](spark, frame(spark, rows), folder)
    assert out.columns == frame(spark, rows).columns
    assert sorted_rows(out.collect()) == sorted_rows(brute_mix(rows))


def test_encoded(spark, tables):
    folder, rows = tables
    out = STAGES["BPE encoding"](spark, frame(spark, rows), folder)
    assert sorted_rows(out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == sorted_rows(brute_encoded(rows))


def test_all_stages_in_a_row(spark, tables, model):
    folder, rows = tables
    unique = [g[0] for g in brute_one_of_each(brute_cut(brute_good(rows, model))).values()]
    want = brute_encoded(brute_mix(unique))
    out = corpus_pipeline.run(spark, folder)
    assert sorted_rows(out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == sorted_rows(want)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_an_empty_table(spark, tables, name):
    folder, _ = tables
    assert STAGES[name](spark, frame(spark, []), folder).count() == 0
