"""Encoding and counting against the tokenizer libraries themselves."""

import hashlib

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tallymark.llm import bpe, token_counts
from tallymark.llm.queries import BYTE_BPE, PIECE_BPE

TEXTS = [
    None, "", " ", "  ", "\n", "\n\n a", "a", "it's they'll 'something x's", "a  b   c\t\td \n e", "<|endoftext|>", "x<|endoftext|> <|endo",
    "123abc 4.5e6 ½²", "éèêç ÉÀ ñ ü ß", "日本語 テスト。", "emoji 🎉🎉 zwj 👩‍👩‍👧", "\x00\x1c\x85\xa0 　​", "<s>x</s> <unk> <0x0A>",
    "▁ ▁x a▁b", "ａｂｃ ﬁ", "q" * 3000, "ab " * 2000, "\r\n\r\n", "z" * 70 + " " + "z" * 70, " lead", "trail ",
]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(3, " "), (None, "no id"), (3, " ")]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in ROWS], "doc_id long, text string, ids string, n_tokens int")


def test_ids_and_decoding_are_the_librarys(documents):
    own = Tokenizer.from_file(BYTE_BPE)
    own.no_truncation()
    own.no_padding()
    want = []
    for i, t in ROWS:
        ids = own.encode(t or "", add_special_tokens=False).ids
        text = own.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = [tuple(r) for r in bpe.digests(bpe.round_trip(documents, BYTE_BPE)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_pieces_and_full_caches_change_nothing(monkeypatch):
    text = "".join(f"word{i} thing's été {i}\n" for i in range(800))
    want = Tokenizer.from_file(BYTE_BPE).encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(bpe, "PIECE_CHARS", 50)
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 20)
    assert bpe.ForcedBoundaryCodec(BYTE_BPE).encode(text).tolist() == want


def test_every_code_point_parts_as_in_the_library():
    own, library = bpe.codec(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)
    texts = [f"a{chr(k)}a {chr(k)}{chr(k)} 1{chr(k)}1" for k in range(0x3100) if not 0xD800 <= k < 0xE000]
    for text, found in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert own.encode(text).tolist() == found.ids, hex(ord(text[1]))


def test_certain_cuts_stand_in_no_token():
    own = bpe.codec(BYTE_BPE)
    raw = own.all_bytes
    for start, length in zip(own.start_of[:2000], own.length_of[:2000]):
        assert not len(own.fragment_bounds(raw[start : start + length])), raw[start : start + length].tobytes()


def test_counts_are_the_librarys(documents):
    own = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    want = [(i, len((t or "").encode()), len(own.encode(t or "")), len(own.encode(t or "")) > 100) for i, t in ROWS]
    got = [tuple(r) for r in token_counts.token_counts(documents, PIECE_BPE, 100).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_counts_do_not_depend_on_the_table_or_the_cache(monkeypatch):
    text = "".join(f" word{i}  été\n{i % 9}" for i in range(800))
    want = len(sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE).encode(text))
    monkeypatch.setattr(token_counts, "PIECE_CHARS", 50)
    monkeypatch.setattr(token_counts, "CACHE_ENTRIES", 20)
    own = token_counts.PieceCounter(PIECE_BPE)
    assert own.count(text, {}) == want
    assert own.count(text, dict(zip(["  été", "\n1"], own.measure(["  été", "\n1"])))) == want


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(bpe.round_trip(empty, BYTE_BPE)).count() == 0
    assert token_counts.token_counts(empty, PIECE_BPE).count() == 0


def test_vocabularies_without_certain_cuts_are_refused():
    with pytest.raises(ValueError):
        bpe.ForcedBoundaryCodec(public_tokenizers.path("word_bpe_49k.json"))
