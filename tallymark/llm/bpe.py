"""Byte-level BPE by forced-boundary splitting, and its decoding.

A pair of bytes that stands inside no vocabulary token can never be bridged by
a merge, so every such pair in a text is a certain cut.  Pre-tokens are cut
there, the fragments are encoded on their own and the ids are put in a row;
merges left of a cut cannot touch those right of it, so the ids are those of the
whole text.  Fragments recur far more often than words, and every worker keeps
those (and the pre-tokens) it has met in a bounded cache.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallymark.llm.common import texts

CACHE_ENTRIES = 400_000  # of each cache; a full cache starts anew
RUN_LETTERS = 160  # new fragments go to the merges in runs of about this length
IDS = np.dtype("<i4")
PIECE_CHARS = 1 << 20  # longer texts go through in pieces, cut where pre-tokens part anyway


def _pre_token(letter: str, number: str, space: str) -> str:
    """The pattern by which the vocabulary's pre-tokenizer parts a text (fixed by the vocabulary)."""
    return (
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+"
        rf"|[{space}]+(?![^{space}])|[{space}]+"
    )


def _latin(kinds: str) -> str:
    """Characters below U+0250 whose Unicode category starts with one of ``kinds``."""
    return "".join(re.escape(chr(k)) for k in range(0x250) if unicodedata.category(chr(k))[0] in kinds)


# Unicode White_Space, spelled out: engines differ on a few control characters.
_SPACE = r"\t-\r \x85\xa0  -     　"
PRE_TOKEN = regex.compile(_pre_token(r"\p{L}", r"\p{N}", _SPACE))
# The same for Latin texts, several times as fast with plain character sets.
_LATIN_PRE_TOKEN = re.compile(_pre_token(_latin("L"), _latin("N"), r"\t-\r \x85\xa0"))
_NOT_LATIN = re.compile(r"[^\x00-ɏ]")
_SAFE_CUT = re.compile(r"[A-Za-z](?= [A-Za-z])")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable
    Latin-1 bytes stand for themselves, the others for U+0100 and on, in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class ForcedBoundaryCodec:
    """Encoder and decoder of one vocabulary file; a worker builds it once."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if spec["normalizer"] or spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        added = spec["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError(f"{path} has added tokens that take in their surroundings")
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        vocab = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in added}
        bytes_of = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            bytes_of[i] = token
        for token, i in self.special.items():
            bytes_of[i] = token.encode()
        self.split_special = re.compile(
            "(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")" if self.special else "(?!)()"
        )
        self.inside = np.zeros((256, 256), bool)  # pairs of bytes that stand side by side in some token
        for token in vocab:
            for pair in zip(token, token[1:]):
                self.inside[pair] = True
        self.letters = str.maketrans({b: c for b, c in enumerate(letters)})
        self.merge = Tokenizer.from_file(path).model.tokenize  # the merges alone, without pre-tokens or added tokens
        self.length_of = np.array([len(b) for b in bytes_of])
        self.start_of = np.cumsum(self.length_of) - self.length_of
        self.all_bytes = np.frombuffer(b"".join(bytes_of), np.uint8)
        self.words: dict[str, bytes] = {}  # ids as packed 32-bit numbers
        self.fragments: dict[bytes, bytes] = {}

    def fragment_bounds(self, raw: np.ndarray) -> np.ndarray:
        """Positions at which ``raw`` is certain to be cut."""
        return np.flatnonzero(~self.inside[raw[:-1], raw[1:]]) + 1

    def _runs(self, fragments: list[bytes]) -> Iterator[list[bytes]]:
        """Fragments in runs whose joints are certain cuts themselves."""
        run: list[bytes] = []
        size = 0
        for fragment in fragments:
            if run and (size > RUN_LETTERS or self.inside[run[-1][-1], fragment[0]]):
                yield run
                run, size = [], 0
            run.append(fragment)
            size += len(fragment)
        if run:
            yield run

    def _encode_new(self, fragments: list[bytes]) -> None:
        """Encode fragments that the cache lacks; ids part at the fragments' ends, as joints cannot be bridged."""
        for run in self._runs(fragments):
            letters = b"".join(run).decode("latin-1").translate(self.letters)
            ids = np.array([t.id for t in self.merge(letters)], IDS)
            packed, start = ids.tobytes(), 0
            ends = np.searchsorted(np.cumsum(self.length_of[ids]), list(accumulate(map(len, run))), "right")
            for fragment, end in zip(run, (ends * IDS.itemsize).tolist()):
                self.fragments[fragment] = packed[start:end]
                start = end

    def _learn(self, words: set[str]) -> None:
        """Encode pre-tokens that the cache lacks, fragment by fragment."""
        if len(self.words) + len(words) > CACHE_ENTRIES:
            self.words.clear()
        if len(self.fragments) > CACHE_ENTRIES:
            self.fragments.clear()
        order = [w.encode() for w in words]
        raw = b"".join(order)
        ends = list(accumulate(map(len, order)))
        cuts = self.fragment_bounds(np.frombuffer(raw, np.uint8)).tolist()
        bounds = sorted({*cuts, *ends})
        parts = [raw[a:b] for a, b in zip([0, *bounds], bounds)]
        self._encode_new([p for p in dict.fromkeys(parts) if p not in self.fragments])
        known, start = self.fragments, 0
        for word, end in zip(words, ends):
            at = bounds.index(end, start) + 1
            self.words[word] = known[parts[start]] if at == start + 1 else b"".join(map(known.__getitem__, parts[start:at]))
            start = at

    def _pieces(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > PIECE_CHARS:
            cut = _SAFE_CUT.search(text, start + PIECE_CHARS)
            if not cut:
                break
            yield text[start : cut.end()]
            start = cut.end()
        yield text[start:] if start else text

    def encode(self, text: str) -> np.ndarray:
        packed: list[bytes] = []
        for k, part in enumerate(self.split_special.split(text)):
            if k % 2:
                packed.append(IDS.type(self.special[part]).tobytes())
                continue
            for piece in self._pieces(part):
                words = (PRE_TOKEN if _NOT_LATIN.search(piece) else _LATIN_PRE_TOKEN).findall(piece)
                distinct = set(words)
                missing = distinct.difference(self.words)
                if missing:
                    full = len(self.words) + len(missing) > CACHE_ENTRIES
                    self._learn(distinct if full else missing)
                packed += map(self.words.__getitem__, words)
        return np.frombuffer(b"".join(packed), IDS)

    def decode(self, ids: np.ndarray) -> str:
        """The tokens' bytes in a row; bytes that are no UTF-8 become U+FFFD."""
        lengths = self.length_of[ids]
        ends = np.cumsum(lengths)
        at = np.repeat(self.start_of[ids] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ids) else 0)
        return self.all_bytes[at].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str) -> ForcedBoundaryCodec:
    return ForcedBoundaryCodec(path)


def round_trip(documents: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, ids array<int>, decoded string`` of every document.

    Whole texts go through one Python pass next to the scan; nothing is shuffled.
    A null text counts as empty (no ids, empty decoded text), a null ``doc_id``
    stays null, repeated rows are encoded as often as they occur, other columns
    are not read.  ``vocabulary`` is the path of a byte-level BPE file that every
    executor has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            names, rows, size = batch.column("doc_id"), [], 0
            start = 0
            for at, text in enumerate(texts(batch)):
                ids = own.encode(text)
                rows.append((ids, own.decode(ids)))
                size += len(ids)
                if size > 1 << 20:
                    yield _rows(names.slice(start, at + 1 - start), rows)
                    start, rows, size = at + 1, [], 0
            if rows:
                yield _rows(names.slice(start), rows)

    return documents.select("doc_id", "text").mapInArrow(run, _schema(documents))


def _schema(documents: DataFrame) -> str:
    return f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string"


def _rows(names: pa.Array, rows: list[tuple[np.ndarray, str]]) -> pa.RecordBatch:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(i) for i, _ in rows], out=offsets[1:])
    ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([i for i, _ in rows])))
    return pa.RecordBatch.from_arrays([names, ids, pa.array([d for _, d in rows], pa.string())], ["doc_id", "ids", "decoded"])


def digests(encoded: DataFrame) -> DataFrame:
    """Counts and SHA-256 digests of what ``round_trip`` returns."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
