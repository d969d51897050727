"""Token counts by a map-side two-tier lookup.

A sentencepiece BPE vocabulary whose pieces hold white space only at their start
(checked when it is loaded) never merges across the start of a run of spaces, nor
across a line end, which no piece holds.  A text's count is therefore the sum over
its pre-tokens.  Tier one is a broadcast table of frequent pre-tokens' lengths,
tier two each worker's cache of those it has encoded itself.  No pre-token of the
corpus is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import texts

TABLE_ENTRIES = 65_536  # the broadcast table's bound
SAMPLE_DOCUMENTS = 4_096  # documents in which frequent pre-tokens are looked for
CACHE_ENTRIES = 300_000
PIECE_CHARS = 1 << 20
KEY_CHARS = 64  # longer pre-tokens are never kept

# A space and U+2581 are one symbol to the vocabulary; a line end is a symbol of its own.
PRE_TOKEN = re.compile("[ ▁]+[^ ▁\n]*|\n[^ ▁\n]*")
_SAFE_CUT = re.compile("[^ ▁](?=[ ▁\n])")


class PieceCounter:
    """Counts pre-tokens of one vocabulary; a worker builds it once."""

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces) or self.model.encode(" a ", out_type=str)[-1] != "▁":
            raise ValueError(f"{path} merges across white space; its texts have no safe cuts")
        self.cache: dict[str, int] = {}

    def measure(self, tokens: list[str]) -> list[int]:
        """Lengths of pre-tokens: each is encoded behind a line end, which costs two tokens and parts it from the rest."""
        return [len(ids) - 2 for ids in self.model.encode(["\n" + t for t in tokens], num_threads=1)]

    def count(self, text: str, table: dict[str, int]) -> int:
        total = 0
        for piece in pieces_of(text):
            tokens = PRE_TOKEN.findall(piece)
            lengths = list(map(table.get, tokens))
            if None in lengths:
                rest = [t for t, n in zip(tokens, lengths) if n is None]
                distinct = set(rest)
                missing = list(distinct.difference(self.cache))
                if missing:
                    if len(self.cache) + len(missing) > CACHE_ENTRIES:
                        self.cache.clear()
                        missing = list(distinct)
                    self.cache.update(zip(missing, self.measure(missing)))
                total += sum(map(self.cache.__getitem__, rest))
                total += sum(n for n in lengths if n is not None)
                for token in [t for t in missing if len(t) > KEY_CHARS]:
                    del self.cache[token]
            else:
                total += sum(lengths)
        return total


def pieces_of(text: str) -> Iterator[str]:
    """The text behind the vocabulary's leading space, long ones in pieces cut before white space."""
    if not text:
        return
    text, start = " " + text, 0
    while len(text) - start > PIECE_CHARS:
        cut = _SAFE_CUT.search(text, start + PIECE_CHARS)
        if not cut:
            break
        yield text[start : cut.end()]
        start = cut.end()
    yield text[start:] if start else text


@lru_cache(maxsize=4)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def frequent_lengths(documents: DataFrame, vocabulary: str) -> dict[str, int]:
    """Lengths of the pre-tokens most frequent in a sample of documents.

    The table decides only where a length comes from, never what it is, so it is
    fitted on about ``SAMPLE_DOCUMENTS`` documents, spread by a hash of their ids.
    Tasks count their part; only the sample's counts meet.
    """
    rows = documents.count()
    if not rows:
        return {}
    parts = max(1, rows // SAMPLE_DOCUMENTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for batch in batches:
            for text in texts(batch):
                for piece in pieces_of(text):
                    found.update(t for t in PRE_TOKEN.findall(piece) if len(t) <= KEY_CHARS)
        top = found.most_common(TABLE_ENTRIES)
        yield pa.RecordBatch.from_arrays(
            [pa.array([t for t, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["token", "n"]
        )

    sample = documents.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == 0).select("text")
    top = (
        sample.mapInArrow(count, "token string, n long")
        .groupBy("token").agg(F.sum("n").alias("n"))
        .where("n > 1").orderBy(F.desc("n"), "token").limit(TABLE_ENTRIES)
        .toArrow()
    )
    tokens = top.column("token").to_pylist()
    return dict(zip(tokens, counter(vocabulary).measure(tokens)))


def token_counts(documents: DataFrame, vocabulary: str, limit: int = 4_096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every document.

    Whole texts, next to the scan, without a shuffle.  A null text counts as
    empty (no bytes, no tokens), a null ``doc_id`` stays null, repeated rows are
    counted each, other columns are not read.  ``vocabulary`` is a sentencepiece
    BPE file that every executor has.
    """
    frequent = frequent_lengths(documents, vocabulary)
    keys = sorted(frequent)
    compact = documents.sparkSession.sparkContext.broadcast((keys, np.array([frequent[k] for k in keys], np.uint16)))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, lookup = counter(vocabulary), unpacked(compact)
        for batch in batches:
            counts = [own.count(t, lookup) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    sized = documents.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = sized.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


_UNPACKED: dict[str, object] = {}


def unpacked(compact) -> dict[str, int]:
    """The broadcast table as a dict, built once per worker."""
    keys, lengths = compact.value
    if _UNPACKED.get("keys") is not keys:
        _UNPACKED.update(keys=keys, table=dict(zip(keys, lengths.tolist())))
    return _UNPACKED["table"]
