"""Bounded samples of labelled documents, as hashed features."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import raw_texts
from tallymark.llm.features import counted

FOLDS = 5
SAMPLE_BYTES = 48 << 20  # bound of the sample's texts together


def fold(doc_id: str = "doc_id") -> Column:
    """Remainder that sets rows aside: CRC32 of the id as text, modulo five (a null id counts as empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending buckets as gaps, then counts, deflated: about a quarter of the pairs as they are."""
    gaps = np.diff(keys, prepend=np.int32(0))
    return zlib.compress(gaps.astype("<i4").tobytes() + counts.astype("<i4").tobytes(), 1)


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts again; counts in the narrowest kind of number that holds them."""
    gaps, counts = np.frombuffer(zlib.decompress(raw), "<i4").reshape(2, -1)
    return np.cumsum(gaps, dtype=np.int32), counts.astype(np.min_scalar_type(int(counts.max(initial=0))))


def _chosen(documents: DataFrame, labels: DataFrame, rows: int, text_bytes: int) -> list[tuple]:
    """``(doc_id, body, label, place)`` of the sample, at most ``rows`` of them and about ``text_bytes`` of text.

    Order is by hashes of id and text, so it does not follow any order of the tables.
    Only keys and sizes are sorted and collected.
    """
    wanted = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (fold() != 0))
        .select("doc_id", (F.col("quality") > 0).cast("int").alias("label"), F.xxhash64("doc_id", F.lit(7)).alias("place"))
        .distinct().orderBy("place", "doc_id", "label").limit(rows)
    )
    own = documents.select("doc_id", F.xxhash64("text").alias("body"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    met = own.join(F.broadcast(wanted), "doc_id").distinct()
    found, room = [], text_bytes
    for r in met.orderBy("place", "doc_id", "body", "label").limit(rows).collect():
        room -= r["size"]
        if room < 0 and found:
            break
        found.append((r["doc_id"], r["body"], r["label"], r["place"]))
    return found


def sample(
    documents: DataFrame, labels: DataFrame, bits: int, rows: int, text_bytes: int = SAMPLE_BYTES
) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(label, order, buckets, counts)`` of up to ``rows`` labelled documents and about ``text_bytes`` of text.

    Rows whose fold is 0 are held out.  Rows alike in id and text count once; an id
    with several texts or labels gives one row for each.  A row brings the driver at most one
    pair per bucket and never more pairs than four per byte of its text, packed.  Null ids and null labels
    take no part; null texts are empty.
    """
    chosen = _chosen(documents, labels, rows, text_bytes)
    if not chosen:
        return []
    kind = documents.schema["doc_id"].dataType.simpleString()
    spark = documents.sparkSession
    wanted = spark.createDataFrame(chosen, f"doc_id {kind}, body long, label int, place long")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [packed(*counted(t, bits)) for t in raw_texts(batch)]
            columns = [batch.column("label"), batch.column("place"), batch.column("body"), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["label", "place", "body", "pairs"])

    own = documents.select("doc_id", F.xxhash64("text").alias("body"), "text")
    joined = own.join(F.broadcast(wanted), ["doc_id", "body"])
    once = joined.groupBy("doc_id", "body", "label", "place").agg(F.any_value("text").alias("text"))
    lean = once.select("label", "place", "body", "text")
    table = lean.mapInArrow(features, "label int, place long, body long, pairs binary").toArrow()
    # which task finished first must not show in the model
    ordered = table.sort_by([("place", "ascending"), ("label", "ascending"), ("body", "ascending")])
    del table
    found = []
    for label, place, pairs in zip(*(ordered.column(c) for c in ("label", "place", "pairs"))):
        found.append((label.as_py(), place.as_py(), *unpacked(pairs.as_py())))
    return found
