"""Line dedup over overlapping three-line windows.

Lines that hold a word are taken three at a time.  A window that occurs more than
once in the corpus stays where it comes first (by ``doc_id``, then position); the
lines that its later occurrences cover are removed.  Documents are read twice: once
for the windows' hashes, once to cut the covered lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import column, fresh, map_all_columns, raw_texts, written

WINDOW = 3


def _word_lines(lines: list[bytes]) -> list[int]:
    return [i for i, line in enumerate(lines) if line.strip()]


def windows(documents: DataFrame, size: int = WINDOW) -> DataFrame:
    """``high, low`` (128-bit hash), ``doc_id, body`` (hash of the text), ``first, last`` line of every window.

    Blank lines are passed over; a text with fewer lines than a window has none.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"high long, low long, doc_id {kind}, body long, first int, last int"

    def rows(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, int, int]]:
        for at, text in enumerate(raw_texts(batch)):
            lines = text.split(b"\n")
            own = _word_lines(lines)
            if len(own) >= size:
                body = xxhash.xxh64_intdigest(text, 42)  # what xxhash64 of the column gives
                for k in range(len(own) - size + 1):
                    span = own[k : k + size]
                    yield xxhash.xxh3_128_intdigest(b"\n".join([lines[i] for i in span])), at, body, span[0], span[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(rows(batch))
            if not found:
                continue
            hashes, at, body, first, last = zip(*found)
            mask = (1 << 64) - 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.array([h >> 64 for h in hashes], np.uint64).view(np.int64)),
                    pa.array(np.array([h & mask for h in hashes], np.uint64).view(np.int64)),
                    batch.column("doc_id").take(pa.array(at)),
                    pa.array(np.array(body, np.uint64).view(np.int64)),
                    pa.array(first, pa.int32()), pa.array(last, pa.int32()),
                ],
                ["high", "low", "doc_id", "body", "first", "last"],
            )

    return documents.select("doc_id", "text").mapInArrow(run, schema)


def covered(documents: DataFrame, size: int = WINDOW) -> DataFrame:
    """``doc_id, body, spans``: merged runs of lines that later occurrences cover."""
    found = written(windows(documents, size), "windows")
    place = F.struct("doc_id", "body", "first")
    repeated = (
        found.groupBy("high", "low").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("origin"))
        .where("n > 1").select("high", "low", "origin")
    )
    later = found.join(repeated, ["high", "low"]).where(~place.eqNullSafe(F.col("origin")))
    spans = later.groupBy("doc_id", "body").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("spans"))
    return spans


def dedup(documents: DataFrame, size: int = WINDOW) -> DataFrame:
    """All documents with ``text`` cut, and ``removed`` (numbers of the lines that went), ``n_lines``.

    A null or empty text has no windows and stays as it is, and so does a text of
    fewer than three lines with words; a row with a null ``doc_id`` comes first in
    the order of occurrences.  Rows that repeat both id and text hold the same
    occurrences, so they are all cut alike.  Columns of the input named like the
    two new ones are replaced.
    """
    keep = [c for c in documents.columns if c not in ("removed", "n_lines")]
    left = documents.select(*[column(c) for c in keep])
    spans = fresh(left, "_spans")
    cuts = covered(documents, size).select(
        F.struct("doc_id", "body").alias(fresh(left, "_cut")), F.col("spans").alias(spans)
    )
    own, cut = F.struct(column("doc_id"), F.xxhash64(column("text")).alias("body")), column(cuts.columns[0])
    joined = left.join(cuts, (own["doc_id"].eqNullSafe(cut["doc_id"])) & (own["body"] == cut["body"]), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new, removed, counts = [], [], []
            for text, own in zip(batch.column("text"), batch.column(spans)):
                value = text.as_py()
                if value is None:
                    new.append(None)
                    removed.append([])
                    counts.append(0)
                    continue
                lines = value.split("\n")
                counts.append(len(lines))
                gone = sorted({i for s in own.as_py() or () for i in range(s["first"], s["last"] + 1)})
                removed.append(gone)
                if gone:
                    out = set(gone)
                    value = "\n".join([line for i, line in enumerate(lines) if i not in out])
                new.append(value)
            columns = [pa.array(new, pa.string()) if c == "text" else batch.column(c) for c in keep]
            columns += [pa.array(removed, pa.list_(pa.int32())), pa.array(counts, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "removed", "n_lines"])

    schema = left.withColumn("removed", F.lit(None).cast("array<int>")).withColumn("n_lines", F.lit(0)).schema
    return map_all_columns(joined.select(*[column(c) for c in keep], column(spans)), run, schema)
