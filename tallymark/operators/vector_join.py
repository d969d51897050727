"""Pairs of vectors above a cosine, block against block.

Vectors become unit vectors; two of cosine t are at most sqrt(2 - 2t) apart, and so are
their projections on any directions at right angles.  Vectors of a label are cut into
blocks along the first direction, every block has a box of projections, and pairs of
blocks whose boxes are farther apart are never made.  The others meet in one matrix
product each, of which only what passes the threshold leaves the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions.sequence import SLICE, ordered_slices
from tallymark.session import scratch_path

BLOCK_ROWS = 1_024
DIRECTIONS = 8
SLACK = 1e-6


def _directions(dims: int) -> np.ndarray:
    """Directions at right angles, the same in every task."""
    n = min(DIRECTIONS, dims)
    return np.linalg.qr(np.random.default_rng(dims).normal(size=(dims, n)))[0]


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """``id, label, dims, unit, box`` of ``id, label, vector``: length 1, and the projections.

    Null vectors, and those with null or non-finite components or without length, have no cosine and are left out.
    """
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in ("id", "label")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, units, boxes = [], [], []
            for i, raw in enumerate(batch.column("vector").to_pylist()):
                if not raw or any(x is None for x in raw):
                    continue
                own = np.array(raw, np.float64)
                norm = np.sqrt(own @ own)
                if not np.isfinite(norm) or norm == 0:
                    continue
                kept.append(i)
                units.append(own / norm)
                boxes.append(units[-1] @ _directions(len(own)))
            at = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(at), batch.column("label").take(at), pa.array([len(u) for u in units], pa.int32()),
                 pa.array(units, pa.list_(pa.float64())), pa.array(boxes, pa.list_(pa.float64()))],
                ["id", "label", "dims", "unit", "box"],
            )

    schema = f"id {kinds['id']}, label {kinds['label']}, dims int, unit array<double>, box array<double>"
    return vectors.select("id", "label", "vector").mapInArrow(run, schema)


def blocks(vectors: DataFrame) -> DataFrame:
    """``label, dims, block, low, high, rows``: blocks of about ``BLOCK_ROWS`` vectors with the box of each."""
    units = _stored(unit_vectors(vectors).withColumn("first", F.get("box", F.lit(0))), "units")
    slices = max(1, -(-units.count() // BLOCK_ROWS))
    cut = ordered_slices(units, ["label", "dims"], ["first", "id"], slices)
    # a slice of a label is as even as sampled borders make it; twice the size is cut again
    cut = cut.withColumn("part", F.floor((F.row_number().over(Window.partitionBy("label", "dims", SLICE).orderBy("first", "id")) - 1) / (2 * BLOCK_ROWS)).cast("int"))

    def edge(pick):
        return F.array(*[pick(F.get("box", F.lit(k))) for k in range(DIRECTIONS)])

    packed = cut.groupBy("label", "dims", SLICE, "part").agg(
        edge(F.min).alias("low"), edge(F.max).alias("high"), F.collect_list(F.struct("id", "unit")).alias("rows")
    )
    return _stored(packed.withColumn("block", F.struct(F.col(SLICE), "part")).drop(SLICE, "part"), "blocks")


def pairs_above(vectors: DataFrame, threshold: float) -> DataFrame:
    """``label, a, b, cosine``: all pairs of one label with a cosine of ``threshold`` (above 0) or more, ``a`` before ``b``.

    Vectors of different lengths are never pairs; a null label is a label like others;
    rows that share an id are pairs of each other if their vectors are.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    reach = 2 - 2 * threshold + SLACK
    table = blocks(vectors)
    boxes = table.select(F.coalesce(F.col("label").cast("string"), F.lit("\0")).alias("name"), "dims", "block", "low", "high")
    one, two = (boxes.select("name", "dims", *[F.col(c).alias(f"{c}_{n}") for c in ("block", "low", "high")]) for n in "ab")
    gap = F.aggregate(
        F.arrays_zip("low_a", "high_a", "low_b", "high_b"), F.lit(0.0),
        lambda total, x: total + F.coalesce(F.pow(F.greatest(x["low_a"] - x["high_b"], x["low_b"] - x["high_a"], F.lit(0.0)), F.lit(2.0)), F.lit(0.0)),
    )
    near = one.join(two, ["name", "dims"]).where((F.col("block_a") <= F.col("block_b")) & (gap <= reach)).select("name", "dims", "block_a", "block_b")
    rows = table.select(F.coalesce(F.col("label").cast("string"), F.lit("\0")).alias("name"), "label", "dims", "block", "rows")
    left = rows.select("name", "dims", "label", F.col("block").alias("block_a"), F.col("rows").alias("rows_a"))
    right = rows.select("name", "dims", F.col("block").alias("block_b"), F.col("rows").alias("rows_b"))
    met = near.join(left, ["name", "dims", "block_a"]).join(right, ["name", "dims", "block_b"])
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in ("id", "label")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                get = {c: batch.column(c)[at] for c in batch.schema.names}
                sides = []
                for side in ("rows_a", "rows_b"):
                    own = get[side].values
                    matrix = own.field("unit").flatten().to_numpy().reshape(len(own), -1)
                    sides.append((own.field("id"), matrix))
                (ids_a, a), (ids_b, b) = sides
                cosine = a @ b.T
                if get["same"].as_py():
                    cosine[np.tril_indices(len(a))] = -2
                i, j = np.nonzero(cosine >= threshold)
                x, y = ids_a.take(pa.array(i)), ids_b.take(pa.array(j))
                label = pa.array([get["label"].as_py()] * len(i), batch.column("label").type)
                yield pa.RecordBatch.from_arrays([label, x, y, pa.array(cosine[i, j])], ["label", "x", "y", "cosine"])

    ready = met.withColumn("same", F.col("block_a") == F.col("block_b")).select("label", "rows_a", "rows_b", "same")
    found = ready.mapInArrow(run, f"label {kinds['label']}, x {kinds['id']}, y {kinds['id']}, cosine double")
    return found.select("label", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.least(F.col("cosine"), F.lit(1.0)).alias("cosine"))
