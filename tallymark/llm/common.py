"""What the training-data operators share: tables, scratch, sized broadcasts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tallymark.session import scratch_path

BROADCAST_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, so that later steps read
    it again instead of computing it again, whichever executors are lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized_broadcast(df: DataFrame, row_bytes: Column, limit: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """Mark a *written* table for broadcast if its rows add up to at most ``limit`` bytes."""
    size = df.agg(F.coalesce(F.sum(row_bytes), F.lit(0)).alias("n")).first()["n"]
    return (F.broadcast(df), True) if size <= limit else (df, False)


def column(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def map_all_columns(
    df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType
) -> DataFrame:
    """``mapInArrow`` over all columns, whatever their names; Spark's own looks names with dots up as fields."""
    names = df.columns

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batch.rename_columns(names) for batch in batches):
            yield batch.rename_columns([f"c{i}" for i in range(batch.num_columns)])

    plain = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])
    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(renamed, plain).toDF(*schema.names)


def texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[str]:
    """The batch's texts one by one; null is the empty text."""
    for value in batch.column(name):
        yield value.as_py() or ""


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    """The batch's texts as UTF-8; null is the empty text."""
    for value in batch.column(name).cast(pa.binary()):
        yield value.as_py() or b""


def groups_by_size(items: Iterable[bytes], limit: int) -> Iterator[list[bytes]]:
    """Consecutive items in groups of about ``limit`` bytes, at least one item each."""
    group, size = [], 0
    for item in items:
        group.append(item)
        size += len(item)
        if size >= limit:
            yield group
            group, size = [], 0
    if group:
        yield group
