"""Running totals and row order inside groups of any size.

A window over ``partitionBy(key)`` sorts a whole group in one task.  Here rows
are range-partitioned on key and order together, so a large group is spread
over many even slices; the slices are stored once, and each row combines its
place in the slice with the total of the slices before it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.operators.joins import null_safe_join
from tallymark.session import ensure_checkpoint_dir

SLICE = "_slice"
_COMBINE = {"sum": F.sum, "max": F.max}


def ordered_slices(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], slices: int | None = None, name: str = SLICE
) -> DataFrame:
    """Rows tagged with a slice number that grows with ``order`` in each group.

    ``order`` must be unique within a group; slice sizes are then even however
    the rows are spread over groups.  The tagged rows are checkpointed, so every
    later step sees the same slices even after an executor is lost.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *keys, *order).withColumn(name, F.spark_partition_id()).checkpoint()


def with_running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    totals: Mapping[str, tuple[str, Column]],
    slices: int | None = None,
    lean: bool = False,
) -> DataFrame:
    """Running sums or maxima of each group, up to and with the row.

    ``totals`` maps a new column to ``("sum" | "max", expression)``.  With ``lean``
    only keys, order and the values are put in slices and stored, and rows get their
    totals by key and order, which must be unique then.
    """
    if lean:
        values = {f"_v{i}": value for i, (_, value) in enumerate(totals.values())}
        own = df.select(*keys, *order, *[v.alias(n) for n, v in values.items()])
        named = {name: (kind, F.col(v)) for v, (name, (kind, _)) in zip(values, totals.items())}
        told = with_running(own, keys, order, named, slices).select(*keys, *order, *totals)
        return null_safe_join(df, told, [*keys, *order])
    sliced = ordered_slices(df, keys, order, slices)
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # one row per (group, slice): at most slices + groups rows
    per_slice = sliced.groupBy(*keys, SLICE).agg(*[_COMBINE[k](c).alias(f"_{n}") for n, (k, c) in totals.items()])
    offsets = per_slice.select(
        *keys, SLICE, *[_COMBINE[k](f"_{n}").over(earlier).alias(f"_{n}") for n, (k, _) in totals.items()]
    )

    def merged(name: str, kind: str, value: Column) -> Column:
        local, before = _COMBINE[kind](value).over(so_far), F.col(f"_{name}")
        if kind == "sum":
            return F.coalesce(local, F.lit(0)) + F.coalesce(before, F.lit(0))
        return F.greatest(local, before)

    return (
        null_safe_join(sliced, offsets, [*keys, SLICE])
        .withColumns({n: merged(n, k, c) for n, (k, c) in totals.items()})
        .drop(SLICE, *[f"_{n}" for n in totals])
    )


def with_row_number(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "row_number", slices: int | None = None
) -> DataFrame:
    """One-based position of each row in its group; ``order`` is unique in it."""
    return with_running(df, keys, order, {name: ("sum", F.lit(1))}, slices, lean=set(df.columns) > {*keys, *order})
