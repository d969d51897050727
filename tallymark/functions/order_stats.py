"""Exact order statistics of groups of any size.

``percentile`` and ``collect_list`` gather every distinct value of a group in
one task, and ``percentile_approx`` is not exact.  Here the wanted ranks are
narrowed down in passes instead, each a pre-aggregated histogram:

1. logarithmic cells of the whole value range;
2. equal slices of the cells that hold a wanted rank, where such a cell holds
   more rows than one task should order;
3. the distinct values of the cells or slices that hold one.

No task sees more than one histogram of one group, whatever the group's size
or distribution, and equal values are merged before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.operators.joins import measured_side, null_safe_join, small_side

CELLS_PER_OCTAVE = 128
SLICES = 1 << 16
CELL_ROWS = 1_000_000
_OFFSET = 1100 * CELLS_PER_OCTAVE


def _log_cell(value: Column) -> Column:
    """Cell number that never falls as the value grows."""
    v = value.cast("double")
    cell = F.floor(F.log2(F.abs(v)) * CELLS_PER_OCTAVE) + F.lit(_OFFSET)
    return F.when(v == 0, F.lit(0).cast("bigint")).otherwise((F.signum(v) * cell).cast("bigint"))


def _slice(value: Column) -> Column:
    lo, hi = F.col("_lo").cast("double"), F.col("_hi").cast("double")
    span = hi - lo
    return F.when(span > 0, F.floor((value.cast("double") - lo) / span * SLICES)).otherwise(F.lit(0).cast("bigint"))


def _ranks_linear(total: Column, p: float) -> tuple[Column, Column, Column]:
    position = F.lit(float(p)) * (total - 1)
    low = F.floor(position)
    return low, F.ceil(position), position - low


def _ranks_index(total: Column, p: float) -> tuple[Column, Column, Column]:
    index = F.least(F.floor(total * F.lit(float(p))), total - 1)
    return index, index, F.lit(0.0)


_RANKS = {"linear": _ranks_linear, "index": _ranks_index}


def order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    points: Mapping[str, float],
    method: str = "linear",
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """One row per group with one column per named point.

    ``linear`` interpolates between the neighbours of ``p * (n - 1)``;
    ``index`` takes the value at zero-based rank ``floor(p * n)``; ``approx`` is
    one pass of Spark's sketch, for when the exact value is not needed.
    Null values are ignored; null keys form groups like any other.
    """
    keys = list(keys)
    if method == "approx":
        return df.groupBy(*keys).agg(*[F.percentile_approx(value, p, 10_000).alias(n) for n, p in points.items()])
    rank_of = _RANKS[method]
    total = F.col("_total")
    rows = df.select(*keys, F.col(value).alias("_v")).where(F.col("_v").isNotNull())

    by_group = Window.partitionBy(*keys)
    seen = F.col("_seen")
    holds = lambda r: (r >= seen - F.col("_n")) & (r < seen)

    # pass 1: logarithmic cells
    cells = rows.groupBy(*keys, _log_cell(F.col("_v")).alias("_cell")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    running = by_group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(*rank_of(total, p)[:2]) for p in points.values()])))
    picked = (
        cells.withColumn("_seen", F.sum("_n").over(running))
        .withColumn("_total", F.sum("_n").over(by_group))
        .withColumn("_want", F.filter(wanted, holds))
        .where(F.size("_want") > 0)
        .select(*keys, "_cell", "_n", "_lo", "_hi", "_want", "_total", (seen - F.col("_n")).alias("_before"))
    )
    picked, fullest = measured_side(picked, F.col("_n"))

    # pass 2: equal slices of the picked cells
    if (fullest or 0) <= cell_rows:
        picked = picked.withColumn("_slice", F.lit(0).cast("bigint"))
    else:
        celled = rows.withColumn("_cell", _log_cell(F.col("_v")))
        in_cell = null_safe_join(celled, picked.drop("_n"), [*keys, "_cell"])
        slices = in_cell.groupBy(*keys, "_cell", _slice(F.col("_v")).alias("_slice")).agg(
            F.count(F.lit(1)).alias("_n"),
            F.min("_v").alias("_lo"),
            F.max("_v").alias("_hi"),
            F.min("_before").alias("_before"),
            F.min("_want").alias("_want"),
            F.min("_total").alias("_total"),
        )
        running = (
            Window.partitionBy(*keys, "_cell")
            .orderBy("_slice")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        picked = (
            slices.withColumn("_seen", F.sum("_n").over(running) + F.col("_before"))
            .withColumn("_want", F.filter("_want", holds))
            .where(F.size("_want") > 0)
            .select(
                *keys, "_cell", "_slice", "_n", "_lo", "_hi", "_want", "_total", (seen - F.col("_n")).alias("_before")
            )
        )
        picked = small_side(picked)

    # pass 3: distinct values of the picked slices
    value_in = F.col("_v").between(F.col("_lo"), F.col("_hi"))
    celled = rows.withColumn("_cell", _log_cell(F.col("_v")))
    values = (
        null_safe_join(celled, picked.drop("_n"), [*keys, "_cell"])
        .where(value_in)
        .groupBy(*keys, "_cell", "_slice", "_v")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.min("_before").alias("_before"),
            F.min("_want").alias("_want"),
            F.min("_total").alias("_total"),
        )
    )
    running = (
        Window.partitionBy(*keys, "_cell", "_slice")
        .orderBy("_v")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = (
        values.withColumn("_seen", F.sum("_n").over(running) + F.col("_before"))
        .withColumn("_want", F.filter("_want", holds))
        .where(F.size("_want") > 0)
    )

    def at(rank: Column) -> Column:
        return F.max(F.when(F.array_contains("_want", rank), F.col("_v")))

    columns = []
    for name, p in points.items():
        low, high, part = rank_of(total, p)
        if method == "index":
            columns.append(at(low).alias(name))
        else:
            columns.append((at(low) + (at(high) - at(low)) * F.max(part)).alias(name))
    return ranked.groupBy(*keys).agg(*columns)
