"""Exact median of the rows before each row, in groups of any size.

Groups up to ``window_group`` rows, the usual ones, are a window function's work.
Those up to ``max_group`` rows are walked in order by one task.  A larger group is cut into slices of its order.  While a slice is walked, the median can
only move by the rows of the slice, so the slice needs no more of the earlier
rows than a band around their median; which values lie in that band is found
from counts per (slice, value cell).
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions.sequence import SLICE, ordered_slices
from tallymark.operators.joins import small_side

WINDOW_GROUP = 512  # a window sorts what it has seen once per row
MAX_GROUP = 100_000
_SALTS = 256


def with_median_before(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    counted: str,
    max_group: int = MAX_GROUP,
    slices: int | None = None,
    window_group: int = WINDOW_GROUP,
) -> DataFrame:
    """Add ``n_before`` and ``median_before`` over earlier rows flagged ``counted``.

    ``order`` must be unique in a group.  Only keys, order and the two results
    are returned.
    """
    keys = list(keys)
    lean = df.select(*keys, F.col(order).alias("_o"), F.col(value).cast("double").alias("_v"), F.col(counted).alias("_c"))
    sizes = lean.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > window_group)
    sizes = small_side(sizes)
    if sizes.isEmpty():
        return _by_window(lean, keys, order)
    usual = _by_window(lean.join(sizes, keys, "left_anti"), keys, order)
    rest = lean.join(sizes, keys)
    own = rest.where(F.col("_n") <= max_group).drop("_n").withColumn(SLICE, F.lit(0)).withColumn("_m", F.lit(0).cast("long"))
    band = None
    if not sizes.where(F.col("_n") > max_group).isEmpty():
        sliced = ordered_slices(rest.where(F.col("_n") > max_group).drop("_n"), keys, ["_o"], slices)
        band, own_large = _bands(sliced, keys, slices)
        own = own.unionByName(own_large)
    return usual.unionByName(_walk(own, band, keys, order, dict(df.dtypes)))


def _by_window(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Groups of a bounded size, without leaving the JVM."""
    before = Window.partitionBy(*keys).orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)
    kept = F.when(F.col("_c"), F.col("_v"))
    return rows.select(
        *keys, F.col("_o").alias(order), F.coalesce(F.count_if("_c").over(before), F.lit(0)).alias("n_before"),
        F.percentile(kept, 0.5).over(before).alias("median_before"),
    )


def _bands(sliced: DataFrame, keys: list[str], slices: int | None) -> tuple[DataFrame, DataFrame]:
    """Rows of each slice with the count before it, and the band each slice needs."""
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    per_slice = sliced.groupBy(*keys, SLICE).agg(F.count_if("_c").alias("_b"))
    per_slice = per_slice.withColumn("_m", F.coalesce(F.sum("_b").over(earlier), F.lit(0)))

    # value cells of even size; ties are split by the row order
    cells = ordered_slices(sliced.where("_c"), keys, ["_v", "_o"], slices, "_cell")
    counts = cells.groupBy(*keys, SLICE, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    # the histogram of every slice: at most slices x cells counts in all, set by the
    # number of partitions and not by the number of rows
    grid = per_slice.join(counts.select(*keys, "_cell").distinct(), keys).join(counts, [*keys, SLICE, "_cell"], "left")
    in_earlier = Window.partitionBy(*keys, "_cell").orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    by_cell = Window.partitionBy(*keys, SLICE).orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (
        grid.withColumn("_p", F.coalesce(F.sum("_n").over(in_earlier), F.lit(0)))
        .withColumn("_upto", F.sum("_p").over(by_cell))
        .withColumn("_below", F.col("_upto") - F.col("_p"))
    )
    low, high = (F.col("_m") - F.col("_b")) / 2 - 2, (F.col("_m") + F.col("_b")) / 2 + 2
    needed = ranked.where((F.col("_p") > 0) & (F.col("_upto") > low) & (F.col("_below") <= high)).select(
        *keys, F.col(SLICE).alias("_for"), "_cell", "_below"
    )
    # a middle cell is needed by many slices: spread its rows
    salted = needed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    rows = cells.withColumn("_salt", F.pmod(F.xxhash64("_o"), F.lit(_SALTS)).cast("int"))
    band = (
        rows.join(salted, [*keys, "_cell", "_salt"])
        .where(F.col(SLICE) < F.col("_for"))
        .select(*keys, F.col("_for").alias(SLICE), "_v", "_below")
    )
    own = sliced.join(per_slice.select(*keys, SLICE, "_m"), [*keys, SLICE])
    return band, own


def _walk(own: DataFrame, band: DataFrame | None, keys: list[str], order: str, kinds: dict[str, str]) -> DataFrame:
    """Walk each slice once: its band in value order, then its rows in order."""
    rows = own.select(*keys, SLICE, "_o", "_v", "_c", "_m", F.lit(None).cast("long").alias("_below"))
    if band is not None:
        extra = band.select(
            *keys, SLICE, F.lit(None).cast(kinds[order]).alias("_o"), "_v", F.lit(None).cast("boolean").alias("_c"),
            F.lit(None).cast("long").alias("_m"), "_below",
        )
        rows = rows.unionByName(extra)
    group = [*keys, SLICE]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, near, n, below = None, [], 0, 0
        for pdf in batches:
            sizes, medians = [], []
            inside = pdf["_below"].notna().tolist()
            columns = [pdf[c].tolist() for c in ("_v", "_c", "_m", "_below")]
            group_keys = zip(*[pdf[g].tolist() for g in group])
            for key, is_band, v, c, m, b in zip(group_keys, inside, *columns):
                if key != current:
                    current, near, n, below = key, [], -1, 0
                if is_band:
                    below = int(b) if not near else min(below, int(b))
                    near.append(v)
                    continue
                if n < 0:
                    n = int(m)
                sizes.append(n)
                medians.append((near[(n - 1) // 2 - below] + near[n // 2 - below]) / 2 if n else None)
                if c:
                    insort(near, v)
                    n += 1
            mine = pdf.loc[[not x for x in inside], [*keys, "_o"]].rename(columns={"_o": order})
            mine["n_before"] = sizes
            mine["median_before"] = pd.array(medians, dtype="Float64")
            yield mine

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*keys, order)) + ", n_before bigint, median_before double"
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_order = rows.repartition(n, *group).sortWithinPartitions(
        *group, F.col("_below").isNull(), F.when(F.col("_below").isNotNull(), F.col("_v")), "_o"
    )
    return in_order.mapInPandas(walk, schema)
