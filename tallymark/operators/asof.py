"""As-of joins: each row meets the last row of another table at or below its place.

Both tables are laid in one order and cut into even slices; a slice keeps the last
right row it has seen, and slices hand theirs on.  No row meets more than one other,
nothing is compared by inequality, and one key may hold all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.sequence import with_running


def as_of(
    left: DataFrame, right: DataFrame, keys: Sequence[str], on: str, tie: Sequence[str] = (), slices: int | None = None
) -> DataFrame:
    """``left`` with the columns of the right row that has its keys and the largest ``on`` not above its own.

    Of right rows at one place the largest by ``tie`` counts.  Left rows without such
    a row, or with a null ``on``, have nulls; a null key is a key like others.  The other
    right columns must have names of their own.
    """
    values = [c for c in right.columns if c not in (*keys, on)]
    first = [on, *tie, *[c for c in values if c not in tie]]
    told = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(first)])
    kinds = {f.name: f.dataType for f in right.schema}
    empty = F.struct(*[F.lit(None).cast(kinds[c]).alias(f"_{i}") for i, c in enumerate(first)])
    own = left.select(*keys, F.col(on).alias("_on"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"))
    row_type = own.schema["_row"].dataType
    theirs = right.where(F.col(on).isNotNull()).select(
        *keys, F.col(on).cast(left.schema[on].dataType).alias("_on"), F.lit(0).alias("_side"), F.lit(None).cast(row_type).alias("_row"), told.alias("_met")
    )
    both = own.withColumn("_met", F.when(F.lit(False), empty)).unionByName(theirs)
    met = with_running(both, keys, ["_on", "_side"], {"_last": ("max", F.col("_met"))}, slices)
    return met.where("_side = 1").select("_row.*", *[F.col(f"_last._{first.index(c)}").alias(c) for c in values])


def banded(left: DataFrame, floors: DataFrame, keys: Sequence[str], value: str, floor: str, slices: int | None = None) -> DataFrame:
    """``left`` with the row of ``floors`` whose band its value lies in: the largest floor not above it."""
    placed = left.withColumn("_at", F.col(value).cast("double"))
    bands = floors.withColumn("_at", F.col(floor).cast("double"))
    return as_of(placed, bands, keys, "_at", slices=slices).drop("_at")


def tier_rows(spark, tiers: Sequence[tuple[float, dict[str, float]]], factors: dict[str, float]) -> DataFrame:
    """Tiers of configuration as rows ``model_size, floor_gb, score, factor``."""
    def number(x: float) -> Column:
        return F.lit(float(x))

    rows = [
        F.struct(F.lit(size).alias("model_size"), number(low).alias("floor_gb"), number(scores[size]).alias("score"), number(factors[size]).alias("factor"))
        for low, scores in tiers for size in scores
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))
