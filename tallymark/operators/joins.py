"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.session import ensure_checkpoint_dir

BROADCAST_MAX_ROWS = 200_000
BROADCAST_MAX_BYTES = 64 * 1024 * 1024
HOT_MIN_ROWS = 1_000_000
HOT_MAX_KEYS = 1_024
SALTS = 64
PROBE_ONE_IN = 64


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Use every core for costly row work on a small scan.

    A scan with fewer splits than cores is hash-partitioned by a row id; a
    large one already has more splits than cores and is left where it lies.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores, *keys)


def small_side(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Write ``df`` once, measure it, and mark it for broadcast if it is small.

    Beyond ``max_rows`` or ``max_bytes`` the written table is returned unmarked,
    so the join that follows is an ordinary shuffle join.
    """
    return measured_side(df, F.lit(0), max_rows, max_bytes)[0]


def measured_side(
    df: DataFrame, measure: Column, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES
) -> tuple[DataFrame, object]:
    """``small_side`` and the largest value of a column, read in the same action."""
    ensure_checkpoint_dir(df.sparkSession)
    stored = df.checkpoint()
    size, n_bytes, largest = stored.agg(F.count(F.lit(1)), F.sum(_row_bytes(df)), F.max(measure)).first()
    return (F.broadcast(stored) if size <= max_rows and (n_bytes or 0) <= max_bytes else stored), largest


def _row_bytes(df: DataFrame) -> Column:
    """About what a row takes: 16 bytes a column, and what texts and nested values hold."""
    held = F.lit(16 * len(df.columns)).cast("long")
    for field in df.schema:
        kind, value = field.dataType, F.col(f"`{field.name}`")
        if isinstance(kind, (T.StringType, T.BinaryType)):
            held += F.coalesce(F.octet_length(value), F.lit(0))
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            held += F.coalesce(F.octet_length(F.to_json(F.struct(value))), F.lit(0))
    return held


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join in which a null key is a value like any other, as it is in a group."""
    other = {k: f"_right_{k}" for k in keys}
    right = right.withColumnsRenamed(other)
    same = F.lit(True)
    for own, theirs in other.items():
        same &= F.col(own).eqNullSafe(F.col(theirs))
    return left.join(right, same, how).drop(*other.values())


def hot_keys(
    df: DataFrame, keys: Sequence[str], spread_by: Sequence[str], min_rows: int = HOT_MIN_ROWS, one_in: int = PROBE_ONE_IN
) -> DataFrame:
    """Keys that hold about ``min_rows`` rows or more, the ``HOT_MAX_KEYS`` largest of them.

    Only used to decide which keys to split, never to choose rows of a result:
    one row in ``one_in`` (by a hash of the row id) is counted, which is plenty
    for keys of that size, and a key past the cut holds under 1/``HOT_MAX_KEYS``
    of the table.
    """
    probe = df.select(*dict.fromkeys([*keys, *spread_by]))
    if one_in > 1:
        probe = probe.where(F.pmod(F.xxhash64(*spread_by, F.lit(1)), F.lit(one_in)) == 0)
    return (
        probe.groupBy(*keys)
        .agg((F.count(F.lit(1)) * one_in).alias("_rows"))
        .where(F.col("_rows") >= min_rows)
        .orderBy(F.desc("_rows"), *keys)
        .limit(HOT_MAX_KEYS)
        .select(*keys, F.lit(True).alias("_hot"))
    )


def salted_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    min_rows: int = HOT_MIN_ROWS,
    salts: int = SALTS,
    one_in: int = PROBE_ONE_IN,
) -> DataFrame:
    """Equi join of a fact table to a table with one (or few) rows per key.

    Hot keys are looked for first.  Without any, this is a plain join; otherwise
    their rows are spread over ``salts`` sub-keys by a hash of ``spread_by`` (a
    row id, so copies of a row part too), and only the matching rows of
    ``small`` are repeated.  ``how`` is ``inner`` or ``left``.
    """
    keys = list(keys)
    hot = small_side(hot_keys(big, keys, spread_by, min_rows, one_in))
    if hot.isEmpty():
        return big.join(small, keys, how)
    is_hot = F.col("_hot").isNotNull()
    salt = F.when(is_hot, F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    left = big.join(hot, keys, "left").withColumn("_salt", salt).drop("_hot")
    right = small.join(hot, keys, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
