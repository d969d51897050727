"""Memory needs of models and what fits on which device."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions import lexicons as lx


def model_memory_gb(
    path: Column,
    in_4bit: Column,
    in_8bit: Column,
    sizes: Sequence[tuple[str, float]] = lx.MODEL_SIZES_GB,
    parity: bool = False,
) -> Column:
    """Memory need from the size token in a model path, less for quantised ones.

    The longest token is tried first, so ``13b`` is not read as ``3b``;
    ``parity`` tries them in listed order instead.
    """
    ordered = sizes if parity else sorted(sizes, key=lambda s: -len(s[0]))
    low = F.lower(path)
    base = F.when(F.lit(False), 0.0)
    for token, gb in ordered:
        base = base.when(F.contains(low, F.lit(token)), gb)
    base = base.otherwise(lx.DEFAULT_MODEL_GB)
    return base * F.when(in_4bit, 0.5).when(in_8bit, 0.75).otherwise(1.0)


def with_need(models: DataFrame, parity: bool = False) -> DataFrame:
    need = model_memory_gb(F.col("model_path"), F.col("load_in_4bit"), F.col("load_in_8bit"), parity=parity)
    return models.withColumn("need_gb", need)


def fit_report(pairs: DataFrame) -> DataFrame:
    """Whether a model fits 90 % of a device as it is, in 4 bits, or not at all.

    ``pairs`` has need_gb, load_in_4bit and total_gb per (model, device).
    """
    room = F.col("total_gb") * 0.9
    need = F.col("need_gb")
    shrink = (need > room) & ~F.col("load_in_4bit")
    final = F.when(shrink, need * 0.5).otherwise(need)
    return pairs.withColumns(
        {
            "exceeds_90": need > room,
            "exceeds_total": need > F.col("total_gb"),
            "final_gb": final,
            "plan": F.when(need <= room, "fits").when(shrink & (final <= room), "fits in 4-bit").otherwise("too large"),
        }
    )


def capacity_check(pairs: DataFrame) -> DataFrame:
    """Free memory covers the need plus 10 % of the device, outside an emergency."""
    enough = F.col("free_gb") >= F.col("need_gb") + F.col("total_gb") * 0.1
    return pairs.withColumn("safe", enough & (F.col("level") != "emergency"))


# GPU memory tiers with a score per model size, and speed factors.
TIERS = (
    (160, {"70B": 1.0, "30B": 1.0, "13B": 1.0, "7B": 1.0}),
    (80, {"70B": 0.7, "30B": 1.0, "13B": 1.0, "7B": 1.0}),
    (32, {"70B": 0.3, "30B": 0.8, "13B": 1.0, "7B": 1.0}),
    (16, {"70B": 0.0, "30B": 0.2, "13B": 0.7, "7B": 1.0}),
    (8, {"70B": 0.0, "30B": 0.0, "13B": 0.3, "7B": 0.8}),
    (0, {"70B": 0.0, "30B": 0.0, "13B": 0.0, "7B": 0.5}),
)
SPEED_FACTORS = {"7B": 0.9, "13B": 0.7, "30B": 0.4, "70B": 0.2}


def size_scores(hosts: DataFrame, gpu_gb: str = "gpu_gb") -> DataFrame:
    """Score and predicted speed per host and model size."""
    memory = F.col(gpu_gb)
    rows = []
    for size, factor in SPEED_FACTORS.items():
        score = F.when(F.lit(False), 0.0)
        for floor, scores in TIERS:
            score = score.when(memory >= floor, scores[size])
        speed = F.greatest(F.least(memory * 5, F.lit(100.0)) * factor, F.lit(0.0))
        rows.append(
            F.struct(
                F.lit(size).alias("model_size"),
                score.otherwise(TIERS[-1][1][size]).alias("score"),
                speed.alias("predicted_speed"),
            )
        )
    return hosts.withColumn("_r", F.explode(F.array(*rows))).select("*", "_r.*").drop("_r")
