"""A/B comparison of two variants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.order_stats import order_statistics
from tallymark.operators.joins import salted_join, small_side


def assign_halves(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """First half of each test to ``a``, the rest to ``b``, by a unique order column.

    Only the order value at the middle rank is looked up, so no test is sorted.
    """
    middle = order_statistics(df, keys, order, {"_middle": 0.5}, method="index")
    out = salted_join(df, small_side(middle), list(keys), [order])
    return out.withColumn("variant", F.when(F.col(order) < F.col("_middle"), "a").otherwise("b")).drop("_middle")


def assign_by_hash(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Stable even split by a digest of the row id that any engine can compute, with no shuffle at all."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return df.withColumn("variant", F.when(digest < "8", "a").otherwise("b"))


def variant_summary(df: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    return df.groupBy(*keys, "variant").agg(
        F.count(score).alias("samples_count"),
        F.avg(score).alias("avg_score"),
        F.stddev_pop(score).alias("std_score"),
    )


def compare_variants(df: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """One row per test: moments of both variants, winner, pooled t and its degrees."""
    def of(v):
        return F.when(F.col("variant") == v, F.col(score))

    out = df.groupBy(*keys).agg(
        *[f(of(v)).alias(f"{n}_{v}") for v in "ab" for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))]
    )
    dof = F.col("n_a") + F.col("n_b") - 2
    enough = (F.col("n_a") > 1) & (F.col("n_b") > 1)
    pooled = ((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b")) / dof
    error = F.sqrt(pooled * (1 / F.col("n_a") + 1 / F.col("n_b")))
    t = F.when(enough, F.try_divide(F.col("mean_a") - F.col("mean_b"), error))
    return out.withColumns(
        {
            "winner": F.when(F.col("mean_a") > F.col("mean_b"), "a").otherwise("b"),
            "t": t,
            "dof": F.when(enough, dof),
        }
    )


def _log_gamma_step(z: Column) -> Column:
    """Logarithm of gamma(z + 1/2) / gamma(z), by its series ten units further on."""
    far = z + 10

    def tail(v):
        return 1 / (12 * v) - 1 / (360 * F.pow(v, F.lit(3))) + 1 / (1260 * F.pow(v, F.lit(5)))

    step = far * F.log1p(0.5 / far) + F.log(far) / 2 - 0.5 + tail(far + 0.5) - tail(far)
    for k in range(10):
        step -= F.log1p(0.5 / (z + k))
    return step


def two_sided_p(t: Column, dof: Column) -> Column:
    """Two-sided p value of Student's t, by the continued fraction of the incomplete beta function.

    The fraction is summed from its far end, so its state is one number; how many
    terms it needs grows with the root of the degrees of freedom.
    """
    half, x = dof / 2, dof / (dof + t * t)
    swapped = x > (half + 1) / (half + 2.5)
    p, q = F.when(swapped, 0.5).otherwise(half), F.when(swapped, half).otherwise(0.5)
    y = F.when(swapped, t * t / (dof + t * t)).otherwise(x)

    def inwards(inner, k):
        m = F.floor(k / 2)
        even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
        return 1 + F.when(k % 2 == 0, even).otherwise(odd) / inner

    terms = (200 + 4 * F.ceil(F.sqrt(dof))).cast("int")
    fraction = F.aggregate(F.sequence(terms, F.lit(1), F.lit(-1)), F.lit(1.0), inwards)
    # log of 1 / (p B(p, q)), with gamma(1/2) the root of pi
    front = _log_gamma_step(half) - F.log(F.pi()) / 2 - F.log(p)
    tail = F.exp(front + p * F.log(y) + q * F.log1p(-y)) / fraction
    tail = F.when(y <= 0, 0.0).otherwise(tail)
    return F.when(dof > 0, F.when(swapped, 1 - tail).otherwise(tail))


def with_confidence(compared: DataFrame) -> DataFrame:
    """Confidence in percent, at most 99.9; 50 where the test is undefined."""
    p = two_sided_p(F.col("t"), F.col("dof").cast("double"))
    return compared.withColumn("p_value", p).withColumn(
        "confidence",
        F.when(F.col("p_value").isNull() | F.isnan("p_value"), 50.0).otherwise(
            F.least((1.0 - F.col("p_value")) * 100, F.lit(99.9))
        ),
    )
