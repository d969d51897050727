"""Mixing sources to target weights by Poisson replication.

A source's rate is its target number of rows divided by the rows it has.  Every
document draws its number of copies by inverting the Poisson distribution of that
mean at a uniform number hashed from its id, so a run can be repeated anywhere.
Copies are exploded next to the scan and dealt to partitions, and put in order
inside them, by a hash: one exchange, no sampling pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import column, fresh, sized_broadcast, written

ALPHA = 0.7  # without given weights a source weighs its rows to this power
SEED = "mix"
STEP = 200.0  # larger rates are drawn as a sum of equal ones, so that exp(-rate) stays a normal number
SALTS = 32


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def rates(documents: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, alpha: float = ALPHA) -> DataFrame:
    """``source, n, rate`` per source; a null source is one of its own.

    ``weights`` names the share of each source (others: 0); ``total`` is the wanted
    number of rows, that of the input if not given.
    """
    counted = documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    weight = F.pow(F.col("n").cast("double"), F.lit(alpha))
    if weights is not None:
        weight = F.lit(0.0)
        for name, share in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(share))).otherwise(weight)
    counted = written(counted.withColumn("weight", weight), "sources")
    whole = counted.agg(F.sum("n").alias("n"), F.sum("weight").alias("weight")).first()
    goal, shares = float(total if total is not None else whole["n"] or 0), float(whole["weight"] or 0)
    return counted.select(
        "source", "n", (F.lit(goal) * F.col("weight") / F.lit(shares or 1.0) / F.col("n")).alias("rate")
    )


def _steps(rate: Column) -> Column:
    """Distribution function of a Poisson number at 0, 1, 2, … up to where it is 1."""
    terms = F.sequence(F.lit(1), F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int"))
    start = F.struct(F.exp(-rate).alias("term"), F.array(F.exp(-rate)).alias("sums"))

    def grow(state: Column, k: Column) -> Column:
        term = state["term"] * rate / k
        return F.struct(term.alias("term"), F.concat(state["sums"], F.array(F.element_at(state["sums"], -1) + term)).alias("sums"))

    return F.aggregate(terms, start, grow, lambda state: state["sums"])


def mix(
    documents: DataFrame,
    weights: dict[str, float] | None = None,
    total: float | None = None,
    alpha: float = ALPHA,
    seed: str = SEED,
) -> DataFrame:
    """Every document as often as it is drawn, with ``copy`` (from 1) and ``mix_key``, in hashed order.

    A document's draw depends on its ``doc_id`` (its text, where the id is null)
    and the seed only; repeated rows are drawn alike.  Null and empty texts are
    documents like others, a null source is a source.  Columns of the input named
    ``copy`` or ``mix_key`` are replaced.
    """
    keep = [c for c in documents.columns if c not in ("copy", "mix_key")]
    docs = documents.select(*[column(c) for c in keep])
    rate, parts, steps, source, salt, share = (fresh(docs, n) for n in ("_rate", "_parts", "_steps", "_source", "_salt", "_share"))
    # rows that repeat id and text have one key; where they were read deals them apart
    docs = docs.withColumn(share, F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    table = rates(documents, weights, total, alpha).select(
        F.col("source").alias(source), (F.col("rate") / F.greatest(F.lit(1.0), F.ceil(F.col("rate") / STEP))).alias(rate),
        F.greatest(F.lit(1), F.ceil(F.col("rate") / STEP)).cast("int").alias(parts),
    )
    table = written(table.withColumn(steps, _steps(F.col(rate))), "rates")
    size = F.octet_length(F.coalesce(F.col(source), F.lit(""))) + 8 * F.size(steps) + 64
    table, small = sized_broadcast(table, size)
    same = column("source").eqNullSafe(F.col(source))
    key = F.coalesce(column("doc_id").cast("string"), F.md5(F.coalesce(column("text"), F.lit("")).cast("binary")))
    if not small:  # very many sources: deal each to several tasks, as one may hold a third of the rows
        table = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        same &= F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int") == F.col(salt)
    drawn = F.aggregate(
        F.sequence(F.lit(1), F.col(parts)), F.lit(0),
        lambda n, part: n + F.size(F.filter(F.col(steps), lambda s: s <= _uniform(F.lit(seed), key, part.cast("string")))),
    )
    if small:
        # one draw is the rule; hashed once, not once per step
        uniform = fresh(docs, "_uniform")
        docs = docs.withColumn(uniform, _uniform(F.lit(seed), key, F.lit("1")))
        once = F.size(F.filter(F.col(steps), lambda s: s <= F.col(uniform)))
        drawn = F.when(F.col(parts) == 1, once).otherwise(drawn)
    joined = docs.join(table, same)
    copies = joined.withColumn("copy", F.explode(F.when(drawn > 0, F.sequence(F.lit(1), drawn)).otherwise(F.array().cast("array<int>"))))
    keyed = copies.withColumn(
        "mix_key", F.md5(F.concat_ws("|", F.lit(seed), F.lit("place"), key, F.col("copy").cast("string")).cast("binary"))
    )
    dealt = keyed.select(*[column(c) for c in keep], "copy", "mix_key", share).repartition("mix_key", share)
    return dealt.sortWithinPartitions("mix_key").drop(share)
