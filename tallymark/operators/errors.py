"""Error-log classification and statistics."""

from __future__ import annotations

import builtins
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions import lexicons as lx
from tallymark.operators import pattern_index
from tallymark.operators.joins import salted_join, small_side


def _family(*roots: type) -> list[str]:
    """Names of the roots and of all standard exception classes that derive from them."""
    known = {**vars(builtins), "JSONDecodeError": json.JSONDecodeError}
    return sorted(n for n, c in known.items() if isinstance(c, type) and issubclass(c, roots))


MISSING_MODULE = _family(ImportError)
NO_ACCESS = _family(OSError)  # the operating system's errors: files, permissions, connections, time-outs
WRONG_VALUE = _family(ValueError, TypeError)


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def classify(df: DataFrame, patterns: Sequence[tuple] = lx.ERROR_PATTERNS, severity: str | None = None) -> DataFrame:
    """Category, severity and advice: the first pattern found, else inferred.

    The pattern list is configuration and becomes one literal, so the lookup is
    part of the scan stage in batch and stream alike.  A ``severity`` column in
    the log overrules the pattern's.
    """
    message = F.lower(F.col("message"))
    kind = F.col("exception_type")
    has = lambda *words: _any([F.contains(message, F.lit(w)) for w in words])

    rules = F.array(
        *[
            F.struct(
                F.lit(p.lower()).alias("pattern"), F.lit(c).alias("category"), F.lit(s).alias("severity"),
                _strings(a).alias("suggestions"),
            )
            for p, c, s, a in patterns
        ]
    )
    first = F.get(F.filter(rules, lambda r: F.contains(message, r["pattern"])), F.lit(0))
    category = (
        F.when(has("memory", "cuda"), "memory")
        .when(kind.isin(*MISSING_MODULE), "dependency")
        .when(kind.isin(*NO_ACCESS), "permission")
        .when(has("config", "setting"), "configuration")
        .when(has("model", "load"), "model_loading")
        .when(has("network", "connection"), "network")
        .otherwise("unknown")
    )
    inferred = (
        F.when(has("cuda out of memory", "device-side assert"), "critical")
        .when(has("memory", "permission denied"), "high")
        .when(kind.isin(*MISSING_MODULE, *WRONG_VALUE), "medium")
        .otherwise("low")
    )
    advice = F.when(kind == "ModuleNotFoundError", _strings(lx.GENERIC_ADVICE["ImportError"]))
    for name, texts in lx.GENERIC_ADVICE.items():
        advice = advice.when(kind == name, _strings(texts))
    advice = advice.otherwise(_strings(lx.DEFAULT_ADVICE))
    given = [F.col(severity)] if severity else []
    return (
        df.withColumn("_rule", first)
        .withColumns(
            {
                "category": F.coalesce(F.col("_rule.category"), category),
                "severity": F.coalesce(*given, F.col("_rule.severity"), inferred),
                "suggestions": F.coalesce(F.col("_rule.suggestions"), advice),
                "pattern": F.col("_rule.pattern"),
            }
        )
        .drop("_rule")
    )


def _any(tests: Sequence[Column]) -> Column:
    out = tests[0]
    for test in tests[1:]:
        out = out | test
    return out


def first_match(df: DataFrame, patterns: DataFrame) -> DataFrame:
    """Text against a pattern table by ``contains``; the lowest priority wins.

    For pattern tables kept as data, of any size: distinct messages are looked up in
    an index of the patterns' q-grams, and rows meet the result of their message.
    Case does not count.  Rows without a match, null messages among them, have nulls.
    Of patterns with one priority the least by (pattern, category) wins.
    """
    rules = patterns.groupBy(F.lower("pattern").alias("pattern"), F.col("priority").alias("rank")).agg(F.min("category").alias("category"))
    said = df.select(F.lower("message").alias("text")).where(F.col("text").isNotNull()).distinct()
    hits = pattern_index.occurrences(said.select(F.sha2("text", 256).alias("id"), "text"), rules, first_only=True)
    named = salted_join(hits, small_side(rules), ["pattern", "rank"], ["id"])
    found = small_side(named.select(F.col("id").alias("_message"), "pattern", "category"))
    told = df.drop("pattern", "category").withColumn("_message", F.sha2(F.lower("message"), 256))
    return told.join(found, "_message", "left").drop("_message")


def error_stats(df: DataFrame) -> DataFrame:
    """Totals, by category, by severity, and resolved ones, in one pass."""
    out = df.groupingSets([["category"], ["severity"], []], "category", "severity").agg(
        F.grouping_id("category", "severity").alias("_set"),
        F.count(F.lit(1)).alias("errors"),
        F.count_if(F.col("resolved")).alias("resolved_count"),
    )
    return out.select(
        F.when(F.col("_set") == 1, "category").when(F.col("_set") == 2, "severity").otherwise("all").alias("dimension"),
        F.coalesce("category", "severity").alias("value"),
        "errors",
        "resolved_count",
    )


def error_history(
    df: DataFrame,
    category: str | None = None,
    severity: str | None = None,
    limit: int | None = None,
    per_source: int | None = None,
) -> DataFrame:
    """Newest errors first; with ``per_source`` each source's history is cut to its newest rows before."""
    out = df
    if per_source:
        newest = Window.partitionBy("source").orderBy(F.desc("ts"), F.desc("error_id"))
        out = df.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= per_source).drop("_n")
    if category:
        out = out.where(F.col("category") == category)
    if severity:
        out = out.where(F.col("severity") == severity)
    out = out.orderBy(F.desc("ts"), F.desc("error_id"))
    return out.limit(limit) if limit else out
