"""Operators over question/answer samples and their prompts."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions import lexicons as lx
from tallymark.functions.sequence import with_row_number
from tallymark.functions.text import is_blank, strip
from tallymark.operators.catalog import MODELS, ModelSpec

MAX_PROMPT_CHARS = 100_000


def filter_samples(
    df: DataFrame, language: str | None = None, category: str | None = None, difficulty: str | None = None
) -> DataFrame:
    """Rows equal to every given value; the filters reach the file scan."""
    for name, value in (("language", language), ("category", category), ("difficulty", difficulty)):
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def sample_by_id(df: DataFrame, sample_id) -> DataFrame:
    return df.where(F.col("sample_id") == F.lit(sample_id))


def mix(key: Column, seed: int) -> Column:
    """Repeatable integer spread of a row id."""
    return ((key % 1000003) * 2654435761 + seed * 40503) % 4294967296


def seeded_sample(df: DataFrame, keys: Sequence[str], key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows per group, all of a group that has no more.

    The rank filter is applied to each input partition before the shuffle, so a
    large group sends at most ``n`` rows per partition.
    """
    w = Window.partitionBy(*keys).orderBy(mix(F.col(key), seed), key)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def head(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int) -> DataFrame:
    """First ``n`` rows per group in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def batches(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """Fixed-size batches in order; a group may span any number of tasks."""
    numbered = with_row_number(df, keys, order, "_position")
    return numbered.withColumn("batch", F.floor((F.col("_position") - 1) / size).cast("long")).drop("_position")


def profile(df: DataFrame) -> DataFrame:
    """Counts per language, category and difficulty and text lengths overall."""
    lean = df.select(
        "language", "category", "difficulty", F.length("question").alias("q"), F.length("answer").alias("a")
    )
    dims = ["language", "category", "difficulty"]
    grouped = lean.groupingSets([["language"], ["category"], ["difficulty"], []], *dims).agg(
        F.grouping_id(*dims).alias("_set"),
        F.count(F.lit(1)).alias("n"),
        *[f(c).alias(f"{p}_{n}_length") for c, n in (("q", "question"), ("a", "answer"))
          for p, f in (("avg", F.avg), ("max", F.max), ("min", F.min))],
    )
    dimension = (
        F.when(F.col("_set") == 3, "language").when(F.col("_set") == 5, "category")
        .when(F.col("_set") == 6, "difficulty").otherwise("all")
    )
    value = F.coalesce("language", "category", "difficulty")
    return (
        grouped.withColumn("dimension", dimension)
        .withColumn("value", value)
        .where((F.col("dimension") == "all") | (F.coalesce(F.col("value"), F.lit("")) != ""))
        .drop("_set", *dims)
    )


def model_family(name: Column) -> Column:
    """Family and version from a model name or path."""
    n = F.lower(name)
    has = lambda s: F.contains(n, F.lit(s))
    return (
        F.when(has("llama") & has("3.2"), "llama3.2")
        .when(has("llama") & has("3.1"), "llama3.1")
        .when(has("llama") & has("3"), "llama3")
        .when(has("llama"), "llama2")
        .when(has("qwen") & has("2.5"), "qwen2.5")
        .when(has("qwen"), "qwen1.5")
        .when(has("mistral"), "mistral")
        .when(has("gemma"), "gemma")
        .otherwise("unknown")
    )


def fan_out(df: DataFrame, specs: Sequence[ModelSpec] = MODELS) -> DataFrame:
    """Every row once per catalog model, without a join or a shuffle."""
    rows = F.array(*[F.struct(F.lit(s.name).alias("model"), F.lit(s.path).alias("model_path")) for s in specs])
    return df.withColumn("_m", F.explode(rows)).select("*", "_m.model", "_m.model_path").drop("_m")


def _render(template: str, question: Column, context: Column) -> Column:
    fields = {"{question}": question, "{context}": context}
    return F.concat(*[fields.get(p, F.lit(p)) for p in re.split(r"(\{question\}|\{context\})", template) if p])


def render_prompt(
    family: Column, question: Column, context: Column, templates: dict[str, tuple[str, str]] = lx.PROMPT_TEMPLATES
) -> Column:
    """Prompt text by model family; a family without a template keeps the question."""
    empty = F.coalesce(context, F.lit("")) == ""
    out = F.when(F.lit(False), question)
    for name, (plain, with_context) in templates.items():
        text = F.when(empty, _render(plain, question, context)).otherwise(_render(with_context, question, context))
        out = out.when(family == name, text)
    return out.otherwise(question)


def prompts_for_model(df: DataFrame, model: str) -> DataFrame:
    """Samples whose question is the prompt of one model's family."""
    prompt = render_prompt(model_family(F.lit(model)), F.col("question"), F.col("context"))
    return df.withColumn("question", prompt)


def clean_prompts(df: DataFrame, column: str, limit: int = MAX_PROMPT_CHARS) -> DataFrame:
    """Cut at ``limit`` characters, trim, and flag blank and cut prompts."""
    text = F.col(column)
    return (
        df.withColumn("rejected", is_blank(text))
        .withColumn("truncated", F.coalesce(F.length(text) > limit, F.lit(False)))
        .withColumn(column, strip(F.substring(text, 1, limit)))
    )
