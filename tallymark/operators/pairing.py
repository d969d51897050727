"""Keyed pairing of predictions with samples, statistics and models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.operators.joins import salted_join


def with_truth(predictions: DataFrame, samples: DataFrame, how: str = "left") -> DataFrame:
    """Predictions with their sample, by sample id.

    Failed generations stay paired with their own sample instead of shifting
    the rows after them.  A sample asked very often is salted by request.
    """
    return salted_join(predictions, samples, ["sample_id"], ["request_id"], how)


def unmatched(predictions: DataFrame, samples: DataFrame) -> DataFrame:
    """Ids found on one side only, with the number of predictions behind each."""
    asked = predictions.groupBy("sample_id").agg(F.count(F.lit(1)).alias("predictions"))
    known = samples.select("sample_id")
    no_truth = asked.join(known, "sample_id", "left_anti").withColumn("missing", F.lit("truth"))
    no_prediction = known.join(asked, "sample_id", "left_anti").select(
        "sample_id", F.lit(0).cast("long").alias("predictions"), F.lit("prediction").alias("missing")
    )
    return no_truth.unionByName(no_prediction)


def with_stats(predictions: DataFrame, stats: DataFrame) -> DataFrame:
    """Predictions with their generation statistics, by request id."""
    return predictions.join(stats, "request_id", "left")


def coverage(expected: DataFrame, responses: DataFrame) -> DataFrame:
    """Per model: prompts due, answered, failed and missing.

    ``expected`` holds one row per (sample, model); responses are reduced to
    that key before the join.
    """
    answered = responses.groupBy("sample_id", "model").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("error")).alias("failed")
    )
    return (
        expected.select("sample_id", "model")
        .join(answered, ["sample_id", "model"], "left")
        .groupBy("model")
        .agg(
            F.count(F.lit(1)).alias("prompts"),
            F.count("n").alias("answered"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("responses"),
            F.coalesce(F.sum("failed"), F.lit(0)).alias("errors"),
            F.count_if(F.col("n").isNull()).alias("missing"),
        )
    )
