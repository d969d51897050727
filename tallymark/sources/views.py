"""Fact tables of model evaluation, derived from the driver's tables.

Each function takes (spark, folder) and returns a DataFrame; only the columns
an operator asks for are read from the files.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions import lexicons as lx
from tallymark.functions.sequence import with_row_number
from tallymark.functions.text import is_blank, strip
from tallymark.operators.catalog import MODELS
from tallymark.operators.joins import salted_join, small_side, spread
from tallymark.operators.pattern_index import occurrences


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """One generation per row: who answered, how fast, how large, did it fail."""
    return responses_of(table(spark, folder, "events"))


def responses_of(events: DataFrame) -> DataFrame:
    """The same of event rows, stored or streamed."""
    k = F.get_json_object("props", "$.k").cast("int")
    latency = F.col("value") / 100
    return events.select(
        F.col("event_id").alias("request_id"),
        "ts",
        F.concat(F.lit("m"), F.col("user_id") % 8).alias("model"),
        F.concat(F.lit("d"), F.col("user_id") % 5).alias("dataset"),
        F.to_date("ts").alias("day"),
        (F.col("user_id") * 10 + k % 10).alias("sample_id"),
        latency.alias("latency_s"),
        k.alias("output_tokens"),
        (F.col("event_type") == "error").alias("error"),
        (4000 + F.col("event_id") % 4000).cast("double").alias("memory_usage_mb"),
        F.when(latency > 0, k / latency).otherwise(0.0).alias("tokens_per_second"),
    )


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Responses with a score in percent points; failed ones have none."""
    r = responses(spark, folder)
    return r.withColumn("score_pct", F.when(~F.col("error"), F.col("output_tokens"))).withColumn(
        "score", F.col("score_pct") / 100
    )


def host_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Telemetry ticks per deployment; every third deployment has a GPU."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, folder, "events").select(
        F.col("user_id").alias("deployment"),
        F.concat(F.lit("m"), F.col("user_id") % 8).alias("model"),
        F.col("event_id").alias("tick_id"),
        "ts",
        F.least(F.lit(100.0), F.col("value")).alias("cpu_percent"),
        k.cast("double").alias("memory_percent"),
        (F.col("event_id") % 100).cast("double").alias("disk_percent"),
        F.when(F.col("user_id") % 3 == 0, k / 10).otherwise(0.0).alias("gpu_memory_gb"),
        (F.col("value") / 50).alias("response_s"),
    )


def device_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Memory ticks of 16 devices of 80 GB."""
    used = F.least(F.col("value"), F.lit(100.0)) / 100
    return table(spark, folder, "events").select(
        (F.col("user_id") % 16).alias("device"),
        F.col("event_id").alias("tick_id"),
        "ts",
        F.lit(80.0).alias("total_gb"),
        used.alias("utilization"),
        (used * 80).alias("allocated_gb"),
        (80 - used * 80).alias("free_gb"),
    )


# What the errors view may say, by k % 16: the known patterns and two unknown texts.
ERROR_TEXTS = tuple(f"Run failed: {p[0].upper()} (attempt 1)" for p in lx.ERROR_PATTERNS) + (
    "Connection reset by network peer",
    "Unexpected value in row",
)
EXCEPTION_TYPES = (
    "RuntimeError", "ImportError", "ValueError", "OSError", "MemoryError", "ConnectionResetError", "BrokenPipeError",
    "JSONDecodeError", "UnicodeDecodeError", "ModuleNotFoundError", "PermissionError", "FileNotFoundError", "TimeoutError",
    "TypeError", "KeyError", "NotADirectoryError",
)


def errors(spark: SparkSession, folder: str) -> DataFrame:
    """Error log with a message, an exception type and a source."""
    k = F.get_json_object("props", "$.k").cast("int")
    texts = F.array(*[F.lit(t) for t in ERROR_TEXTS])
    kinds = F.array(*[F.lit(t) for t in EXCEPTION_TYPES])
    return (
        table(spark, folder, "events")
        .where(F.col("event_type") == "error")
        .select(
            F.col("event_id").alias("error_id"),
            "ts",
            F.col("user_id").alias("source"),
            F.get(texts, k % len(ERROR_TEXTS)).alias("message"),
            F.get(kinds, (F.col("event_id") % len(EXCEPTION_TYPES)).cast("int")).alias("exception_type"),
            (F.col("event_id") % 4 == 0).alias("resolved"),
        )
    )


def task_log(spark: SparkSession, folder: str) -> DataFrame:
    """Tasks with an executor type and a state; open ones have no end."""
    state = (
        F.when(F.col("o_orderstatus") == "F", "completed")
        .when((F.col("o_orderstatus") == "P") & (F.col("o_custkey") % 3 == 0), "failed")
        .when((F.col("o_orderstatus") == "P") & (F.col("o_custkey") % 3 == 1), "timeout")
        .when(F.col("o_orderstatus") == "P", "cancelled")
        .when(F.col("o_custkey") % 2 == 0, "running")
        .otherwise("pending")
    )
    executor = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "thread").when(
        F.col("o_orderpriority") == "3-MEDIUM", "process"
    )
    created = F.col("o_orderdate")
    done = F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 180).cast("int"))
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("task_id"),
        executor.otherwise("async").alias("executor_type"),
        state.alias("state"),
        created.alias("created_at"),
        F.when(~state.isin("running", "pending"), created + done).alias("completed_at"),
        F.col("o_totalprice").alias("rss_mb"),
        (F.col("o_custkey") % 50).alias("worker"),
    )


def trials(spark: SparkSession, folder: str) -> DataFrame:
    """Parameter trials; the trial order is (order, line, part, price).

    Failed and pruned trials have no score.
    """
    state = (
        F.when(F.col("l_returnflag") == "R", "failed")
        .when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O"), "pruned")
        .otherwise("complete")
    )
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("study"),
        F.concat(F.lit("m"), F.col("l_suppkey") % 8).alias("model"),
        F.concat(F.lit("d"), F.col("l_suppkey") % 5).alias("dataset"),
        F.struct(
            F.col("l_orderkey").alias("o"),
            F.col("l_linenumber").alias("l"),
            F.col("l_partkey").alias("p"),
            F.col("l_extendedprice").alias("x"),
        ).alias("trial"),
        (F.col("l_discount") * 10).alias("temperature"),
        (F.lit(0.1) + F.col("l_tax") * 10).alias("top_p"),
        (F.col("l_quantity") * 2).cast("int").alias("top_k"),
        (F.col("l_linenumber") * 70).alias("max_new_tokens"),
        (F.lit(1.0) + F.col("l_tax")).alias("repetition_penalty"),
        F.when(state == "complete", (F.col("l_extendedprice") % 1000) / 1000).alias("score"),
        state.alias("state"),
        F.col("l_shipdate").alias("ts"),
    )


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """Question/answer samples over whole texts; a document answers with all of its text."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("sample_id"),
        F.col("text").alias("question"),
        F.col("text").alias("answer"),
        F.col("lang").alias("language"),
        F.col("source").alias("category"),
        F.when(F.col("n_chars") < 500, "easy")
        .when(F.col("n_chars") < 2000, "medium")
        .otherwise("hard")
        .alias("difficulty"),
    )


def models(spark: SparkSession) -> DataFrame:
    """The model catalog, a few rows of configuration."""
    rows = [
        F.struct(
            F.lit(m.name).alias("model"), F.lit(m.path).alias("model_path"),
            F.lit(m.load_in_4bit).alias("load_in_4bit"), F.lit(m.load_in_8bit).alias("load_in_8bit"),
        )
        for m in MODELS
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def chat_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """User turns with the assistant turn that comes next, whatever numbers turns have.

    Turns are numbered in slices, so no conversation is gathered whole, and only
    keys are put in order; texts meet the pairs found by their own keys.
    """
    turns = table(spark, folder, "conversations")
    placed = with_row_number(turns.select("conv_id", "turn", "role"), ["conv_id"], ["turn"], "place")
    asked = placed.where(F.col("role") == "user").select("conv_id", F.col("turn").alias("asked"), (F.col("place") + 1).alias("place"))
    answered = placed.where(F.col("role") == "assistant").select("conv_id", "turn", "place")
    pairs = asked.join(answered, ["conv_id", "place"]).drop("place")
    questions = turns.select("conv_id", F.col("turn").alias("asked"), F.col("text").alias("question"))
    answers = turns.select("conv_id", "turn", F.col("text").alias("prediction"))
    return pairs.join(questions, ["conv_id", "asked"]).join(answers, ["conv_id", "turn"]).select("conv_id", "turn", "question", "prediction")


def pairs_similar(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs of ``partners`` with both whole texts.

    Pairs are found on ids and line hashes.  Texts are then read again beside the
    ids of the pairs, so a text moves only if it has a pair, and a document that
    very many others meet is split by document id.
    """
    pairs = small_side(partners(spark, folder))
    docs = table(spark, folder, "documents")
    refs = small_side(pairs.select("ref_id").distinct())
    texts = spread(docs.select("doc_id", "lang", F.col("text").alias("prediction")), "doc_id").join(pairs, "doc_id")
    truths = docs.select(F.col("doc_id").alias("ref_id"), F.col("text").alias("truth")).join(refs, "ref_id", "left_semi")
    paired = salted_join(texts, truths, ["ref_id"], ["doc_id"])
    return paired.select("doc_id", "ref_id", "lang", "prediction", "truth")


def _line_partners(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, ref_id``: each document and the first one of its language that has one of its lines, per line.

    Only ids and line hashes move, and a line that very many documents hold is
    split by document id.
    """
    docs = table(spark, folder, "documents")
    lines = docs.select("doc_id", "lang", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line"))
    lines = lines.where(~is_blank(F.col("line"))).select("doc_id", "lang", F.xxhash64("line").alias("line"))
    return _after_first(lines, ["lang", "line"])


def _after_first(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``doc_id, ref_id``: each row's document and the first one with its keys, where that is another."""
    first = rows.groupBy(*keys).agg(F.min("doc_id").alias("ref_id"), F.max("doc_id").alias("_last"))
    first = first.where(F.col("_last") > F.col("ref_id")).drop("_last")
    met = salted_join(rows, first, keys, ["doc_id"]).where(F.col("doc_id") > F.col("ref_id"))
    return met.select("doc_id", "ref_id")


def partners(spark: SparkSession, folder: str) -> DataFrame:
    """Each document against the first one of its language with each of its lines, and the first with its whole text.

    Whole texts are compared stripped and in lower case, by digests.  At most one
    pair per line and one per document; a pair that several lines give is one.
    """
    langs = table(spark, folder, "documents").select("doc_id", "lang", _digest().alias("digest"))
    copies = _after_first(langs.where(F.col("digest") != ""), ["lang", "digest"])
    return _line_partners(spark, folder).unionByName(copies).distinct()


def _digest() -> Column:
    text = F.lower(strip(F.col("text")))
    return F.when(text == "", F.lit("")).otherwise(F.sha2(text.cast("binary"), 256))


def text_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Digest of each document's stripped, lower-cased text; empty for a blank one.

    Two digests are equal exactly if the texts are, so texts need not move to be compared.
    """
    return table(spark, folder, "documents").select("doc_id", _digest().alias("digest"))


def pairs_contains(spark: SparkSession, folder: str) -> DataFrame:
    """Documents paired with the benchmark items they quote, case and outer space aside.

    Items of any length are found in an index of their q-grams; texts are read again
    only beside the pairs found.
    """
    items = table(spark, folder, "benchmark").where(~is_blank(F.col("text")))
    docs = table(spark, folder, "documents")
    quotes = items.select(F.lower(strip(F.col("text"))).alias("pattern"), F.col("item_id").alias("rank"))
    texts = spread(docs.select(F.col("doc_id").alias("id"), F.lower(strip(F.col("text"))).alias("text")), "id")
    met = occurrences(texts, quotes).select(F.col("id").alias("doc_id"), F.col("rank").alias("item_id"))
    truths = items.select("item_id", F.col("text").alias("truth"))
    pairs = small_side(salted_join(met, truths, ["item_id"], ["doc_id"]))
    return docs.select("doc_id", "source", F.col("text").alias("prediction")).join(pairs, "doc_id")


def vector_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector against the first vector of its label."""
    vectors = table(spark, folder, "embeddings")
    first = vectors.groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    refs = vectors.join(first, ["label", "vec_id"]).select(
        "label", F.col("vec_id").alias("ref_id"), F.col("embedding").alias("ref")
    )
    return salted_join(vectors, small_side(refs), ["label"], ["vec_id"])


def math_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Worded numeric answers written from order lines, in seven phrasings."""
    q = F.col("l_quantity").cast("int")
    a = (F.col("l_partkey") % 50).cast("int")
    text = (
        F.when(F.col("l_linenumber") == 1, F.concat(F.lit("답은 "), q, F.lit(" 입니다")))
        .when(F.col("l_linenumber") == 2, F.concat(F.lit("정답: "), q))
        .when(F.col("l_linenumber") == 3, F.concat(F.lit("첫째, 값을 추정\n결과는 "), q, F.lit(",5")))
        .when(
            F.col("l_linenumber") == 4,
            F.concat(F.lit("먼저 "), a, F.lit(" + 1 = "), a + 1, F.lit("\n그 때문에 따라서 "), q),
        )
        .when(F.col("l_linenumber") == 5, F.concat(F.lit("  다음: x = y\n그러므로 "), q, F.lit("\n분명 반드시")))
        .when(
            F.col("l_linenumber") == 6,
            F.concat(q + a, F.lit(" - "), a, F.lit(" = "), q, F.lit("\n마지막으로 확실히 "), q, F.lit("개입니다")),
        )
        .otherwise(F.concat(F.lit("아마 생각에는 "), q, F.lit(" km")))
    )
    truth = (
        F.when(F.col("l_returnflag") == "A", q.cast("string"))
        .when(F.col("l_returnflag") == "N", F.concat(F.lit("합계 "), q, F.lit(",5개")))
        .otherwise(F.concat(F.lit("정답은 "), F.col("l_linenumber") * 5, F.lit("원입니다")))
    )
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_quantity"
    )
    return spread(lines, "l_orderkey").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag",
        text.alias("prediction"), truth.alias("truth"),
    )


def qa_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Worded prose answers written from orders."""
    said = (
        F.when(F.col("o_orderstatus") == "F", "완료된")
        .when(F.col("o_orderstatus") == "O", "진행중인")
        .otherwise("보류된")
    )
    expected = (
        F.when(F.col("o_orderkey") % 3 == 0, "완료된")
        .when(F.col("o_orderkey") % 3 == 1, "진행중인")
        .otherwise("보류된")
    )
    style = F.col("o_custkey") % 6
    prediction = (
        F.when(style == 0, F.concat(F.lit("주문은 "), said, F.lit(" 상태입니다.")))
        .when(style == 1, F.concat(F.lit(" 주문은   "), said, F.lit("\t상태입니다!! ")))
        .when(style == 2, F.concat(F.lit("확실히 주문은 "), said, F.lit(" 상태입니다 그리고 번호는 "), F.col("o_orderkey")))
        .when(style == 3, F.concat(F.lit("아마도 주문은ABC "), said, F.lit(" 상태일 가능성이 높아요 하지만 주문은a상태")))
        .when(style == 4, F.lit("   "))
        .otherwise(F.concat(said, F.lit(" "), said, F.lit(" "), said, F.lit(" ㅋㅋㅋㅋㅋ")))
    )
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return spread(orders, "o_orderkey").select(
        F.col("o_orderkey").alias("request_id"),
        prediction.alias("prediction"),
        F.concat(F.lit("주문은 "), expected, F.lit(" 상태입니다.")).alias("truth"),
    )


def step_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Values reported per (study, trial, step); every fifth trial never completes."""
    return (
        table(spark, folder, "lineitem")
        .groupBy(
            F.col("l_suppkey").alias("study"),
            F.col("l_orderkey").alias("trial"),
            (F.col("l_linenumber") - 1).alias("step"),
        )
        .agg(F.max((F.col("l_extendedprice") % 1000) / 1000).alias("value"))
        .withColumn("complete", F.col("trial") % 5 != 0)
    )
