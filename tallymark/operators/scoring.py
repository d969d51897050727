"""Scoring jobs over prediction tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions import text as tx
from tallymark.functions.matching import letters_bound, matching_ratio
from tallymark.operators.joins import null_safe_join, small_side

CORRECT_ABOVE = 0.8
QA_CORRECT_ABOVE = 0.7
_CACHE_ENTRIES = 10_000


def _matcher(measure: Callable[[str, str], object]) -> Callable[[str | None, str | None], object]:
    """``measure`` on lower-cased texts, remembering a fixed number of pairs."""
    known: dict[bytes, object] = {}

    def run(a: str | None, b: str | None) -> object:
        if a is None or b is None:
            return None
        a, b = a.lower(), b.lower()
        digest = hashlib.blake2b(f"{len(a)}:{a}{b}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
        if digest not in known:
            if len(known) >= _CACHE_ENTRIES:
                known.clear()
            known[digest] = measure(a, b)
        return known[digest]

    return run


def _ratio(a: str, b: str) -> float:
    return 1.0 if a == b else matching_ratio(a, b)


@F.pandas_udf(T.DoubleType())
def sequence_similarity(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratio of matching blocks of two lower-cased texts, null for null text.

    Rows are scored where they lie; copies of a pair are scored once per task
    (up to a fixed number of remembered pairs), so nothing is shuffled.
    """
    ratio = _matcher(_ratio)
    for predictions, truths in batches:
        yield pd.Series([ratio(a, b) for a, b in zip(predictions, truths)], dtype="float64")


def _passes(threshold: float) -> Callable:
    """Whether the ratio passes; letter counts alone rule most pairs out."""

    def test(a: str, b: str) -> bool:
        return a == b or (letters_bound(a, b) > threshold and matching_ratio(a, b) > threshold)

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        passes = _matcher(test)
        for predictions, truths in batches:
            yield pd.Series([passes(a, b) for a, b in zip(predictions, truths)], dtype="boolean")

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, T.BooleanType())


def similarity(prediction: Column, truth: Column, blank_is_zero: bool = False) -> Column:
    """Similarity score; blank text scores 0 where asked."""
    score = sequence_similarity(prediction, truth)
    if not blank_is_zero:
        return score
    return F.when(tx.is_blank(prediction) | tx.is_blank(truth), 0.0).otherwise(score)


def similar_enough(prediction: Column, truth: Column, threshold: float = CORRECT_ABOVE) -> Column:
    """Whether the similarity passes the threshold.

    Pairs whose lengths alone rule it out never reach Python.
    """
    possible = tx.similarity_bound(prediction, truth) > threshold
    passes = _passes(threshold)(F.when(possible, prediction), F.when(possible, truth))
    return F.coalesce(passes, F.lit(False))


def _result(score: Column, correct: Column, confidence: Column) -> Column:
    return F.struct(score.alias("score"), correct.alias("correct"), confidence.alias("confidence"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a costly value that is worked out a single time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _math_parts(p: Column, t: Column) -> dict[str, Column]:
    return {"extracted_pred": tx.numeric_answer(p), "extracted_gt": tx.numeric_answer(t), "reasoning_steps": tx.reasoning_steps(p)}


def _math(p: Column, t: Column, row: dict[str, Column]) -> Column:
    known = _math_parts(p, t) | row
    correct = tx.numbers_agree(known["extracted_pred"], known["extracted_gt"])
    return _once(correct, lambda c: _result(c.cast("double"), c, tx.math_confidence(p)))


def _qa(p: Column, t: Column, row: dict[str, Column]) -> Column:
    score = tx.qa_composite(tx.normalized_match(p, t), row.get("semantic", F.lit(0.0)), tx.keyword_recall(p, t))
    return _once(score, lambda s: _result(s, s > QA_CORRECT_ABOVE, tx.qa_confidence(p)))


def _basic(p: Column, t: Column, row: dict[str, Column]) -> Column:
    score = row["similarity"]
    return _result(score, score > CORRECT_ABOVE, score)


def _performance(p: Column, t: Column, row: dict[str, Column]) -> Column:
    speed = F.lit(1.0)
    if "tokens_per_second" in row:
        speed = tx.performance_score(row["tokens_per_second"], row["memory_usage_mb"])
    score = tx.performance_composite(row["similarity"], speed)
    return _result(score, row["similarity"] > CORRECT_ABOVE, F.lit(None).cast("double"))


EVALUATORS: dict[str, Callable[[Column, Column, dict[str, Column]], Column]] = {
    "korean_math": _math,
    "korean_qa": _qa,
    "performance": _performance,
    "basic": _basic,
}
NEED_SIMILARITY = {"performance", "basic"}


def register_evaluator(
    name: str, build: Callable[[Column, Column, dict[str, Column]], Column], needs_similarity: bool = False
) -> None:
    """Add an evaluator: a function of (prediction, truth, row columns).

    It returns a struct of score, correct and confidence.  Its rows meet Python
    only if it asks for ``row["similarity"]``.
    """
    EVALUATORS[name] = build
    NEED_SIMILARITY.discard(name)
    if needs_similarity:
        NEED_SIMILARITY.add(name)


#: Evaluators in Python: a function of (prediction, truth, row as a dict) each.
ROW_EVALUATORS: dict[str, Callable[[str, str, dict], dict]] = {}
_SCORED = pa.struct([
    ("score", pa.float64()), ("correct", pa.bool_()), ("confidence", pa.float64()),
    ("details", pa.map_(pa.string(), pa.string())), ("error", pa.string()),
])


def register_row_evaluator(name: str, score_row: Callable[[str, str, dict], dict]) -> None:
    """Add an evaluator that is a Python function of one row.

    It returns a dict with ``score`` and, if it likes, ``correct``, ``confidence`` and
    ``details`` (a dict).  What it raises costs its own row only: that row scores 0
    and carries the message.
    """
    ROW_EVALUATORS[name] = score_row


def unregister_evaluator(name: str) -> None:
    """Forget an evaluator added before."""
    ROW_EVALUATORS.pop(name, None)
    EVALUATORS.pop(name, None)
    NEED_SIMILARITY.discard(name)


def _guarded(score_row: Callable[[str, str, dict], dict]) -> Callable[[Column], Column]:
    """``score_row`` over Arrow batches of rows, an exception kept to its row."""

    @F.arrow_udf("struct<score: double, correct: boolean, confidence: double, details: map<string, string>, error: string>")
    def run(rows: pa.Array) -> pa.Array:
        out = []
        for row in rows.to_pylist():
            try:
                told = score_row(row["prediction"], row["truth"], row)
                details = [(str(k), None if v is None else str(v)) for k, v in (told.get("details") or {}).items()]
                confidence = told.get("confidence")
                out.append({
                    "score": float(told["score"]), "correct": bool(told.get("correct", False)),
                    "confidence": None if confidence is None else float(confidence), "details": details, "error": None,
                })
            except Exception as wrong:  # one bad row must not end the job
                message = str(wrong) or type(wrong).__name__
                out.append({"score": 0.0, "correct": False, "confidence": None, "details": [("error", message)], "error": message})
        return pa.array(out, _SCORED)

    return run


def _map(values: dict[str, Column]) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])


def _math_details(p: Column, t: Column, row: dict[str, Column]) -> dict[str, Column]:
    known = _math_parts(p, t) | row
    return {
        "extracted_pred": known["extracted_pred"], "extracted_gt": known["extracted_gt"],
        "reasoning_quality": tx.reasoning_quality(known["reasoning_steps"]), "language": F.lit("korean"),
    }


def _qa_details(p: Column, t: Column, row: dict[str, Column]) -> dict[str, Column]:
    return {
        "exact_score": tx.normalized_match(p, t), "semantic_score": row.get("semantic", F.lit(0.0)),
        "keyword_score": tx.keyword_recall(p, t), "completeness": tx.completeness(p), "fluency": tx.fluency(p),
    }


#: What an evaluator looked at, by name; the others have none.
DETAILS: dict[str, Callable[[Column, Column, dict[str, Column]], dict[str, Column]]] = {
    "korean_math": _math_details, "korean_qa": _qa_details,
}

#: What an evaluator uses more than once; it is worked out once a row.
PARTS: dict[str, Callable[[Column, Column], dict[str, Column]]] = {"korean_math": _math_parts}


def with_details(df: DataFrame, evaluator: str) -> DataFrame:
    """Rows scored by one native evaluator, with its details as typed columns beside score, correct and confidence.

    The math evaluator's reasoning steps come as an array.  Rows without text score 0
    and say so in ``error``; their details are null.
    """
    p, t = F.col("prediction"), F.col("truth")
    row = {"semantic": F.col("semantic")} if "semantic" in df.columns else {}
    missing = p.isNull() | t.isNull()
    columns = df.columns
    parts = PARTS[evaluator](p, t) if evaluator in PARTS else {}
    if parts:
        # a generator works the struct out once, however often its fields are used
        df = df.select(*columns, F.inline(F.array(F.struct(*[v.alias(f"_part_{k}") for k, v in parts.items()]))))
        row |= {k: F.col(f"_part_{k}") for k in parts}
    details = DETAILS[evaluator](p, t, row) if evaluator in DETAILS else {}
    if evaluator == "korean_math":
        details["reasoning_steps"] = row["reasoning_steps"]
    result = F.when(missing, _result(F.lit(0.0), F.lit(False), F.lit(None).cast("double"))).otherwise(EVALUATORS[evaluator](p, t, row))
    scored = df.select("*", F.inline(F.array(F.struct(result.alias("_result")))))
    return scored.select(
        *columns, "_result.*", F.when(missing, F.lit("missing text")).alias("error"),
        *[F.when(~missing, v).alias(k) for k, v in details.items()],
    )


def with_details_by_text(df: DataFrame, evaluator: str) -> DataFrame:
    """``with_details`` worked out once for each pair of texts, for tables whose texts repeat.

    The distinct pairs are scored and meet all rows again by both texts: by broadcast
    if they are few, else by a shuffle.
    """
    texts = ["prediction", "truth"]
    return null_safe_join(df, small_side(with_details(df.select(*texts).distinct(), evaluator)), texts)


def evaluate(df: DataFrame, evaluator: str = "evaluator", use_stats: bool = True, details: bool = False) -> DataFrame:
    """Score each row by the evaluator its column names.

    Unknown names fall back to ``basic``.  A row without text scores 0 and says
    so in ``error``, and so does a row on which its Python evaluator fails.  Rows are
    parted by what their evaluator needs, so only those that need the similarity or a
    Python evaluator are sent to Python.
    With ``use_stats`` the performance evaluator reads tokens_per_second and
    memory_usage_mb; without it their factor is 1.  With ``details`` a map says
    what the evaluator looked at.
    """
    known = [*EVALUATORS, *ROW_EVALUATORS]
    name = F.coalesce(F.when(F.col(evaluator).isin(*known), F.col(evaluator)), F.lit("basic"))
    compared = name.isin(*NEED_SIMILARITY)
    native = [n for n in EVALUATORS if n not in NEED_SIMILARITY]
    similarity_of = sequence_similarity(F.col("prediction"), F.col("truth"))
    with_python = _evaluated(df.where(compared).withColumn("_similarity", similarity_of), name, NEED_SIMILARITY, use_stats, details)
    out = _evaluated(df.where(name.isin(*native)), name, native, use_stats, details).unionByName(with_python)
    for own, score_row in ROW_EVALUATORS.items():
        out = out.unionByName(_row_evaluated(df.where(name == own), own, score_row, details))
    return out


def _row_evaluated(df: DataFrame, name: str, score_row: Callable[[str, str, dict], dict], details: bool) -> DataFrame:
    """Rows of one Python evaluator; those without text never reach it."""
    missing = F.col("prediction").isNull() | F.col("truth").isNull()
    nothing = F.from_json(F.lit('{"score": 0, "correct": false, "error": "missing text"}'),
                          "score double, correct boolean, confidence double, details map<string, string>, error string")
    with_text = df.where(~missing).withColumn("_result", _guarded(score_row)(F.struct(*df.columns)))
    scored = with_text.unionByName(df.where(missing).withColumn("_result", nothing))
    told = ["error", "score", "correct", "confidence"] + ["details"] * details
    return scored.select(*df.columns, F.lit(name).alias("used"), *[F.col(f"_result.{c}").alias(c) for c in told])


def _evaluated(df: DataFrame, name: Column, evaluators: Iterable[str], use_stats: bool, details: bool = False) -> DataFrame:
    """Rows whose evaluator is one of ``evaluators``, scored."""
    p, t = F.col("prediction"), F.col("truth")
    row = {"similarity": F.col("_similarity")} if "_similarity" in df.columns else {}
    if use_stats and {"tokens_per_second", "memory_usage_mb"} <= set(df.columns):
        row |= {c: F.col(c) for c in ("tokens_per_second", "memory_usage_mb")}
    if "semantic" in df.columns:
        row["semantic"] = F.col("semantic")
    missing = p.isNull() | t.isNull()
    nothing = _result(F.lit(0.0), F.lit(False), F.lit(None).cast("double"))
    result = F.when(missing, nothing)
    for key in evaluators:
        result = result.when(name == key, EVALUATORS[key](p, t, row))
    kept = [c for c in df.columns if c != "_similarity"]
    # a generator works the struct out once, however many of its fields are used
    told = F.when(missing, F.create_map().cast("map<string,string>"))
    for key in evaluators:
        if key in DETAILS:
            told = told.when(name == key, _map(DETAILS[key](p, t, row)))
    more = [told.otherwise(F.create_map().cast("map<string,string>")).alias("details")] if details else []
    return df.select(
        *kept, name.alias("used"), F.when(missing, F.lit("missing text")).alias("error"), F.inline(F.array(result)), *more
    )
