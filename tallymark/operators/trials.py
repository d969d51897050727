"""Parameter-trial analytics: grids, clamps, best trials, bins, trends, advice."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.report_walk import with_reports_before
from tallymark.functions.running_median import MAX_GROUP, WINDOW_GROUP, with_median_before
from tallymark.functions.sequence import with_running
from tallymark.operators.joins import salted_join, small_side
from tallymark.operators.samples import seeded_sample
from tallymark.session import ensure_checkpoint_dir, scratch_path

# The default parameter grid.
DEFAULT_GRID: Mapping[str, Sequence[float]] = {
    "temperature": (0.0, 0.1, 0.3, 0.7),
    "top_p": (0.3, 0.7, 0.9),
    "top_k": (10, 30, 50),
    "max_new_tokens": (100, 200, 300),
    "repetition_penalty": (1.0, 1.1),
}

# Parameters used when no trial scores above 0.
DEFAULT_PARAMS: Mapping[str, float] = {
    "temperature": 0.1, "top_p": 0.9, "top_k": 50, "max_new_tokens": 512, "repetition_penalty": 1.0,
}
PARAMS = tuple(DEFAULT_PARAMS)

# Allowed ranges.
RANGES: Mapping[str, tuple[float, float]] = {
    "temperature": (0.0, 2.0),
    "top_p": (0.01, 1.0),
    "top_k": (1, 100),
    "max_new_tokens": (1, 2048),
    "repetition_penalty": (1.0, 2.0),
    "length_penalty": (0.1, 2.0),
    "num_beams": (1, 8),
    "batch_size": (1, 32),
}


def with_grid(df: DataFrame, grid: Mapping[str, Sequence[float]] = DEFAULT_GRID) -> DataFrame:
    """Every row once per parameter combination, numbered in grid order.

    The grid is a handful of literals, so each row expands in place.
    """
    sizes = {name: len(values) for name, values in grid.items()}
    total = 1
    for size in sizes.values():
        total *= size
    out = df.withColumn("combination", F.explode(F.sequence(F.lit(0), F.lit(total - 1))))
    below = total
    for name, values in grid.items():
        below //= sizes[name]
        index = (F.floor(F.col("combination") / below) % sizes[name]).cast("int")
        out = out.withColumn(name, F.get(F.array(*[F.lit(v) for v in values]), index))
    return out


def sample_grid(df: DataFrame, keys: Sequence[str], n: int = 20, seed: int = 42) -> DataFrame:
    """At most ``n`` combinations per group, drawn repeatably."""
    return seeded_sample(df, keys, "combination", n, seed)


def clamp_params(df: DataFrame, columns: Sequence[str] | None = None, min_to_max: bool = False) -> DataFrame:
    """Parameters forced into their ranges, with a flag for changed rows.

    A minimum token count above the maximum becomes 1, or the maximum with
    ``min_to_max``; temperature 0 turns sampling off.
    """
    names = [c for c in (columns or RANGES) if c in df.columns]
    clamped = {c: F.greatest(F.lit(RANGES[c][0]), F.least(F.lit(RANGES[c][1]), F.col(c))).cast(df.schema[c].dataType)
               for c in names}
    changed = [clamped[c] != F.col(c) for c in names]
    extra: dict[str, Column] = {}
    if "min_new_tokens" in df.columns:
        top = clamped.get("max_new_tokens", F.col("max_new_tokens"))
        low = F.col("min_new_tokens")
        kind = df.schema["min_new_tokens"].dataType
        fixed = F.greatest(F.lit(1), F.least(top, low)) if min_to_max else F.when(low > top, 1).otherwise(low)
        extra["min_new_tokens"] = fixed.cast(kind)
        changed.append(extra["min_new_tokens"] != low)
    sampling = F.col("do_sample") if "do_sample" in df.columns else F.lit(True)
    extra["do_sample"] = F.when(clamped["temperature"] == 0, F.lit(False)).otherwise(sampling)
    flag = F.lit(False)
    for c in changed:
        flag = flag | c
    return df.withColumns({**clamped, **extra, "was_changed": flag})


def audit_params(df: DataFrame) -> DataFrame:
    """Names of the parameters out of range per row; only rows with any."""
    checks = [(c, ~F.col(c).between(*RANGES[c])) for c in ("temperature", "top_p", "top_k") if c in df.columns]
    if {"min_new_tokens", "max_new_tokens"} <= set(df.columns):
        checks.append(("min_new_tokens", F.col("min_new_tokens") > F.col("max_new_tokens")))
    found = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks]))
    return df.withColumn("violations", found).where(F.size("violations") > 0)


def trial_scores(
    df: DataFrame, keys: Sequence[str], score: str = "score", failed: str = "failed", failed_as_zero: bool = True
) -> DataFrame:
    """Mean sample score per trial; invalid scores are null.

    A trial whose every sample failed scores 0, or null with
    ``failed_as_zero=False``.
    """
    value = F.col(score).try_cast("double")
    valid = F.when((value >= 0) & ~F.isnan(value) & ~F.col(failed), value)
    empty = F.lit(0.0) if failed_as_zero else F.lit(None).cast("double")
    out = df.groupBy(*keys).agg(
        F.avg(valid).alias("_mean"),
        F.count(F.lit(1)).alias("samples"),
        F.count_if(F.col(failed)).alias("failures"),
    )
    return out.withColumn(
        "score", F.when(F.col("failures") == F.col("samples"), empty).otherwise(F.col("_mean"))
    ).drop("_mean")


def completed_score(df: DataFrame, score: str = "score") -> Column:
    """A trial's score; null unless it completed, and where it is no number."""
    valid = ~F.isnan(F.col(score).cast("double"))
    if "state" in df.columns:
        valid &= F.col("state") == "complete"
    return F.when(valid, F.col(score))


def best_trial(df: DataFrame, keys: Sequence[str], order: str = "trial") -> DataFrame:
    """First completed trial with the highest score above 0, else the defaults with 0.

    Failed and pruned trials count as trials but never win; without a ``state``
    column every trial counts as completed.
    """
    df = df.withColumn("score", completed_score(df))
    hit = F.col("score") > 0
    params = F.struct(*PARAMS)
    best = F.min_by(params, F.when(hit, F.struct(-F.col("score"), F.col(order))))
    out = df.groupBy(*keys).agg(
        best.alias("_p"),
        F.coalesce(F.max(F.when(hit, F.col("score"))), F.lit(0.0)).alias("best_score"),
        F.count(F.lit(1)).alias("trials"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )
    kinds = {f.name: f.dataType for f in df.schema}
    chosen = [F.coalesce(F.col(f"_p.{p}"), F.lit(DEFAULT_PARAMS[p]).cast(kinds[p])).alias(p) for p in PARAMS]
    return out.select(*keys, *chosen, "best_score", "trials", "first_ts", "last_ts")


def running_best(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Best score of completed trials so far (never below 0) and trial number from 0."""
    out = with_running(df, keys, order, {"_best": ("max", completed_score(df)), "_n": ("sum", F.lit(1))}, lean=True)
    return out.withColumns(
        {"best_so_far": F.greatest(F.col("_best"), F.lit(0.0)), "trial_number": F.col("_n") - 1}
    ).drop("_best", "_n")


def median_rule(
    reports: DataFrame,
    study: str = "study",
    trial: str = "trial",
    step: str = "step",
    startup_trials: int = 3,
    warmup_steps: int = 2,
    max_group: int = MAX_GROUP,
    slices: int | None = None,
    window_group: int = WINDOW_GROUP,
) -> DataFrame:
    """Which reports the median rule would have stopped.

    A report (study, trial, step, value, complete) is stopped when the best
    value of its trial so far is below the median that earlier completed trials
    of the study reported at the same step, once ``startup_trials`` of them have
    completed and ``warmup_steps`` steps have passed.  Studies up to ``max_group``
    reports, the usual ones, are walked whole by one task; larger ones are cut.  A
    report without study, trial or step is not judged.
    """
    # written once: read for the sizes of studies and for the walk
    kind, path = reports.schema["value"].dataType, scratch_path(reports.sparkSession, "reports")
    reports = reports.select(study, trial, step, F.col("value").cast("double").alias("value"), "complete")
    reports.where(F.col(study).isNotNull()).write.parquet(path)
    reports = reports.sparkSession.read.schema(reports.schema).parquet(path)
    sizes = reports.groupBy(study).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max_group)
    large = small_side(sizes.select(study))
    if large.isEmpty():
        told = with_reports_before(reports, study, trial, step)
    else:
        usual = with_reports_before(reports.join(large, study, "left_anti"), study, trial, step)
        rest = reports.join(large, study, "left_semi")
        told = usual.unionByName(_large_studies(rest, study, trial, step, max_group, slices, window_group))
    stop = (
        (F.col("completed_before") >= startup_trials)
        & (F.col(step) >= warmup_steps)
        & (F.col("best_so_far") < F.col("median_before"))
    )
    judged = told.withColumn("stop", F.coalesce(stop, F.lit(False)))
    return judged.withColumns({c: F.col(c).cast(kind) for c in ("value", "best_so_far")})


def _large_studies(
    reports: DataFrame, study: str, trial: str, step: str, max_group: int, slices: int | None, window_group: int
) -> DataFrame:
    """What ``with_reports_before`` gives, for studies that no single task should walk."""
    # read by five steps below: stored once instead of worked out five times
    ensure_checkpoint_dir(reports.sparkSession)
    reports = reports.checkpoint()
    best = with_running(reports, [study, trial], [step], {"best_so_far": ("max", F.col("value"))}, slices)
    medians = with_median_before(reports, [study, step], trial, "value", "complete", max_group, slices, window_group)
    # completed trials before each trial: one row per trial
    trials = reports.groupBy(study, trial).agg(F.bool_and("complete").alias("_done"))
    done = F.col("_done").cast("long")
    before = with_running(trials, [study], [trial], {"_upto": ("sum", done)}, slices).select(
        study, trial, (F.col("_upto") - done).alias("completed_before")
    )
    report = [study, trial, step]
    known = salted_join(reports.select(*report), before, [study, trial], [step])
    return known.join(best.drop("complete"), report).join(medians, report)


def _tenths(value: Column, per_unit: int) -> Column:
    return F.floor(value * per_unit + 0.5) / per_unit


BINS = {
    "temperature": lambda v: _tenths(v, 10),
    "top_p": lambda v: _tenths(v, 10),
    "top_k": lambda v: (F.floor(v / 10) * 10).cast("double"),
    "max_new_tokens": lambda v: (F.floor(v / 100) * 100).cast("double"),
    "repetition_penalty": lambda v: _tenths(v, 100),
}


def parameter_bins(df: DataFrame, keys: Sequence[str] = (), score: str = "score") -> DataFrame:
    """Mean score and size per (parameter, bin); missing values count as 0."""
    pairs = [
        F.struct(
            F.lit(name).alias("parameter"),
            binned(F.coalesce(F.col(name).cast("double"), F.lit(0.0))).alias("bin"),
        )
        for name, binned in BINS.items()
    ]
    value = F.coalesce(F.col(score), F.lit(0.0)).alias("_s")
    long = df.select(*keys, F.explode(F.array(*pairs)).alias("_b"), value)
    return long.groupBy(*keys, "_b.parameter", "_b.bin").agg(
        F.avg("_s").alias("performance"), F.count(F.lit(1)).alias("sample_count")
    )


def best_bins(bins: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Bin with the highest mean score per parameter; ties go to the smallest."""
    rank = F.struct(-F.round("performance", 9), F.col("bin"))
    best = bins.groupBy(*keys, "parameter").agg(F.min_by(F.struct("bin", "performance", "sample_count"), rank).alias("_b"))
    return best.select(*keys, "parameter", F.col("_b.bin").alias("value"), "_b.performance", "_b.sample_count")


def score_trend(df: DataFrame, keys: Sequence[str], order: Sequence[str], score: str = "best_score") -> DataFrame:
    """First against last score by time, extremes, mean and population variance."""
    at = F.struct(*order)
    df = df.withColumn(score, F.when(~F.isnan(F.col(score).cast("double")), F.col(score)))
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_experiments"),
        F.min_by(score, at).alias("_first"),
        F.max_by(score, at).alias("_last"),
        F.max(score).alias("top_score"),
        F.min(score).alias("worst_score"),
        F.avg(score).alias("average_score"),
        F.var_pop(score).alias("score_variance"),
    )
    gain = F.col("_last") - F.col("_first")
    return out.withColumns(
        {
            "score_trend": F.when(gain > 0, "improving").otherwise("declining"),
            "improvement_rate": F.when(F.col("total_experiments") > 1, gain / F.col("total_experiments")).otherwise(0.0),
        }
    ).drop("_first", "_last")


def study_summary(df: DataFrame, keys: Sequence[str], order: str = "trial") -> DataFrame:
    """Trial counts by state, best value and success rate per study."""
    done = F.col("state") == "complete"
    n = F.count(F.lit(1))
    df = df.withColumn("score", completed_score(df))
    best = F.when(F.col("score").isNotNull(), F.struct(-F.col("score"), F.col(order)))
    return df.groupBy(*keys).agg(
        n.alias("n_trials"),
        F.count_if(done).alias("successful_trials"),
        F.count_if(F.col("state") == "pruned").alias("pruned_trials"),
        F.count_if(F.col("state") == "failed").alias("failed_trials"),
        F.max("score").alias("best_value"),
        F.min_by(F.col(order), best).alias("best_trial"),
        (F.count_if(done) / n).alias("success_rate"),
    )


# Advice codes with their texts; the texts are fixed values, figures go where the braces are.
ADVICE = {
    "low_temperature": "매우 낮은 temperature로 일관성이 높지만 창의성이 제한될 수 있습니다.",
    "high_temperature": "높은 temperature로 창의적이지만 일관성이 떨어질 수 있습니다.",
    "low_top_p": "낮은 top_p로 보수적인 토큰 선택을 합니다.",
    "high_memory": "메모리 사용량이 높습니다. 배치 크기를 줄이거나 양자화를 고려하세요.",
    "high_cpu": "CPU 사용률이 높습니다. 동시 처리 수를 줄여보세요.",
    "low_success": "Trial 성공률이 낮습니다 ({success_rate}). 메모리나 시간 제한을 확인하세요.",
    "high_utilization": "{device} 사용률이 높습니다 ({utilization}). 배치 크기를 줄이거나 양자화를 고려하세요.",
    "low_score": "전체 성능이 낮습니다. 모델 크기를 늘리거나 다른 모델을 고려하세요.",
    "high_score": "매우 좋은 성능입니다. 이 설정을 프로덕션에 적용하는 것을 권장합니다.",
}


def recommendations(df: DataFrame, memory_limit: float = 80.0) -> DataFrame:
    """Advice codes per run from whichever of the columns are present."""
    has = set(df.columns)
    rules: list[tuple[str, str, Column]] = [
        ("temperature", "low_temperature", F.col("temperature") < 0.1),
        ("temperature", "high_temperature", F.col("temperature") > 0.8),
        ("top_p", "low_top_p", F.col("top_p") < 0.3),
        ("memory_peak", "high_memory", F.col("memory_peak") > memory_limit),
        ("cpu_peak", "high_cpu", F.col("cpu_peak") > 90),
        ("success_rate", "low_success", F.col("success_rate") < 0.5),
        ("utilization", "high_utilization", F.col("utilization") > 0.9),
        ("best_score", "low_score", F.col("best_score") < 0.7),
        ("best_score", "high_score", F.col("best_score") > 0.9),
    ]
    codes = [F.when(test, F.lit(code)) for column, code, test in rules if column in has]
    return df.withColumn("advice", F.array_compact(F.array(*codes)))


def percent(share: Column) -> Column:
    """A share as a percentage with one place; an exact half is rounded up."""
    return F.format_string("%.1f%%", share * 100 + 1e-9)


def advice_texts(codes: Column, figures: Mapping[str, Column] | None = None) -> Column:
    """Texts of an array of advice codes, with the run's figures (success_rate, utilization, device) put in.

    A figure that is not given, or null, is said by its name.
    """
    lookup = F.create_map(*[F.lit(x) for pair in ADVICE.items() for x in pair])
    given = {name: F.coalesce((figures or {}).get(name, F.lit(None).cast("string")), F.lit(name)) for name in ("success_rate", "utilization", "device")}

    def told(code: Column) -> Column:
        text = F.try_element_at(lookup, code)
        for name, value in given.items():
            text = F.replace(text, F.lit("{" + name + "}"), value)
        return text

    return F.transform(codes, told)
