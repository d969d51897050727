"""What each report of a trial knows of earlier ones, for studies that fit one task.

A study's reports are put in the order of trials and steps and walked once: best
value of the trial so far, completed trials before it, and the median that earlier
completed trials reported at the same step.
"""

from __future__ import annotations

import math
from bisect import insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _plain(column: pa.Array) -> list:
    number = pa.types.is_integer(column.type) or pa.types.is_floating(column.type) or pa.types.is_boolean(column.type)
    return column.to_numpy(zero_copy_only=False).tolist() if number and not column.null_count else column.to_pylist()


class _Step:
    """Values reported at one step: numbers in order, NaN after all of them, and how many reports there were."""

    __slots__ = ("near", "nans", "n")

    def __init__(self) -> None:
        self.near, self.nans, self.n = [], 0, 0

    def add(self, value: float | None) -> None:
        self.n += 1
        if value is None:
            return
        if value != value:
            self.nans += 1
        else:
            insort(self.near, value)

    def median(self) -> float | None:
        near, n = self.near, len(self.near) + self.nans
        if not n:
            return None
        low, high = (n - 1) // 2, n // 2
        if high >= len(near):
            return math.nan
        return near[low] if low == high or near[low] == near[high] else 0.5 * near[low] + 0.5 * near[high]


def with_reports_before(reports: DataFrame, study: str, trial: str, step: str) -> DataFrame:
    """``study, trial, step, completed_before, value, best_so_far, n_before, median_before`` of each report.

    ``reports`` has ``value`` (double) and ``complete`` too, and a (study, trial, step)
    once.  A null trial or step comes first and counts as an earlier one; such reports
    are not returned.  A trial is completed if its reports say so and none says
    otherwise; ``completed_before`` of a trial that says nothing is null.
    """
    kinds = {f.name: f.dataType.simpleString() for f in reports.schema.fields}

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now_study = now_trial = object()
        steps: dict[object, _Step] = {}
        completed, last, best = 0, False, None
        for batch in batches:
            before, bests, counts, medians = [], [], [], []
            for s, t, p, v, c, done in zip(*(_plain(batch.column(k)) for k in range(6))):
                if s != now_study:
                    now_study, now_trial, steps, completed, last = s, object(), {}, 0, False
                if t != now_trial:
                    completed += bool(last)
                    now_trial, best, last = t, None, done
                if v is not None and (best is None or v > best or v != v):  # NaN is above all numbers
                    best = v
                seen = steps.get(p)
                if seen is None:
                    seen = steps[p] = _Step()
                before.append(None if done is None else completed)
                bests.append(best)
                counts.append(seen.n)
                medians.append(seen.median())
                if c:
                    seen.add(v)
            columns = [
                *[batch.column(k) for k in range(3)], pa.array(before, pa.int64()), batch.column(3),
                pa.array(bests, pa.float64()), pa.array(counts, pa.int64()), pa.array(medians, pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = [study, trial, step, "completed_before", "value", "best_so_far", "n_before", "median_before"]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (study, trial, step))
    schema += ", completed_before bigint, value double, best_so_far double, n_before bigint, median_before double"
    whole = Window.partitionBy(study, trial).orderBy(step).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = reports.select(study, trial, step, "value", "complete").repartition(study)
    ordered = own.withColumn("_done", F.bool_and("complete").over(whole)).sortWithinPartitions(study, trial, step)
    return ordered.mapInArrow(walk, schema).where(F.col(trial).isNotNull() & F.col(step).isNotNull())
