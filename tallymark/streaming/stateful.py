"""Rules over keyed state that event-time timers close, each as one running stream.

Readings may come in any order within ``late``: what a key has open is kept in map
state, a timer fires once the watermark has passed, and closed entries leave the
state.  A source that ends sends a heartbeat (a row without ``tick_id``) past the
bound, which closes what is still open.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tallymark.operators.telemetry import ScalingPolicy, level_name, scale_steps

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep state on disk, with one column family per variable; timers need that."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class ScalingProcessor(StatefulProcessor):
    """Mean load per tick, closed in order by timers, and a scaling decision with a cooldown for each.

    ``open`` holds sums of the ticks of periods not closed yet; a batch only appends its
    own, and they are added up when a period closes.  A key has one timer, ``due``, for
    the first of its periods; when it fires, all periods that the watermark has passed
    close in order of time and leave the state.  ``last`` is the number of replicas and
    the time of the last change.
    """

    def __init__(self, key: str, policy: ScalingPolicy, every_s: int, close_s: int) -> None:
        self.key, self.policy, self.every_s, self.close_s = key, policy, every_s, close_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "tick bigint, cpu double, n bigint, response double, answered bigint")
        self.due = handle.getValueState("due", "closes bigint")
        self.last = handle.getValueState("last", "replicas int, changed_at double")

    def _closes(self, tick: int) -> int:
        return tick // self.close_s * self.close_s + self.close_s

    def _wait_for(self, closes: int) -> None:
        self.handle.registerTimer(closes * 1000)
        self.due.update((closes,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        ticks: dict[int, list] = {}
        for part in rows:
            part = zip(part["tick_id"].tolist(), part["second"].tolist(), part["cpu_percent"].tolist(), part["response_s"].tolist())
            for tick_id, second, cpu, response in part:
                if tick_id is None or tick_id != tick_id:
                    continue
                own = ticks.setdefault(int(second) // self.every_s * self.every_s, [0.0, 0, 0.0, 0])
                own[1] += 1
                if cpu == cpu:
                    own[0] += cpu
                if response == response:
                    own[2] += response
                    own[3] += 1
        if ticks:
            self.open.appendList([(t, *v) for t, v in ticks.items()])
            first, known = self._closes(min(ticks)), self.due.get()
            if known is None or first < known[0]:
                self._wait_for(first)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) // 1000
        known = self.due.get()
        if known is None or known[0] > passed:  # an earlier timer has closed it
            return
        closed: dict[int, list] = {}
        later = []
        for row in self.open.get():
            if self._closes(row[0]) > passed:
                later.append(tuple(row))
                continue
            own = closed.setdefault(row[0], [0.0, 0, 0.0, 0])
            own[:] = own[0] + row[1], own[1] + row[2], own[2] + row[3], own[3] + row[4]
        if later:
            self.open.put(later)
            self._wait_for(self._closes(min(r[0] for r in later)))
        else:
            self.open.clear()
            self.due.clear()
        rows = [(t, cpu / n / 100, response / answered if answered else float("nan")) for t, (cpu, n, response, answered) in closed.items()]
        replicas, changed_at = self.last.get() or (self.policy.min_replicas, float("-inf"))
        changes, replicas, changed_at = scale_steps(
            pd.DataFrame(rows, columns=["tick", "load", "response_s"]), replicas, changed_at, self.policy
        )
        self.last.update((replicas, changed_at))
        if len(changes):
            changes.insert(0, self.key, key[0])
            yield changes

    def close(self) -> None:
        pass


def scaling_decisions(
    readings: DataFrame, key: str, late: str, policy: ScalingPolicy = ScalingPolicy(), every_s: int = 30, close_s: int = 300
) -> DataFrame:
    """Scaling changes per key, as one stream from readings to decisions.

    A period of ``close_s`` seconds is decided once the watermark, ``late`` behind the
    newest reading, has passed it; readings that come later than that are dropped.  The
    default period is the cooldown, so waiting for it delays no second decision.
    """
    kind = readings.schema[key].dataType.simpleString()
    lean = readings.withWatermark("ts", late).select(
        key, "ts", "tick_id", F.unix_seconds("ts").alias("second"), F.col("cpu_percent").cast("double").alias("cpu_percent"),
        F.col("response_s").cast("double").alias("response_s"),
    )
    return lean.groupBy(key).transformWithStateInPandas(
        ScalingProcessor(key, policy, every_s, close_s), f"{key} {kind}, tick bigint, action string, replicas int", "Append", "EventTime"
    )


class LevelProcessor(StatefulProcessor):
    """Peak utilisation per tick, closed in order by timers; a tick whose level differs from the one before is a change."""

    def __init__(self, key: str, every_s: int) -> None:
        self.key, self.every_s = key, every_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.peaks = handle.getMapState("peaks", "tick bigint", "utilization double")
        self.level = handle.getValueState("level", "level string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        for part in rows:
            part = part[part["tick_id"].notna() & part["utilization"].notna()]
            for tick, peak in part.groupby(part["second"] // self.every_s * self.every_s)["utilization"].max().items():
                known = self.peaks.getValue((int(tick),))
                if known is None:
                    self.handle.registerTimer((int(tick) + self.every_s) * 1000)
                if known is None or peak > known[0]:
                    self.peaks.updateValue((int(tick),), (float(peak),))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        tick = expiredTimerInfo.getExpiryTimeInMs() // 1000 - self.every_s
        known = self.peaks.getValue((tick,))
        if known is None:
            return
        before, now = self.level.get()[0] if self.level.exists() else None, level_name(known[0])
        self.peaks.removeKey((tick,))
        self.level.update((now,))
        if before is not None and before != now:
            yield pd.DataFrame({self.key: [key[0]], "second": [tick], "previous_level": [before], "level": [now]})

    def close(self) -> None:
        pass


def level_changes(readings: DataFrame, key: str, late: str, every_s: int = 3600) -> DataFrame:
    """Ticks at which the level of a key's peak utilisation changed, as one stream; ``second`` is the tick's start."""
    kind = readings.schema[key].dataType.simpleString()
    lean = readings.withWatermark("ts", late).select(key, "ts", "tick_id", F.unix_seconds("ts").alias("second"), "utilization")
    return lean.groupBy(key).transformWithStateInPandas(
        LevelProcessor(key, every_s), f"{key} {kind}, second bigint, previous_level string, level string", "Append", "EventTime"
    )


class NewestProcessor(StatefulProcessor):
    """The newest ``n`` rows of a key in list state; a late row takes the place it has in time, or none."""

    def __init__(self, key: str, order: list[str], values: list[str], types: dict[str, str], n: int) -> None:
        self.key, self.order, self.columns, self.types, self.n = key, order, [*order, *values], types, n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getListState("newest", ", ".join(f"`{c}` {self.types[c]}" for c in self.columns))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        kept = pd.DataFrame(list(self.newest.get()), columns=self.columns)
        before = kept[self.order].itertuples(index=False, name=None)
        told = list(before)
        for part in rows:
            both = pd.concat([kept, part[self.columns]], ignore_index=True) if len(kept) else part[self.columns]
            kept = both.sort_values(self.order, ascending=False, kind="stable", na_position="last").head(self.n)
        if list(kept[self.order].itertuples(index=False, name=None)) == told:
            return
        rows_kept = [tuple(None if pd.isna(x) else x for x in r) for r in kept.astype(object).itertuples(index=False, name=None)]
        self.newest.put(rows_kept)
        kept = kept.reset_index(drop=True)
        kept.insert(0, self.key, key[0])
        kept.insert(1, "rank", range(1, len(kept) + 1))
        yield kept

    def close(self) -> None:
        pass


def newest_rows(readings: DataFrame, key: str, order: list[str], values: list[str], n: int = 1) -> DataFrame:
    """``key, rank, order, values`` of the newest ``n`` rows per key, sent again when they change (update mode).

    ``order`` columns are numbers that tell rows of a key apart, newest last; state
    holds ``n`` rows a key, however many have passed and however late they come.
    """
    types = {f.name: f.dataType.simpleString() for f in readings.schema}
    columns = [key, *order, *values]
    schema = ", ".join([f"`{key}` {types[key]}", "`rank` int", *[f"`{c}` {types[c]}" for c in columns[1:]]])
    return readings.select(*columns).groupBy(key).transformWithStateInPandas(
        NewestProcessor(key, order, values, types, n), schema, "Update", "None"
    )
