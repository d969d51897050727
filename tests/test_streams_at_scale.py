"""What streams ask of state and files does not grow with ticks, keys or rows of a batch."""

import datetime as dt
from unittest.mock import MagicMock

import pandas as pd
from pyspark.sql import functions as F

from tallymark.operators import telemetry
from tallymark.operators.telemetry import ScalingPolicy
from tallymark.plans import telemetry_queries as tq
from tallymark.sources import views
from tallymark.streaming import scaling, stateful
from tallymark.streaming import telemetry as st

START = dt.datetime(2024, 1, 1)
SCHEMA = "deployment long, tick_id long, ts timestamp, cpu_percent double, response_s double"


def test_a_batch_of_ticks_costs_a_key_one_timer_and_one_append():
    handle = MagicMock()
    states = {"open": MagicMock(), "due": MagicMock(), "last": MagicMock()}
    handle.getListState.side_effect = handle.getValueState.side_effect = handle.getMapState.side_effect = lambda name, _: states[name]
    states["due"].get.return_value = states["open"].getValue.return_value = None
    processor = stateful.ScalingProcessor("deployment", ScalingPolicy(), 30, 300)
    processor.init(handle)
    rows = pd.DataFrame({"tick_id": range(500), "second": [i * 400 for i in range(500)], "cpu_percent": 50.0, "response_s": 1.0})
    list(processor.handleInputRows((1,), iter([rows]), None))
    assert handle.registerTimer.call_count == 1
    assert len(states["open"].method_calls) == 1 and len(states["open"].appendList.call_args.args[0]) == 500


def readings(spark, folder, files=4):
    rows = [(None if k == 3 else k, k * 1000 + i, START + dt.timedelta(seconds=13 * i), [95.0, 10.0][(i // 40 + k) % 2], None if i % 5 == 0 else 0.4)
            for k in range(4) for i in range(200)]
    rows += [(1, 7777, None, 50.0, 1.0), (None, None, None, None, None)]
    data = spark.createDataFrame(rows, SCHEMA)
    for part in range(files):
        data.where(F.pmod(F.hash("tick_id"), F.lit(files)) == part).coalesce(1).write.mode("append").parquet(str(folder))
    return rows, spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_newest_rows_over_batches_are_those_of_all_rows(spark, tmp_path):
    rows, stream = readings(spark, tmp_path / "in")
    told = stream.withColumn("us", F.unix_micros("ts"))
    out = st.run_newest(spark, told, "deployment", ["us", "tick_id"], ["cpu_percent"], 7, "newest")
    got = {}
    for r in out.orderBy("rank").collect():
        got.setdefault(r.deployment, []).append(r.tick_id)
    want = {}
    for key, tick_id, ts, _, _ in sorted(rows, key=lambda r: (r[2] or dt.datetime.min, r[1] or -1), reverse=True):
        want.setdefault(key, []).append(tick_id)
    assert got == {k: v[:7] for k, v in want.items()}


def test_scaling_over_batches_keeps_no_state_of_ticks(spark, tmp_path, monkeypatch):
    rows, stream = readings(spark, tmp_path / "in")
    monkeypatch.setattr(st, "upsert_to", lambda *_: (_ for _ in ()).throw(AssertionError("a tick is kept as state")))
    data = spark.createDataFrame(rows, SCHEMA)
    want = telemetry.scaling_decisions(telemetry.scaling_ticks(data, ["deployment"]).where("deployment IS NOT NULL AND tick IS NOT NULL"), "deployment")
    got = scaling.run_scaling(spark, stream.where("deployment IS NOT NULL"), "deployment")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 5


def test_unsorted_files_feed_every_core_in_eight_batches(spark, data):
    folder, _ = tq.unsorted_events(spark, data, "unsorted-test")
    stored = spark.read.parquet(folder)
    files = stored.select(F.input_file_name()).distinct().count()
    assert files == 8 * spark.sparkContext.defaultParallelism
    assert stored.count() == views.table(spark, data, "events").count()
