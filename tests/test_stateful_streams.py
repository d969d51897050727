"""Streams with timers and keyed state: restarts, late readings, state that leaves."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallymark.operators import telemetry
from tallymark.streaming import stateful, telemetry as st

START = dt.datetime(2024, 1, 1)
SCHEMA = "deployment long, tick_id long, ts timestamp, cpu_percent double, memory_percent double, utilization double, response_s double"


def readings():
    rows = []
    for key in range(3):
        for i in range(240):
            cpu = 95.0 if (i // 40 + key) % 3 else 10.0
            rows.append((key, key * 1000 + i, START + dt.timedelta(seconds=20 * i), cpu, float(i), (i * 7 + key) % 100 / 100, 0.5))
    return rows


@pytest.fixture
def folder(spark, tmp_path):
    """Three files in no order of time; ``heartbeat`` adds the row that ends the source."""
    data = spark.createDataFrame(readings(), SCHEMA)
    for part in range(3):
        data.where(F.pmod(F.hash("tick_id"), F.lit(3)) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield tmp_path
    spark.conf.set("spark.sql.shuffle.partitions", before)


def heartbeat(spark, folder):
    row = (None, None, START + dt.timedelta(days=30), None, None, None, None)
    spark.createDataFrame([row], SCHEMA).write.mode("append").parquet(str(folder / "in"))


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))


def test_scaling_goes_on_from_its_checkpoint_and_closes_every_tick(spark, folder):
    ticks = telemetry.scaling_ticks(spark.createDataFrame(readings(), SCHEMA), ["deployment"])
    want = sorted(map(tuple, telemetry.scaling_decisions(ticks, "deployment").collect()))
    out, state = str(folder / "out"), str(folder / "state")
    with stateful.state_in_rocksdb(spark):
        st.append_to(stateful.scaling_decisions(stream(spark, folder), "deployment", "10 days"), out, state)
        assert spark.read.schema("deployment long, tick long, action string, replicas int").parquet(out).count() == 0  # nothing is closed yet
        heartbeat(spark, folder)
        st.append_to(stateful.scaling_decisions(stream(spark, folder), "deployment", "10 days"), out, state)
    got = sorted(map(tuple, spark.read.parquet(out).select("deployment", "tick", "action", "replicas").collect()))
    assert got == want and len(want) > 10


def test_readings_past_the_bound_change_nothing(spark, folder):
    heartbeat(spark, folder)
    out, state = str(folder / "out"), str(folder / "state")
    with stateful.state_in_rocksdb(spark):
        st.append_to(stateful.level_changes(stream(spark, folder), "deployment", "10 days", 60), out, state)
        before = spark.read.parquet(out).count()
        late = (0, 5000, START, 99.0, 1.0, 0.99, 9.0)
        spark.createDataFrame([late], SCHEMA).write.mode("append").parquet(str(folder / "in"))
        st.append_to(stateful.level_changes(stream(spark, folder), "deployment", "10 days", 60), out, state)
    assert before > 0 and spark.read.parquet(out).count() == before


@pytest.mark.parametrize("slices", [1, 7])
def test_level_changes_do_not_depend_on_slices(spark, slices):
    rows = readings()
    peaks = {}
    for key, _, ts, _, _, use, _ in rows:
        minute = ts.replace(second=0)
        peaks[key, minute] = max(peaks.get((key, minute), 0.0), use)
    want = []
    for key in range(3):
        own = sorted((t, telemetry.level_name(u)) for (k, t), u in peaks.items() if k == key)
        want += [(key, b[0], a[1], b[1]) for a, b in zip(own, own[1:]) if a[1] != b[1]]
    out = telemetry.level_changes(spark.createDataFrame(rows, SCHEMA), ["deployment"], F.date_trunc("minute", "ts"), slices)
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)


def test_newest_rows_are_right_when_readings_are_late(spark, folder):
    told = stream(spark, folder).withColumn("us", F.unix_micros("ts"))
    with stateful.state_in_rocksdb(spark):
        out = st.run_upsert(spark, stateful.newest_rows(told, "deployment", ["us", "tick_id"], ["cpu_percent"], 5), "newest", ["deployment", "rank"])
    want = [(key, n + 1, key * 1000 + 239 - n) for key in range(3) for n in range(5)]
    assert sorted(tuple(r) for r in out.select("deployment", "rank", "tick_id").collect()) == want
