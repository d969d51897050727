"""The sample data source, and a run store that expires by day."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from tallymark.sources import runs, sample_source, samples_io
from tallymark.streaming import telemetry as st


def write(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(text if isinstance(text, bytes) else text.encode())


def test_unreadable_files_and_entries_are_rows(spark, tmp_path):
    write(tmp_path / "in" / "sub", "good.json", '[{"question": "q", "answer": 1.50, "n": {"a": [1, 2.5, null]}, "b": true}, 7, {"question": "x"}]')
    write(tmp_path / "in", "cut.json", '[{"question": "q", "ans')
    write(tmp_path / "in", "bytes.json", b"\xff\xfe[1]")
    write(tmp_path / "in", "object.json", '{"a": 1}')
    write(tmp_path / "in", "empty.json", "")
    write(tmp_path / "in", "bom.json", b'\xef\xbb\xbf[{"question": "r", "answer": null}]')
    write(tmp_path / "in", "_hidden", "no")
    good, rejects = sample_source.read_samples(spark, str(tmp_path / "in"))
    rows = {r.question: r for r in good.collect()}
    assert set(rows) == {"q", "r"}
    assert rows["q"].answer == "1.50" and rows["q"].metadata == {"n": '{"a":[1,2.5,null]}', "b": "true"} and rows["r"].answer is None
    lost = {(os.path.basename(r.file), r.sample_id) for r in rejects.collect()}
    assert lost == {("good.json", "1"), ("cut.json", None), ("bytes.json", None), ("object.json", None), ("empty.json", None)}
    assert sample_source.read_items(spark, str(tmp_path / "nothing")).count() == 0


@pytest.mark.parametrize("task_bytes", [60, 700, 10_000])
def test_every_line_is_read_once_whatever_the_ranges(spark, tmp_path, task_bytes):
    lines = [json.dumps({"id": i, "question": "é" * (i % 9), "answer": "a"}, ensure_ascii=False) for i in range(40)]
    lines[7], lines[20] = "{broken", ""
    for name, end in (("a.jsonl", "\n"), ("b.jsonl", "")):
        write(tmp_path / "in", name, "\n".join(lines) + end)
    items = sample_source.read_items(spark, str(tmp_path / "in"), "lines", task_bytes=str(task_bytes)).collect()
    want = sorted([str(i) for i in range(40) if i not in (7, 20)] * 2)
    assert sorted(r.sample_id for r in items if r.error is None) == want
    assert [r.error.startswith("at byte ") for r in items if r.error] == [True, True]


def test_a_stream_takes_up_files_added_later(spark, tmp_path):
    folder = tmp_path / "in"
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for n in range(3):
        write(folder, f"f{n}.json", json.dumps([{"question": f"q{n}{i}", "answer": "a"} for i in range(3)]))
        os.utime(folder / f"f{n}.json", ns=(n * 10**9 + 10**18, n * 10**9 + 10**18))
        good, _ = sample_source.read_samples(spark, str(folder), stream=True)
        st.append_to(good, out, state)
        assert spark.read.parquet(out).count() == 3 * (n + 1)
    assert spark.read.parquet(out).select("question").distinct().count() == 9


def test_formats_are_the_ones_of_the_other_readers(spark, tmp_path):
    write(tmp_path / "in", "m.json", '[{"problem": "p", "solution": "s"}]')
    fmt = samples_io.FORMATS["korean_math"]
    one = samples_io.read_list(spark, str(tmp_path / "in"), fmt).drop("file").collect()
    two = sample_source.read_samples(spark, str(tmp_path / "in"), "list", fmt)[0].drop("file").collect()
    assert one == two


def changed(path):
    return {p: {f: os.stat(os.path.join(path, p, f)).st_mtime_ns for f in os.listdir(os.path.join(path, p))} for p in os.listdir(path) if "=" in p}


def test_only_the_border_day_is_written_again(spark, tmp_path):
    path = str(tmp_path / "store")
    start = dt.datetime(2024, 3, 1)
    log = spark.range(240).select("id", (F.lit(start) + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("ts")).coalesce(1)
    runs.store_by_day(log, path)
    before = changed(path)
    done = runs.expire(spark, path, dt.datetime(2024, 3, 10, 6), days=5)
    assert done == {"dropped": ["2024-03-01", "2024-03-02", "2024-03-03", "2024-03-04"], "cut": ["2024-03-05"], "compacted": []}
    after = changed(path)
    assert {d: f for d, f in after.items() if d != "run_day=2024-03-05"} == {d: f for d, f in before.items() if d > "run_day=2024-03-05"}
    left = spark.read.option("basePath", path).parquet(path)
    assert sorted(r.id for r in left.collect()) == list(range(4 * 24 + 6, 240))
    runs.store_by_day(log.where("id >= 200").repartition(12), path)
    done = runs.expire(spark, path, dt.datetime(2024, 3, 10, 6), days=5)
    assert done["compacted"] == ["2024-03-09", "2024-03-10"] and not done["dropped"]
    assert spark.read.option("basePath", path).parquet(path).count() == 240 - 102 + 40
