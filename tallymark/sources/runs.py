"""Reading, unifying, storing and expiring run records."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.session import clear_scratch, scratch_path

DAY = "run_day"

_PARAMS = T.StructType(
    [
        T.StructField("temperature", T.DoubleType()),
        T.StructField("top_p", T.DoubleType()),
        T.StructField("top_k", T.IntegerType()),
        T.StructField("max_new_tokens", T.IntegerType()),
        T.StructField("repetition_penalty", T.DoubleType()),
        T.StructField("length_penalty", T.DoubleType()),
        T.StructField("num_beams", T.IntegerType()),
        T.StructField("do_sample", T.BooleanType()),
        T.StructField("early_stopping", T.BooleanType()),
        T.StructField("min_new_tokens", T.IntegerType()),
    ]
)

# Every key either run schema may hold; absent ones read as null.
RUN_SCHEMA = T.StructType(
    [
        T.StructField("test_id", T.StringType()),
        T.StructField("trial_id", T.StringType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("dataset_name", T.StringType()),
        T.StructField("best_score", T.DoubleType()),
        T.StructField("best_params", _PARAMS),
        T.StructField("params", _PARAMS),
        T.StructField("total_time", T.DoubleType()),
        T.StructField("optimization_time", T.DoubleType()),
        T.StructField(
            "optimization_history",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("trial_number", T.IntegerType()),
                        T.StructField("trial", T.IntegerType()),
                        T.StructField("params", _PARAMS),
                        T.StructField("score", T.DoubleType()),
                        T.StructField("error", T.StringType()),
                        T.StructField("timestamp", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField("total_trials", T.IntegerType()),
        T.StructField("successful_trials", T.IntegerType()),
        T.StructField("evaluation_summary", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("study_summary", T.MapType(T.StringType(), T.StringType())),
        T.StructField("recommendations", T.ArrayType(T.StringType())),
        T.StructField("performance_metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("hardware_usage", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("hardware_efficiency", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("cost_analysis", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("timestamp", T.StringType()),
    ]
)
CORRUPT = "_corrupt_record"
FOLDER = "run_folder"
FOLDERS = 64  # Spark lists more than 32 folders by tasks


def parsed_runs(spark: SparkSession, path: str, glob: str = "*", lines: bool = False) -> DataFrame:
    """Every run record with its file, read once; a record that cannot be parsed stands in ``CORRUPT``.

    One pretty-printed JSON document per file, or one per line with ``lines``.
    """
    schema = T.StructType([*RUN_SCHEMA.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return (
        spark.read.option("pathGlobFilter", glob)
        .text(path, wholetext=not lines)
        .select(
            F.from_json("value", schema, options).alias("_r"),
            F.col("_metadata.file_name").alias("file"),
            F.col("_metadata.file_modification_time").alias("modified_at"),
        )
        .select("_r.*", "file", "modified_at")
    )


def read_runs(spark: SparkSession, path: str, glob: str = "*", lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Run files and rejects: (readable runs, unreadable records with their file).

    One pretty-printed JSON document per file, or one per line with ``lines``.  Who
    needs both at once reads every file once with ``parsed_runs``.
    """
    raw = parsed_runs(spark, path, glob, lines)
    good = raw.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    return good, raw.where(F.col(CORRUPT).isNotNull()).select("file", F.col(CORRUPT).alias("record"))


def write_documents(documents: DataFrame, path: str, folders: int = FOLDERS) -> None:
    """One text file per row of ``run_id, value``, in a bounded number of folders dealt by the id.

    A file costs the same however short its text is, so rows are dealt to ``folders``
    tasks, not packed by size.  A folder per run would cost several calls of the file
    system more, and the driver would move every one when the job commits; here tasks
    move their own files.  That leaves files behind if the job fails, so ``path`` must
    be new.  Rows that share an id, or have none, get a file each.
    """
    dealt = documents.select("value", F.pmod(F.xxhash64("run_id"), F.lit(folders)).cast("int").alias(FOLDER))
    writer = dealt.repartition(folders).write.partitionBy(FOLDER).option("maxRecordsPerFile", 1)
    writer.option("mapreduce.fileoutputcommitter.algorithm.version", 2).mode("errorifexists").text(path)


def unify_runs(runs: DataFrame) -> DataFrame:
    """Both run schemas as one: id, time, kind of run, and trials numbered and counted alike.

    A run with a best score is an optimization, any other a benchmark.  Trial
    counts that a record lacks are taken from its history; a trial without an
    error succeeded.
    """
    def maybe(name: str, kind: str) -> Column:
        return F.col(name) if name in runs.columns else F.lit(None).cast(kind)

    extra = {
        "run_id": F.coalesce(maybe("test_id", "string"), maybe("trial_id", "string")),
        "run_time_s": F.coalesce(maybe("total_time", "double"), maybe("optimization_time", "double")),
        "run_type": F.when(F.col("best_score").isNotNull(), "optimize").otherwise("benchmark"),
    }
    if "optimization_history" in runs.columns:
        history = F.col("optimization_history")
        numbered = F.transform(
            history, lambda t: t.withField("trial_number", F.coalesce(t["trial_number"], t["trial"])).dropFields("trial")
        )
        done = F.size(F.filter(history, lambda t: t["error"].isNull()))
        extra |= {
            "optimization_history": numbered,
            "total_trials": F.coalesce(maybe("total_trials", "int"), F.when(history.isNotNull(), F.size(history))),
            "successful_trials": F.coalesce(maybe("successful_trials", "int"), F.when(history.isNotNull(), done)),
        }
    return runs.withColumns(extra)


def optimizations(runs: DataFrame) -> DataFrame:
    """Unified optimization runs as the comparisons and bins take them: parameters as columns of their own."""
    return runs.where(F.col("run_type") == "optimize").select(
        "run_id", F.col("model_name").alias("model"), F.col("dataset_name").alias("dataset"), "best_score", "run_time_s",
        "total_trials", "successful_trials", "timestamp", F.coalesce("best_params", "params").alias("_p"),
    ).select("*", "_p.*").drop("_p")


def benchmarks(runs: DataFrame) -> DataFrame:
    """Unified benchmark runs with the measures that comparisons use."""
    measure = F.col("performance_metrics")
    return runs.where(F.col("run_type") == "benchmark").select(
        "run_id", F.col("model_name").alias("model"), F.col("dataset_name").alias("dataset"), "timestamp",
        *[measure[m].alias(m) for m in ("tokens_per_second", "latency_p50", "latency_p95", "latency_p99", "memory_usage_mb", "throughput")],
        F.col("cost_analysis")["cost_per_1k_tokens_usd"].alias("cost_per_1k_tokens_usd"),
    )


def store_runs(runs: DataFrame, path: str, mode: str = "append") -> None:
    """Append run records as Parquet, one folder per kind of run.

    Partitions are written from where the rows lie: no shuffle, and no single
    task gets a whole kind of run.
    """
    runs.write.mode(mode).partitionBy("run_type").parquet(path)


def evaluation_summary(results: DataFrame, keys) -> DataFrame:
    """Sample count, mean score and share of scores above 0.8 per run."""
    n = F.count(F.lit(1))
    return results.groupBy(*keys).agg(
        n.alias("total_samples"),
        F.avg("score").alias("avg_score"),
        (F.count_if(F.col("score") > 0.8) / n).alias("accuracy"),
    )


def latest_runs(runs: DataFrame, by: str = "modified_at", n: int = 10, tie: str = "run_id") -> DataFrame:
    """The newest runs, newest first."""
    return runs.orderBy(F.desc(by), tie).limit(n)


def run_by_id(runs: DataFrame, run_id: str) -> DataFrame:
    return runs.where(F.col("run_id") == run_id)


def retention(runs: DataFrame, now: Column, days: int = 30, by: str = "ts") -> DataFrame:
    """Runs flagged kept or expired by age."""
    return runs.withColumn("status", F.when(F.col(by) < now - F.make_dt_interval(F.lit(days)), "expired").otherwise("kept"))


def keep_recent(runs: DataFrame, path: str, now: Column, days: int = 30, by: str = "ts") -> None:
    """Write the kept runs to a new folder; the source stays as it is."""
    kept = retention(runs, now, days, by).where(F.col("status") == "kept").drop("status")
    store_runs(kept, path, mode="errorifexists")


def store_by_day(runs: DataFrame, path: str, by: str = "ts", mode: str = "append") -> None:
    """Append runs as Parquet, one folder per day, from where the rows lie."""
    runs.withColumn(DAY, F.date_format(by, "yyyy-MM-dd")).write.mode(mode).partitionBy(DAY).parquet(path)


def _days(spark: SparkSession, path: str) -> dict[str, tuple[object, int]]:
    """Day folders of a store with their paths and numbers of files."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = {}
    for entry in files.listStatus(root):
        name = entry.getPath().getName()
        if entry.isDirectory() and name.startswith(f"{DAY}="):
            parts = [f for f in files.listStatus(entry.getPath()) if f.getPath().getName().startswith("part-")]
            found[name.split("=", 1)[1]] = (entry.getPath(), len(parts))
    return found


def _replace_day(spark: SparkSession, path: str, day: str, rows: DataFrame) -> None:
    """Put ``rows`` in the place of one day's folder; all other folders stay untouched."""
    held = scratch_path(spark, "day")
    rows.drop(DAY).write.parquet(held)  # a folder cannot be read and replaced at once
    kept = spark.read.schema(rows.drop(DAY).schema).parquet(held).withColumn(DAY, F.lit(day))
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)
    clear_scratch(spark, held)


def expire(spark: SparkSession, path: str, now: datetime, days: int = 30, by: str = "ts", most_files: int = 8) -> dict[str, list[str]]:
    """Drop what is older than ``days`` from a store by day; returns which days went, were cut or were compacted.

    Folders before the border's day are deleted as they are, the border's own day is
    filtered and replaced, later ones are not touched, except that a day with more than
    ``most_files`` files is written again as one file per 128 MB.
    """
    border = now - timedelta(days=days)
    edge = border.strftime("%Y-%m-%d")
    found = _days(spark, path)
    done: dict[str, list[str]] = {"dropped": [], "cut": [], "compacted": []}
    for day, (folder, n_files) in sorted(found.items()):
        own = spark.read.option("basePath", path).parquet(folder.toString()) if day >= edge else None
        if day < edge:
            clear_scratch(spark, folder.toString())
            done["dropped"].append(day)
        elif day == edge:
            kept = own.where(F.col(by) >= F.lit(border).cast(own.schema[by].dataType))
            if kept.isEmpty():
                clear_scratch(spark, folder.toString())
                done["dropped"].append(day)
            else:
                _replace_day(spark, path, day, kept)
                done["cut"].append(day)
        elif n_files > most_files:
            size = sum(f.getLen() for f in folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder))
            _replace_day(spark, path, day, own.repartition(max(1, -(-size // (128 << 20)))))
            done["compacted"].append(day)
    return done


def explode_history(runs: DataFrame) -> DataFrame:
    """Trial rows of each run; a run without history keeps one empty row."""
    return runs.select(
        "run_id", F.posexplode_outer("optimization_history").alias("position", "_t")
    ).select("run_id", "position", "_t.trial_number", "_t.score", "_t.error", "_t.timestamp", "_t.params.*")
