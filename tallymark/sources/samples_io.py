"""Readers of question/answer sample files."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STANDARD = ("context", "category", "difficulty", "language")
_ITEM = "map<string,string>"


@dataclass(frozen=True)
class SampleFormat:
    """Which keys hold the question and the answer, and what to keep."""

    question_key: str = "question"
    answer_key: str = "answer"
    language: str = "ko"
    languages: Sequence[str] = ()


# The built-in formats.
FORMATS: dict[str, SampleFormat] = {
    "json": SampleFormat(),
    "korean_math": SampleFormat("problem", "solution"),
    "korean_qa": SampleFormat("question", "answer"),
    "korean_reasoning": SampleFormat("context", "answer"),
    "multilingual_math": SampleFormat("problem", "solution", languages=("ko", "en", "ja", "zh")),
}


def shape_samples(items: DataFrame, fmt: SampleFormat = SampleFormat()) -> DataFrame:
    """Items (sample_id, item map) as samples.

    Items without a question or answer key are dropped, a missing language
    gets the default, and keys with no column of their own become metadata.
    """
    item = F.col("item")
    named = (fmt.question_key, fmt.answer_key, *STANDARD)
    get = lambda key: F.try_element_at(item, F.lit(key))
    out = items.where(F.map_contains_key(item, fmt.question_key) & F.map_contains_key(item, fmt.answer_key)).select(
        "*",
        get(fmt.question_key).alias("question"),
        get(fmt.answer_key).alias("answer"),
        *[get(c).alias(c) for c in STANDARD if c != "language"],
        F.when(F.map_contains_key(item, "language"), get("language")).otherwise(fmt.language).alias("language"),
        F.map_filter(item, lambda k, _: ~k.isin(*named)).alias("metadata"),
    )
    if fmt.languages:
        out = out.where(F.col("language").isin(*fmt.languages))
    return out.drop("item")


def read_list(spark: SparkSession, path: str, fmt: SampleFormat = SampleFormat(), glob: str = "*") -> DataFrame:
    """JSON array files: a sample's id is its position in its file.

    An array file cannot be split, so each is one task's work; very large sets
    belong in ``read_lines`` form.
    """
    files = _whole_files(spark, path, glob)
    items = files.select(
        "file", F.posexplode(F.from_json("value", f"array<{_ITEM}>")).alias("_pos", "item")
    ).select("file", F.col("_pos").cast("string").alias("sample_id"), "item")
    return shape_samples(items.where(F.col("item").isNotNull()), fmt)


def read_keyed(spark: SparkSession, path: str, fmt: SampleFormat = SampleFormat(), glob: str = "*") -> DataFrame:
    """JSON object files: the key of an entry is the sample's id."""
    files = _whole_files(spark, path, glob)
    items = files.select("file", F.explode(F.from_json("value", f"map<string,{_ITEM}>")).alias("sample_id", "item"))
    return shape_samples(items.where(F.col("item").isNotNull()), fmt)


def read_lines(
    spark: SparkSession, path: str, id_key: str, fmt: SampleFormat = SampleFormat(), glob: str = "*"
) -> DataFrame:
    """One JSON object per line, with its own id; files are split freely."""
    lines = spark.read.option("pathGlobFilter", glob).text(path)
    items = lines.select(F.from_json("value", _ITEM).alias("item")).where(F.col("item").isNotNull())
    return shape_samples(
        items.select(F.try_element_at("item", F.lit(id_key)).alias("sample_id"), "item"), fmt
    )


def _whole_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    text = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    return text.select(F.col("_metadata.file_path").alias("file"), "value")


LOADERS: dict[str, Callable[..., DataFrame]] = {}


def register_loader(name: str, load: Callable[..., DataFrame]) -> None:
    """Add a reader: a function of (spark, path, **options) that returns samples."""
    LOADERS[name] = load


def load_samples(spark: SparkSession, kind: str, path: str, **options) -> DataFrame:
    """Samples by registered reader name."""
    if kind not in LOADERS:
        raise ValueError(f"unknown loader {kind!r}; known: {', '.join(sorted(LOADERS))}")
    return LOADERS[kind](spark, path, **options)


def _reader(fmt: SampleFormat) -> Callable[..., DataFrame]:
    return lambda spark, path, **options: read_list(spark, path, **{"fmt": fmt, **options})


for _name, _fmt in FORMATS.items():
    register_loader(_name, _reader(_fmt))
register_loader("keyed", read_keyed)
register_loader("lines", read_lines)


def array_files(df: DataFrame, file_key: str, order: str, item: Mapping[str, str] | None = None) -> DataFrame:
    """``file_key, value``: the text of a JSON array file for every ``file_key`` value."""
    columns = [F.col(c).alias(k) for k, c in (item or {c: c for c in df.columns if c != file_key}).items()]
    body = F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.to_json(F.struct(*columns)).alias("j")))),
        lambda x: x["j"],
    )
    return df.groupBy(file_key).agg(F.concat(F.lit("["), F.array_join(body, ",\n"), F.lit("]")).alias("value"))


def write_array_files(df: DataFrame, path: str, file_key: str, order: str, item: Mapping[str, str] | None = None) -> None:
    """Write rows as JSON array files, one text file per ``file_key`` value.

    ``file_key`` must give files of bounded size (an id range, for example).
    """
    array_files(df, file_key, order, item).write.partitionBy(file_key).text(path)


def write_keyed_files(df: DataFrame, path: str, file_key: str, id_column: str, item: Mapping[str, str]) -> None:
    """Write rows as JSON object files keyed by id, one per ``file_key`` value."""
    columns = [F.col(c).alias(k) for k, c in item.items()]
    entry = F.concat(F.to_json(F.struct(F.col(id_column).cast("string").alias("k"))), F.to_json(F.struct(*columns)))
    # {"k":"7"}{...} becomes "7":{...}
    entry = F.regexp_replace(entry, r'^\{"k":("[^"]*")\}', "$1:")
    (
        df.groupBy(file_key)
        .agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(entry)), ",\n"), F.lit("}")).alias("value"))
        .write.partitionBy(file_key)
        .text(path)
    )
