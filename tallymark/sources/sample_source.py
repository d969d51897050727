"""Sample files as a data source: what cannot be read comes as rows, and new files as a stream.

``spark.read.format("samples")`` gives ``file, sample_id, item, error`` for files of
JSON lists (ids are positions), JSON objects (keys are ids) or JSON lines.  A list or
object file is one task's work, small files share a task, and line files are split by
byte ranges.  An unreadable file, an entry that is no object or an unreadable line is
a row with ``error`` and no item.  As a stream, the source gives each file once, in the
order in which files were last changed.
"""

from __future__ import annotations

import fnmatch
import io
import json
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tallymark.sources.samples_io import SampleFormat, shape_samples

SCHEMA = "file string, sample_id string, item map<string,string>, error string"
TASK_BYTES = 64 << 20  # of small files in one task, and of a range of a line file


class _Number(str):
    """A number as it is written."""


def _plain(value: object) -> object:
    """Numbers as numbers again, inside nested values."""
    if isinstance(value, _Number):
        return float(value) if any(c in value for c in ".eE") else int(value)
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def _text(value: object) -> str | None:
    if value is None or isinstance(value, str):
        return None if value is None else str(value)
    return json.dumps(_plain(value), ensure_ascii=False, separators=(",", ":"))


def _parsed(text: str) -> object:
    return json.loads(text, parse_float=_Number, parse_int=_Number)


def _row(file: str, name: str | None, item: object) -> tuple:
    if isinstance(item, dict):
        return file, name, {k: _text(v) for k, v in item.items()}, None
    return file, name, None, f"no object but {type(item).__name__}"


class Span(InputPartition):
    """Files of one task with the bytes of each; ``end`` None is the whole file."""

    def __init__(self, spans: list[tuple[str, int, int | None]]) -> None:
        self.spans = spans


class Files:
    """What both readers share: finding files, cutting them into tasks, reading one."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.kind, self.glob = options["path"], options.get("kind", "list"), options.get("glob", "*")
        self.id_key = options.get("id_key", "id")
        self.task_bytes = int(options.get("task_bytes", TASK_BYTES))
        if self.kind not in ("list", "keyed", "lines"):
            raise ValueError(f"unknown kind {self.kind!r}; known: list, keyed, lines")

    def found(self) -> list[tuple[int, str, int]]:
        """(change in ns, path, size) of all files, oldest first; names that start with . or _ are not data."""
        store, root = fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")
        infos = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        kept = [i for i in infos if i.type == fs.FileType.File and i.base_name[:1] not in "._" and fnmatch.fnmatch(i.base_name, self.glob)]
        return sorted((i.mtime_ns or 0, i.path, i.size) for i in kept)

    def cut(self, files: list[tuple[int, str, int]]) -> list[Span]:
        spans, together, size = [], [], 0
        for _, path, n in files:
            if self.kind == "lines" and n > self.task_bytes:
                spans += [Span([(path, at, min(at + self.task_bytes, n))]) for at in range(0, n, self.task_bytes)]
                continue
            if together and size + n > self.task_bytes:
                spans.append(Span(together))
                together, size = [], 0
            together.append((path, 0, None))
            size += n
        return spans + [Span(together)] * bool(together)

    def rows(self, span: Span) -> Iterator[tuple]:
        store, _ = fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")
        for path, start, end in span.spans:
            try:
                yield from self._lines(store, path, start, end) if self.kind == "lines" else self._whole(store, path)
            except (OSError, ValueError, RecursionError) as wrong:  # the file is a reject, the others go on
                yield path, None, None, str(wrong) or type(wrong).__name__

    def _whole(self, store: fs.FileSystem, path: str) -> list[tuple]:
        with store.open_input_stream(path) as file:
            data = _parsed(file.read().decode("utf-8-sig"))
        if isinstance(data, dict if self.kind == "keyed" else list):
            entries = data.items() if isinstance(data, dict) else ((str(i), item) for i, item in enumerate(data))
            return [_row(path, name, item) for name, item in entries]
        return [(path, None, None, f"no {'object' if self.kind == 'keyed' else 'list'} but {type(data).__name__}")]

    def _lines(self, store: fs.FileSystem, path: str, start: int, end: int | None) -> Iterator[tuple]:
        """Lines that begin in a range; the one across its end belongs to it as a whole."""
        with io.BufferedReader(store.open_input_file(path)) as file:
            at = max(0, start - 1)
            file.seek(at)
            if start:
                at += len(file.readline())
            while end is None or at < end:
                line = file.readline()
                if not line:
                    break
                here, at = at, at + len(line)
                if line.strip():
                    try:
                        item = _parsed(line.decode("utf-8-sig"))
                        name = _text(item.get(self.id_key)) if isinstance(item, dict) else None
                        yield _row(path, name, item)
                    except ValueError as wrong:
                        yield path, None, None, f"at byte {here}: {wrong}"


class SampleReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.files = Files(options)

    def partitions(self) -> list[InputPartition]:
        return self.files.cut(self.files.found()) or [Span([])]

    def read(self, partition: Span) -> Iterator[tuple]:
        return self.files.rows(partition)


class SampleStream(DataSourceStreamReader):
    """Offsets are the change time and path of the last file given; a batch is what lies between two of them."""

    def __init__(self, options: dict[str, str]) -> None:
        self.files = Files(options)

    def initialOffset(self) -> dict:
        return {"changed": -1, "path": ""}

    def latestOffset(self) -> dict:
        found = self.files.found()
        return {"changed": found[-1][0], "path": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low, high = ((x["changed"], x["path"]) for x in (start, end))
        return self.files.cut([f for f in self.files.found() if low < f[:2] <= high])

    def read(self, partition: Span) -> Iterator[tuple]:
        return self.files.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class SampleSource(DataSource):
    """Options: ``path``, ``kind`` (list, keyed, lines), ``glob``, ``id_key`` of lines, ``task_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "samples"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return SampleReader(dict(self.options))

    def streamReader(self, schema: object) -> DataSourceStreamReader:
        return SampleStream(dict(self.options))


def read_items(spark: SparkSession, path: str, kind: str = "list", stream: bool = False, **options: str) -> DataFrame:
    """``file, sample_id, item, error`` of a folder of sample files, now or as they come."""
    spark.dataSource.register(SampleSource)
    reader = (spark.readStream if stream else spark.read).format("samples").option("kind", kind)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.option("path", path).load()


def read_samples(
    spark: SparkSession, path: str, kind: str = "list", fmt: SampleFormat = SampleFormat(), stream: bool = False, **options: str
) -> tuple[DataFrame, DataFrame]:
    """Samples, and rejects as ``file, sample_id, error``; entries without a question or answer are neither."""
    items = read_items(spark, path, kind, stream, **options)
    good = shape_samples(items.where(F.col("error").isNull()).drop("error"), fmt)
    return good, items.where(F.col("error").isNotNull()).select("file", "sample_id", "error")
