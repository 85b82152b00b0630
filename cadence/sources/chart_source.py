"""Chart files as a Spark data source: many small text files, packed into partitions by their bytes.

    spark.dataSource.register(ChartSource)
    spark.read.format("charts").load(folder).where("section = 'Metadata'")

Filters on `file` choose what is opened; filters on `section` let the reader stop in a file after the last section that
is asked for, so settings are read without the thousands of lines that follow them.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

SCHEMA = "file string, section string, line int, text string"
#: Bytes read at a time, rows of a batch, bytes of files in a partition, and bytes that opening a file counts as.
PART, ROWS, PARTITION, OPEN = 1 << 16, 1 << 14, 64 << 20, 1 << 12


def open_store(uri: str):
    """(filesystem, path) of a URI or a plain local path."""
    from pyarrow import fs

    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", uri)
    return fs.FileSystem.from_uri(uri)


def packed(sizes: Iterable[tuple[str, int]], bytes_: int, open_: int) -> list[list[str]]:
    """Names in order, in groups whose sizes (and `open_` for each name) add up to about `bytes_`; larger ones alone."""
    groups, room = [], 0
    for name, size in sizes:
        if room < size + open_ or not groups:
            groups.append([])
            room = bytes_
        groups[-1].append(name)
        room -= size + open_
    return groups


@dataclass
class Files(InputPartition):
    names: list[str]


def _test(f: Filter) -> Callable[[str | None], bool] | None:
    """A pushed filter as a test of a string; None for filters that Spark has to apply."""
    if isinstance(f, EqualTo):
        return lambda v: v == f.value
    if isinstance(f, In):
        return lambda v: v is not None and v in f.value
    if isinstance(f, StringStartsWith):
        return lambda v: v is not None and v.startswith(f.value)
    if isinstance(f, StringEndsWith):
        return lambda v: v is not None and v.endswith(f.value)
    if isinstance(f, StringContains):
        return lambda v: v is not None and f.value in v
    return None


class ChartReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.suffix = options.get("suffix", ".txt")
        self.bytes = int(options.get("partitionbytes", PARTITION))
        self.open = int(options.get("openbytes", OPEN))
        self.plain = options.get("plain", "false").lower() == "true"
        self.files: list[Callable] = []
        self.sections: list[Callable] = []
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            test, column = _test(f), ".".join(f.attribute) if hasattr(f, "attribute") else None
            if test is None or column not in ("file", "section"):
                yield f
                continue
            (self.files if column == "file" else self.sections).append(test)
            if column == "section" and isinstance(f, (EqualTo, In)):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = names if self.wanted is None else self.wanted & names

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow import fs

        store, path = open_store(self.path)
        found = store.get_file_info(fs.FileSelector(path, recursive=True))
        sizes = sorted((i.path, i.size) for i in found if i.is_file and i.path.endswith(self.suffix) and not i.base_name.startswith((".", "_")))
        return [Files(names) for names in packed((x for x in sizes if all(test(x[0]) for test in self.files)), self.bytes, self.open)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(self.path)
        rows: list[tuple] = []
        for name in partition.names:
            with store.open_input_stream(name) as file:
                for row in self.lines(file):
                    rows.append((name, *row))
                    if len(rows) == ROWS:
                        yield _batch(rows)
                        rows = []
        if rows:
            yield _batch(rows)

    def lines(self, file) -> Iterator[tuple[str | None, int, str]]:
        """(section, line, text) of the lines asked for, without empty ones and comments; reading ends after the last section."""
        section, seen, kept = None, set(), self._asked(None)
        if self.plain:
            yield from ((None, number, text) for number, text in enumerate(_lines(file)) if kept)
            return
        for number, text in enumerate(_lines(file)):
            if head := re.match(r"\[(\w+)\]\s*$", text):
                section = head[1]
                kept = section not in seen and self._asked(section)
                if self.wanted is not None and not kept and self.wanted <= seen:
                    return
                seen.add(section)
            elif kept and text.strip() and not text.startswith("//"):
                yield section, number, text

    def _asked(self, section: str | None) -> bool:
        return all(test(section) for test in self.sections)


def _lines(file) -> Iterator[str]:
    """Lines of a file of bytes, read a part at a time; bytes that are no UTF-8 become U+FFFD."""
    decode, rest = codecs.getincrementaldecoder("utf-8-sig")("replace").decode, ""
    while part := file.read(PART):
        *done, rest = (rest + decode(part)).split("\n")
        for line in done:
            yield line.removesuffix("\r")
    yield (rest + decode(b"", True)).removesuffix("\r")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.string()), strict=True)], ["file", "section", "line", "text"])


class ChartSource(DataSource):
    """Lines of chart files below a folder; options path, suffix (.txt), partitionBytes, openBytes, plain.

    With `plain` (true) files are no charts: all lines come, without sections.

    Of a section whose head comes twice in a file only the first counts. Lines before any section have none. Files
    whose names start with a dot or an underscore are passed over.
    """

    @classmethod
    def name(cls) -> str:
        return "charts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ChartReader:
        return ChartReader(self.options)


def read_charts(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """(file, section, line, text) of the charts below a folder, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ChartSource)
    return spark.read.format("charts").options(**options).load(path)


def write_charts(charts: DataFrame, folder: str, key: str, suffix: str = ".txt") -> DataFrame:
    """Write a file for each row of `charts` (key, value), named by the key, in one folder a partition; (key, file).

    A file gets its name when it is whole, and a task that is repeated writes the same names, so nothing is left in
    parts. The result is what the writing gave, in a table of its own; keys should be unique and fit for names.
    """
    from cadence.session import written

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, root = open_store(folder)
        task = TaskContext.get()
        place = f"{root}/part-{task.partitionId():05d}"
        store.create_dir(place, recursive=True)
        for batch in batches:
            files = []
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name, tmp = f"{place}/{k}{suffix}", f"{place}/.{k}-{task.taskAttemptId()}"
                with store.open_output_stream(tmp) as out:
                    out.write((value or "").encode())
                store.move(tmp, name)
                files.append(name)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.string())], ["key", "file"])

    schema = charts.select(charts[key].alias("key")).schema.add("file", "string")
    return written(charts.select(key, "value").mapInArrow(write, schema), "charts-written")
