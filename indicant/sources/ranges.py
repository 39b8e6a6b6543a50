"""Large text files in byte ranges: many tasks read one file, each chunk with what follows it.

A file is planned as spans and a span as chunks; a task takes one span or, where there are very
many, several of a few megabytes together.  Rows go to Spark in batches of bounded bytes, whatever
the chunk size.  Nominal borders are multiples of
the chunk size; the real one is the first line end behind it, or the first white space if no
line ends within the overlap, or else the next character, so both neighbours find the same one
from the same bytes.  A chunk's text goes on for up to ``overlap`` bytes into the next chunk and
ends there at white space: a value that starts in a chunk is whole in it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.extract import extract_all

SCHEMA = "source_value string, chunk_no long, start long, n_bytes long, text string"
SPACE = b" \t\n\r\x0b\x0c"
#: A character has at most so many bytes behind its first.
REST = 3
#: Beyond so many spans a task takes several, of so many bytes at least.
MANY, LEAST = 512, 4 << 20
#: Bytes of text after which a batch of rows is handed on.
BATCH = 4 << 20


def opened(path: str):
    """(file system, path) of any store that Arrow reaches; Hadoop writes local paths with one slash."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = path[len("file:") :]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def next_character(data: bytes, at: int) -> int:
    """The first place from ``at`` on where a character starts, or where its bytes must have ended."""
    end = min(at + REST, len(data))
    while at < end and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def border(data: bytes, at: int, overlap: int) -> int:
    """The real border for a nominal one at ``at``, from the bytes behind it only."""
    line = data.find(b"\n", at, at + overlap)
    if line >= 0:
        return line + 1
    blank = min((p for p in (data.find(bytes([s]), at, at + overlap) for s in SPACE) if p >= 0), default=-1)
    return blank + 1 if blank >= 0 else next_character(data, at)


def last_blank(data: bytes, start: int, end: int) -> int:
    """Just behind the last white space of a part, or its end without one."""
    found = max(data.rfind(bytes([s]), start, end) for s in SPACE)
    return found + 1 if found >= 0 else end


@dataclass
class Span(InputPartition):
    path: str
    length: int
    first: int
    chunks: int


class RangeReader(DataSourceReader):
    def __init__(self, options):
        self.files = json.loads(options["files"])
        self.size, self.overlap, self.span = (int(options[k]) for k in ("size", "overlap", "span"))
        if self.size < 1 or self.overlap < 0:
            raise ValueError("size must be positive and overlap not negative")

    def partitions(self) -> list[Span]:
        each = max(1, self.span // self.size)
        return [Span(path, length, first, each) for path, length in self.files for first in range(0, -(-length // self.size), each)]

    def read(self, partition: Span):
        system, path = opened(partition.path)
        with system.open_input_file(path) as f:
            for number in range(partition.first, min(partition.first + partition.chunks, -(-partition.length // self.size))):
                yield from self.chunk(f, partition, number)

    def chunk(self, f, partition: Span, number: int):
        """The chunk's row; none if a border behind it swallows it."""
        nominal, length = number * self.size, partition.length
        f.seek(nominal)
        data = f.read(min(length - nominal, self.size + 2 * self.overlap + 2 * REST))
        start = border(data, 0, self.overlap) if number else 0
        end = length - nominal if nominal + self.size >= length else border(data, self.size, self.overlap)
        if start >= end:
            return
        stop = end
        if end + nominal < length and self.overlap:
            limit = min(end + self.overlap, len(data))
            stop = limit if limit + nominal == length else max(end, last_blank(data, end, limit))
        yield (partition.path, number, nominal + start, end - start, data[start:stop].decode("utf-8", "ignore"))


@dataclass
class Spans(InputPartition):
    parts: list[Span]


def dealt(spans: list[Span], size: int) -> list[Spans]:
    """The spans by task; those of one file that follow each other are one."""
    if len(spans) <= MANY:
        return [Spans([s]) for s in spans]
    out, room = [], 0
    for s in spans:
        if room <= 0:
            out.append(Spans([]))
            room = LEAST
        own = out[-1].parts
        if own and own[-1].path == s.path and own[-1].first + own[-1].chunks == s.first:
            own[-1] = Span(s.path, s.length, own[-1].first, own[-1].chunks + s.chunks)
        else:
            own.append(s)
        room -= min(s.chunks * size, s.length - s.first * size)
    return out


class BatchReader(RangeReader):
    """The same rows as Arrow batches: Spark's own go by a number of rows, which long texts make large."""

    COLUMNS = pa.schema([("source_value", pa.string()), ("chunk_no", pa.int64()), ("start", pa.int64()), ("n_bytes", pa.int64()), ("text", pa.string())])

    def partitions(self) -> list[Spans]:
        return dealt(super().partitions(), self.size)

    def read(self, partition: Spans) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for span in partition.parts:
            for row in super().read(span):
                rows.append(row)
                held += row[3] + self.overlap
                if held >= BATCH:
                    yield self.batch(rows)
                    rows, held = [], 0
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), self.COLUMNS)], schema=self.COLUMNS)


class ByteRanges(DataSource):
    """Format ``byte_ranges``: options files (JSON of paths and lengths), size, overlap and span."""

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BatchReader:
        return BatchReader(self.options)


def listed(spark: SparkSession, paths: str | list[str]) -> list[tuple[str, int]]:
    """Files of paths, folders and patterns with their lengths, by Hadoop's file systems; names that start with _ or . are left out."""
    path_of, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    out = []
    for p in [paths] if isinstance(paths, str) else paths:
        system = path_of(p).getFileSystem(conf)
        found = system.globStatus(path_of(p)) or []
        if not found:
            raise FileNotFoundError(p)
        for status in found:
            for s in [status] if status.isFile() else system.listStatus(status.getPath()):
                if s.isFile() and s.getPath().getName()[0] not in "_.":
                    out.append((s.getPath().toString(), s.getLen()))
    return sorted(out)


def read_ranges(spark: SparkSession, paths: str | list[str], size: int = 1 << 20, overlap: int = 1 << 10, span: int = 128 << 20) -> DataFrame:
    """(source_value, chunk_no, start, n_bytes, text) of text files of any size, in bounded memory.

    start and n_bytes are the chunk's own bytes in the file, text what they and the overlap
    behind them say in UTF-8, malformed bytes left out.  The chunks' own bytes are those of
    the file, each once.  An empty file has no chunk.  The files must be in a store that both
    Hadoop and Arrow reach.
    """
    spark.dataSource.register(ByteRanges)
    files = json.dumps(listed(spark, paths))
    return spark.read.format("byte_ranges").option("files", files).option("size", size).option("overlap", overlap).option("span", span).load()


def extract_ranges(chunks: DataFrame, types: list[str] | None = None, defang: bool = True) -> DataFrame:
    """(source_value, ioc_type, value), distinct for each file; a value longer than the overlap may be cut."""
    return extract_all(chunks.select("source_value", "text"), keys=["source_value"], types=types, defang=defang).distinct()
