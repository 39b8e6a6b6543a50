"""Reports as files, one of its own name for each source, written line by line.

Lines are sorted by source and order in their tasks, where the sort spills, and a task writes a
file's lines as they come: no source is ever gathered in a row.  A file is one writer's work, a
task has many.  Tasks write to a folder of the job; its commit moves the files to their places,
several folders at a time, its abort deletes them, so that a failed job leaves nothing and a
repeated task no second copy.  Names of files stay in their folders, none is told to the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..sources.ranges import opened
from .formats import EXT, output_filename, report_texts, stix_objects, stix_uuid, with_warning_columns

SCHEMA = "file string, line string"
#: Folders whose files are moved at a time, and bytes of reports after which a batch is handed on.
MOVERS, BATCH = 16, 4 << 20


@dataclass
class Written(WriterCommitMessage):
    folder: str


class NamedFilesWriter(DataSourceArrowWriter):
    """Lines (file, line), those of a file together and in order, to files under a path."""

    def __init__(self, path: str):
        self.path, self.job = path.rstrip("/"), f"_job-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, root = opened(self.path)
        folder, last, out = f"{root}/{self.job}/{uuid.uuid4().hex}", "", None
        try:
            for b in batches:
                for file, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if out is None or file != last:
                        if out is not None:
                            out.close()
                        else:
                            system.create_dir(folder, recursive=True)
                        last = file
                        out = system.open_output_stream(f"{folder}/{file}")
                    out.write(f"{line}\n".encode())
        finally:
            if out is not None:
                out.close()
        return Written(folder if out is not None else "")

    def commit(self, messages: list[Written | None]) -> None:
        system, root = opened(self.path)
        names = lambda folder: (f.base_name for f in system.get_file_info(fs.FileSelector(folder)) if f.type == fs.FileType.File)
        earlier = set(names(root)) if any(m and m.folder for m in messages) else set()

        def publish(folder: str) -> None:
            for file in names(folder):
                if file in earlier:
                    system.delete_file(f"{root}/{file}")  # a report of an earlier job makes room
                system.move(f"{folder}/{file}", f"{root}/{file}")

        with ThreadPoolExecutor(MOVERS) as pool:
            list(pool.map(publish, [m.folder for m in messages if m and m.folder]))
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = opened(self.path)
        if system.get_file_info(f"{root}/{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/{self.job}")


class NamedFiles(DataSource):
    """Format ``named_files``: option path."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> NamedFilesWriter:
        return NamedFilesWriter(self.options["path"])


def file_names(sources: DataFrame, fmt: str = "text", key: str = "source_value") -> DataFrame:
    """(key, file) of distinct sources: output_filename, numbered from the second source of one name on, in the sources' order."""
    named = sources.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("__name", output_filename(F.col(key), fmt))
    number = F.row_number().over(Window.partitionBy("__name").orderBy(key))
    tail = EXT.get(fmt, ".txt")
    stem = F.substr(F.col("__name"), F.lit(1), F.length("__name") - len(tail))
    return named.withColumn("__number", number).select(key, F.when(F.col("__number") == 1, F.col("__name")).otherwise(F.concat(stem, F.lit("_"), F.col("__number").cast("string"), F.lit(tail))).alias("file"))


def last_in(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    """rows with ``comma``: what stands behind each within its group but the last."""
    last = rows.groupBy(*group).agg(F.max(order).alias("__last"))
    return rows.join(last, group).withColumn("comma", F.when(F.col(order) < F.col("__last"), ",").otherwise("")).drop("__last")


def quoted(c: Column) -> Column:
    """A text as a JSON string."""
    return F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)


def json_lines(iocs: DataFrame, key: str = "source_value") -> DataFrame:
    """(key, a, b, c, d, line): the lines of a source's JSON document, indented by four, with the order they go in."""
    rows = with_warning_columns(iocs).filter("value IS NOT NULL")
    matches = F.lit("warning_list_matches")
    entry = lambda name, c: F.concat(F.lit(f'                "{name}": '), quoted(F.coalesce(c, F.lit(""))))
    body = F.concat(F.lit("            {\n"), F.concat_ws(",\n", entry("description", F.col("description")), entry("value", F.col("value")), entry("warning_list", F.col("warning_list"))), F.lit("\n            }"))
    normal = rows.filter(~F.col("is_warning")).select(key, F.col("ioc_type").alias("a"), F.lit("").alias("b"), F.col("value").alias("d"), F.concat(F.lit("        "), quoted(F.col("value"))).alias("text")).distinct()
    # Entries go in the order of their compact JSON; repeated ones stay.
    compact = F.to_json(F.struct(F.coalesce("description", F.lit("")).alias("description"), "value", F.coalesce("warning_list", F.lit("")).alias("warning_list")))
    copies = rows.filter("is_warning").select(key, F.col("ioc_type").alias("b"), compact.alias("compact"), body.alias("text")).groupBy(key, "b", "compact", "text").agg(F.count("*").alias("n"))
    numbered = copies.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    warned = numbered.select(key, matches.alias("a"), "b", F.concat("compact", F.lit("\n"), F.lpad(F.col("copy").cast("string"), 20, "0")).alias("d"), "text")
    values = last_in(normal.union(warned), [key, "a", "b"], "d")
    kinds = last_in(warned.select(key, "a", "b").distinct(), [key, "a"], "b")
    tops = last_in(normal.select(key, "a").union(warned.select(key, "a")).distinct(), [key], "a")
    own = F.col("a") == matches
    line = lambda df, b, c, d, text: df.select(key, "a", b.alias("b"), F.lit(c).alias("c"), d.alias("d"), text.alias("line"))
    no, end = F.lit(""), F.lit("\U0010ffff")
    parts = [
        line(tops, no, 0, no, F.concat(F.lit("    "), quoted(F.col("a")), F.when(own, ": {").otherwise(": ["))),
        line(kinds, F.col("b"), 1, no, F.concat(F.lit("        "), quoted(F.col("b")), F.lit(": ["))),
        line(values, F.col("b"), 2, F.col("d"), F.concat("text", "comma")),
        line(kinds, F.col("b"), 3, no, F.concat(F.lit("        ]"), "comma")),
        line(tops, end, 4, no, F.concat(F.when(own, "    }").otherwise("    ]"), "comma")),
    ]
    whole = rows.select(key).distinct()
    out = whole.select(key, F.lit("").alias("a"), no.alias("b"), F.lit(-1).alias("c"), no.alias("d"), F.lit("{").alias("line"))
    for p in [*parts, whole.select(key, end.alias("a"), end.alias("b"), F.lit(9).alias("c"), no.alias("d"), F.lit("}").alias("line"))]:
        out = out.unionByName(p)
    return out


def stix_lines(iocs: DataFrame, valid_from: str, key: str = "source_value") -> DataFrame:
    """(key, a, d, line): a source's STIX bundle, an object a line; its id derives from the source and the moment."""
    objects = last_in(stix_objects(iocs, valid_from, key).withColumn("d", F.concat(F.col("is_warning").cast("string"), "pattern")), [key], "d")
    whole = objects.select(key).distinct()
    name = stix_uuid(F.concat_ws("|", F.col(key).cast("string"), F.lit(valid_from)))
    head = whole.select(key, F.lit(0).alias("a"), F.lit("").alias("d"), F.concat(F.lit('{"type":"bundle","id":"bundle--'), name, F.lit('","objects":[')).alias("line"))
    body = objects.select(key, F.lit(1).alias("a"), "d", F.concat("json", "comma").alias("line"))
    return head.unionByName(body).unionByName(whole.select(key, F.lit(2).alias("a"), F.lit("").alias("d"), F.lit("]}").alias("line")))


def write_reports(iocs: DataFrame, path: str, fmt: str = "text", valid_from: str | None = None, key: str = "source_value") -> DataFrame:
    """Write a report for each source under path, as text, json or stix; returns (key, file).

    Rows without a source go nowhere.  Reports of an earlier call of the same name are replaced.
    iocs are read for the names and for the lines, for text once, so what costs much is stored before.
    """
    if fmt == "stix" and valid_from is None:
        raise ValueError("a STIX bundle needs the moment it is valid from")
    names = file_names(iocs, fmt, key)
    spark = iocs.sparkSession
    spark.dataSource.register(NamedFiles)
    if fmt == "text":
        placed = report_texts(iocs.join(names, key), key)  # leaves a source's lines together and in order
    else:
        lines = json_lines(iocs, key) if fmt == "json" else stix_lines(iocs, valid_from, key)
        order = [c for c in lines.columns if c not in (key, "line")]
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        placed = lines.join(names, key).repartition(parts, "file").sortWithinPartitions("file", *order, "line")
    placed.select("file", "line").write.format("named_files").option("path", path).mode("append").save()
    return names


def read_reports(names: DataFrame, path: str) -> DataFrame:
    """(file, report): the whole reports of names' files under path, opened by many tasks; no list of all files is made."""
    parts = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(path.rstrip("/"))
        rows, held = [], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["file", "report"])
        for b in batches:
            for file in b.column(0).to_pylist():
                with system.open_input_stream(f"{root}/{file}") as f:
                    rows.append((file, f.read().decode()))
                held += len(rows[-1][1])
                if held >= BATCH:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()

    return names.select("file").repartition(parts).mapInArrow(read, "file string, report string")
