"""Structured Streaming: indicators from files as they arrive, each once for its source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.extract import extract_all


def stream_parquet(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files as they arrive in a folder; a single file is a stream of one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return reader.option("pathGlobFilter", at.getName()).parquet(str(at.getParent()))
    return reader.parquet(path)


def stream_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files as they arrive: (source_value, text)."""
    files = spark.readStream.format("text").option("wholetext", True).load(path)
    return files.selectExpr("input_file_name() AS source_value", "value AS text")


def extract_stream(stream: DataFrame, keys: list[str], text_col: str = "text", types: list[str] | None = None, defang: bool = True, watermark: tuple[str, str] | None = None) -> DataFrame:
    """(keys..., ioc_type, value) of a stream, each once.

    Without a watermark (column, delay) the set of seen values is kept for good; with one,
    the state is bounded and a value may come again once the delay has passed.
    """
    if watermark is None:
        return extract_all(stream, text_col, keys, types, defang).dropDuplicates([*keys, "ioc_type", "value"])
    column, delay = watermark
    found = extract_all(stream.withWatermark(column, delay), text_col, [*keys, column], types, defang)
    return found.dropDuplicatesWithinWatermark([*keys, "ioc_type", "value"])


def run_available(stream: DataFrame, out: str, checkpoint: str, timeout_s: float | None = None) -> StreamingQuery:
    """Work off all that is there and append it as Parquet; with a limit of time, stop and raise when it has passed."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    if timeout_s is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout_s):
        query.stop()
        raise TimeoutError(f"the stream did not end in {timeout_s} s; {out} holds only a part")
    return query
