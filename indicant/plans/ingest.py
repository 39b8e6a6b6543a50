"""Registered queries of sources and streams: byte ranges, state by source, progress."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources import ranges
from ..storage import shared_folder
from ..streaming import by_source, progress, stream
from .queries import table

#: Types that the documents hold, and chunk sizes in bytes with their overlap.
HELD = ["emails", "ips", "sha1"]
SIZES = ((3000, 200), (65536, 1024))


def large_text(spark: SparkSession, sf_dir: str) -> str:
    """A folder with the documents' texts as text files, a text after the other."""
    where = shared_folder(spark, "large")
    table(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).alias("text")).write.text(where)
    return where


def range_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators of large text files read in byte ranges of two sizes: the same as of the whole texts."""
    where = large_text(spark, sf_dir)
    found = [ranges.extract_ranges(ranges.read_ranges(spark, where, size, overlap, span=8 * size), HELD).select(F.lit(size).alias("size"), "ioc_type", "value") for size, overlap in SIZES]
    return found[0].union(found[1]).distinct()


def range_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the chunks' own bytes add up to, and their longest text behind them."""
    where = large_text(spark, sf_dir)
    each = [ranges.read_ranges(spark, where, size, overlap).withColumns({"size": F.lit(size), "behind": F.octet_length("text") - F.col("n_bytes"), "most": F.lit(overlap)}) for size, overlap in SIZES]
    return each[0].union(each[1]).groupBy("size").agg(F.sum("n_bytes").alias("n_bytes"), (F.max(F.col("behind") - F.col("most")) <= 0).alias("bounded"))


def chunk_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in chunks of twenty words and four before, as a stream of several triggers, each document's last chunk in the last ones."""
    where = shared_folder(spark, "chunks")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", r"\s+").alias("words"))
    starts = docs.select("*", F.explode(F.sequence(F.lit(0), F.size("words") - 1, F.lit(20))).alias("at"))
    before = F.least(F.col("at"), F.lit(4))
    text = F.array_join(F.slice("words", F.col("at") - before + 1, before + 20), " ")
    rows = starts.select("doc_id", "at", text.alias("text"), (F.col("at") + 20 >= F.size("words")).alias("last"))
    for own in ("at < 40 AND NOT last", "at >= 40 AND NOT last", "last"):
        rows.filter(own).select("doc_id", "text", "last").write.mode("append").parquet(where)
    return spark.readStream.schema("doc_id long, text string, last boolean").option("maxFilesPerTrigger", 100).parquet(where)


def stream_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each indicator once for its document, though its chunks overlap and come in several triggers; the state ends with the document."""
    where = shared_folder(spark, "by-source")
    found = by_source.extract_by_source(chunk_stream(spark, sf_dir), "doc_id", types=HELD)
    by_source.run_by_source(found, f"{where}/out", f"{where}/checkpoint")
    return spark.read.schema("doc_id bigint, ioc_type string, value string").parquet(f"{where}/out")


def observed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, bytes and indicators by type, observed while an extraction is written."""
    seen = Observation("extraction")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    progress.extract_observed(docs, seen, types=HELD).write.parquet(shared_folder(spark, "observed"))
    return progress.totals(spark, seen)


def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of a stream: what its triggers tell adds up to the whole."""
    where = shared_folder(spark, "progress")
    log = progress.ProgressLog("extraction")
    spark.streams.addListener(log)
    try:
        source = stream.stream_parquet(spark, f"{sf_dir}/documents.parquet", "doc_id bigint, text string", files_per_trigger=4)
        stream.run_available(progress.extract_observed(source, "extraction", types=HELD), f"{where}/out", f"{where}/checkpoint")
        told = log.table(spark)
    finally:
        spark.streams.removeListener(log)
    return told.groupBy("metric").agg(F.sum("n").alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (range_extract, range_bytes, stream_by_source, observed_totals, stream_progress)
    return {f.__name__: f for f in own}
