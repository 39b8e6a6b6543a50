"""Versions of warning lists: what was fetched when, which of it is good, and the lists as of a moment.

A version is the raw text that a fetch left, null where it failed.  A list is what its last good
version says; a later one that cannot be read goes to quarantine and the one before it stays in
use, marked stale when it is older than a list may be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = "list_id string, fetched_at timestamp, raw string"
CONTENT = "name string, description string, type string, matching_attributes array<string>, list array<string>"
FIELDS = [f.split()[0] for f in CONTENT.split(", ")]
BAD = "__unreadable"


def read_versions(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(list_id, fetched_at, raw) of JSON files: the file's folder names the list, its time of change the fetch."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select(F.element_at(F.split("path", "/"), -2).alias("list_id"), F.col("modificationTime").alias("fetched_at"), F.col("content").cast("string").alias("raw"))


def checked(versions: DataFrame) -> DataFrame:
    """versions with the list's fields and ``problem``: null, ``no content``, ``unreadable`` or ``no list``."""
    content = F.from_json("raw", f"{CONTENT}, {BAD} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})
    rows = versions.select("list_id", "fetched_at", "raw", content.alias("c"))
    problem = F.when(F.coalesce(F.trim("raw"), F.lit("")) == "", "no content").when(F.col("c").isNull() | F.col(f"c.{BAD}").isNotNull(), "unreadable").when(F.col("c.list").isNull(), "no list")
    return rows.select("list_id", "fetched_at", "raw", *[f"c.{f}" for f in FIELDS], problem.alias("problem"))


def as_of(versions: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Lists (list_id, name, ..., list) as of ``now``, with fetched_at, stale and n_passed, the versions since then that were no good.

    Of versions of one moment the one with the larger text counts; a list without a good
    version by then is absent, to be found in ``quarantine``.
    """
    known = checked(versions).filter(F.col("fetched_at") <= now)
    good = F.when(F.col("problem").isNull(), F.struct("fetched_at", "raw", *FIELDS))
    order = F.when(F.col("problem").isNull(), F.struct("fetched_at", "raw"))
    times = known.groupBy("list_id").agg(F.max_by(good, order).alias("v"))
    since = known.join(times.select("list_id", F.col("v.fetched_at").alias("used")), "list_id").filter("problem IS NOT NULL AND fetched_at >= used").groupBy("list_id").agg(F.count("*").alias("n"))
    stale = F.col("v.fetched_at") <= now - F.expr(f"INTERVAL {int(hours)} HOURS")
    return times.filter("v IS NOT NULL").join(since, "list_id", "left").select("list_id", *[f"v.{f}" for f in FIELDS], "v.fetched_at", stale.alias("stale"), F.coalesce("n", F.lit(0)).alias("n_passed"))


def quarantine(versions: DataFrame) -> DataFrame:
    """(list_id, fetched_at, problem, raw) of the versions that are no lists."""
    return checked(versions).filter("problem IS NOT NULL").select("list_id", "fetched_at", "problem", "raw")
