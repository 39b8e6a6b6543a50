"""The library's front door: files or texts to classified indicators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.extract import extract_all
from .operators.formats import with_warning_columns
from .operators.warninglists import classify
from .sources.text import read_documents


def extract(documents: DataFrame, lists: DataFrame | None = None, types: list[str] | None = None, defang: bool = True) -> DataFrame:
    """(source_kind, source_value, ioc_type, value, is_warning, warning_list, description) of documents.

    documents has source_kind, source_value and text; without lists everything is normal.
    """
    found = extract_all(documents, keys=["source_kind", "source_value"], types=types, defang=defang).distinct()
    return with_warning_columns(found if lists is None else classify(found, lists))


def extract_files(spark: SparkSession, paths: str | list[str], lists: DataFrame | None = None, types: list[str] | None = None, defang: bool = True, pdf: Callable[[bytes], str] | None = None, strict: bool = True) -> DataFrame:
    """Indicators of text, HTML and, with a parser, PDF files; unless strict, a file that cannot be read gives none."""
    return extract(read_documents(spark, paths, pdf, strict=strict), lists, types, defang)


def extract_text(spark: SparkSession, text: str, lists: DataFrame | None = None, types: list[str] | None = None, defang: bool = True) -> tuple[dict, dict]:
    """(normal, warnings) of one text: values by type, and entries with their list by type."""
    one = spark.createDataFrame([("text", "", text)], "source_kind string, source_value string, text string")
    return as_dicts(extract(one, lists, types, defang))


def as_dicts(classified: DataFrame) -> tuple[dict[str, list[str]], dict[str, list[dict[str, str]]]]:
    """The indicators of one source as plain dictionaries; for results of a size to print."""
    normal, warned = {}, {}
    for r in classified.orderBy("ioc_type", "value").select("ioc_type", "value", "is_warning", "warning_list", "description").collect():
        if r.is_warning:
            warned.setdefault(r.ioc_type, []).append({"value": r.value, "warning_list": r.warning_list, "description": r.description or ""})
        else:
            normal.setdefault(r.ioc_type, []).append(r.value)
    return normal, warned


def warning_lines(classified: DataFrame) -> DataFrame:
    """One printable line for each warning: type, value, list and description."""
    warned = classified.filter("is_warning")
    note = F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(": "), F.col("description"))).otherwise("")
    return warned.select("source_value", F.concat(F.col("ioc_type"), F.lit(" "), F.col("value"), F.lit(" ("), F.col("warning_list"), note, F.lit(")")).alias("line"))
