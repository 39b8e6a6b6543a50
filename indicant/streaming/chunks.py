"""Overlapping chunks of long texts, and extraction chunk by chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.extract import extract_all


def chunked(df: DataFrame, text_col: str = "text", size: int = 1 << 20, overlap: int = 1 << 10, ahead: bool = False) -> DataFrame:
    """A row for each chunk: chunk_no and the text of ``size`` characters with ``overlap`` more before it (or after it, ahead).

    An empty text has no chunk.  An overlap of 0 means none.
    """
    if size < 1 or overlap < 0:
        raise ValueError("size must be positive and overlap not negative")
    text = F.col(text_col)
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    rows = df.select("*", F.posexplode(starts).alias("chunk_no", "__at"))
    before = F.lit(0) if ahead else F.least(F.col("__at"), F.lit(overlap))
    part = F.substr(text, F.col("__at") - before + 1, F.lit(size) + (F.lit(overlap) if ahead else before))
    return rows.withColumn(text_col, part).drop("__at")


def extract_chunked(df: DataFrame, text_col: str = "text", keys: list[str] | None = None, types: list[str] | None = None, defang: bool = True, size: int = 1 << 20, overlap: int = 1 << 10) -> DataFrame:
    """(keys..., ioc_type, value), distinct for each text, found chunk by chunk; a cut may truncate a value."""
    keys = [c for c in df.columns if c != text_col] if keys is None else keys
    return extract_all(chunked(df.select(*keys, text_col), text_col, size, overlap), text_col, keys, types, defang).distinct()
