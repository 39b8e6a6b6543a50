"""How far an extraction has come: rows, bytes and indicators by type, observed while it runs.

The figures are gathered by the job that extracts, without a pass of their own.
"""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..functions.extractors import EXTRACTORS
from ..operators.extract import indicator_columns, tagged

SCHEMA = "batch long, metric string, n long"


def metrics(types: list[str], text_col: str) -> list[Column]:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return [F.count("*").alias("rows"), total(F.octet_length(text_col)).alias("bytes"), *[total(F.size(f"__{t}")).alias(t) for t in types]]


def extract_observed(df: DataFrame, observed: Observation | str, text_col: str = "text", keys: list[str] | None = None, types: list[str] | None = None, defang: bool = True) -> DataFrame:
    """extract_all whose run also fills an Observation or, by its name, the progress of a stream."""
    types = list(EXTRACTORS) if types is None else types
    keys = [c for c in df.columns if c != text_col] if keys is None else keys
    wide = indicator_columns(df.select(*keys, text_col), text_col, types, defang).observe(observed, *metrics(types, text_col))
    entries = wide.select(*keys, F.explode(F.concat(*map(tagged, types))).alias("__e"))
    return entries.select(*keys, "__e.ioc_type", "__e.value")


def totals(spark: SparkSession, observed: Observation) -> DataFrame:
    """(metric, n) of a run that has ended; one that has not is waited for."""
    return spark.createDataFrame(sorted(observed.get.items()), "metric string, n long")


class ProgressLog(StreamingQueryListener):
    """The observed figures of every trigger of the streams that are started while it listens."""

    def __init__(self, name: str):
        self.name, self.lines, self.ended = name, [], threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            self.lines += [(event.progress.batchId, metric, n) for metric, n in row.asDict().items()]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.set()

    def table(self, spark: SparkSession) -> DataFrame:
        """(batch, metric, n), when the stream has ended: events are told in order, its end last."""
        self.ended.wait()
        return spark.createDataFrame(sorted(self.lines), SCHEMA)
