"""Streams of chunks whose state lasts as long as their source.

A source's chunks come in any number of triggers; each of its indicators is given once.  What
was given is kept as keyed state, spread over parts by the indicator's hash so that one large
source is no single key, and is cleared when the source's last chunk has been seen.  Sources
that never end lose theirs when ``ttl`` has passed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.extract import extract_all

#: Parts of a source's state.
PARTS = 8
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class FirstOfSource(StatefulProcessor):
    """Gives each (ioc_type, value) of a (source, part) once; a row without a type ends the source."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "ioc_type string, value string", "given boolean", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        now, ended = {}, False
        for r in rows:
            if r.ioc_type is None:
                ended = True
            else:
                now[r.ioc_type, r.value] = None
        # Each question to the state is a round trip: most parts of a source hold nothing, and what ends now need not be kept.
        held = self.seen.exists()
        for indicator in now:
            if not (held and self.seen.containsKey(indicator)):
                if not ended:
                    self.seen.updateValue(indicator, (True,))
                yield Row(key=key[0], ioc_type=indicator[0], value=indicator[1])
        if ended and held:
            self.seen.clear()

    def close(self) -> None:
        pass


def extract_by_source(stream: DataFrame, key: str, last_col: str = "last", text_col: str = "text", types: list[str] | None = None, defang: bool = True, ttl_ms: int | None = None) -> DataFrame:
    """(key, ioc_type, value) of a stream of chunks (key, text, last), each once for its source.

    ``last`` marks a source's last chunk; what comes of the source in a later trigger counts
    as a new source of that name.  Null texts give nothing, a null ``last`` is none; rows
    with a null key are one source.
    """
    found = extract_all(stream.select(key, text_col), text_col, [key], types, defang)
    part = F.pmod(F.xxhash64("ioc_type", "value"), F.lit(PARTS)).cast("int")
    values = found.select(F.col(key).alias("key"), part.alias("part"), "ioc_type", "value")
    none = F.lit(None).cast("string")
    ends = stream.filter(F.col(last_col)).select(F.col(key).alias("key"), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"), none.alias("ioc_type"), none.alias("value"))
    kind = stream.schema[key].dataType.simpleString()
    once = values.unionByName(ends).groupBy("key", "part").transformWithState(
        FirstOfSource(ttl_ms), f"key {kind}, ioc_type string, value string", "Append", "None" if ttl_ms is None else "ProcessingTime"
    )
    return once.withColumnRenamed("key", key)


def run_by_source(found: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Work off all that is there, appended as Parquet; this query's state is in RocksDB, the session's own choice is put back."""
    conf = found.sparkSession.conf
    before = conf.get(PROVIDER)
    conf.set(PROVIDER, ROCKSDB)
    try:
        query = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        conf.set(PROVIDER, before)
    query.awaitTermination()
    return query
