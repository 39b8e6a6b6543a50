"""Shared helpers: shared storage, table access and byte-level word splitting."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = Path(__file__).resolve().parents[2]

#: Separators of the contract's word class [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z became a-z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The same as a byte map: upper case to lower, separators to a space, bytes of other scripts kept.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bounds of an Arrow batch, in bytes as well as rows, for sessions that set none of their own.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20), "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches where the caller has not, and ship this package where workers lack it."""
    own = spark.conf.getAll
    for key, value in BATCHES.items():
        if key not in own:
            spark.conf.set(key, value)
    sc = spark.sparkContext
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(ROOT) not in known and not is_local(spark) and not getattr(sc, "_indicant_shipped", False):
        archive = os.path.join(tempfile.mkdtemp(), "indicant.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for p in (ROOT / "indicant").rglob("*.py"):
                z.write(p, p.relative_to(ROOT))
        sc.addPyFile(archive)
        sc._indicant_shipped = True
    return spark


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process, as in tests."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def file_stamp(path: str) -> str:
    """Size and time of a file: caches of what was read from it hold for one state of it."""
    s = os.stat(path)
    return f"{s.st_size}-{s.st_mtime_ns}"


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a temporary one where that is unset and all is one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not is_local(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/indicant-shared"
    return f"{base.rstrip('/')}/indicant-{uuid.uuid4().hex}"


def stored(df: DataFrame, where: str, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{where}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """Array of the contract's words of a text; null and empty texts have none."""
    spaced = F.trim(F.regexp_replace(ascii_lower(F.coalesce(c, F.lit(""))), SEPARATORS, " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def with_kept(docs: DataFrame, keep: list[str], ddl: str) -> T.StructType:
    """Schema of the kept columns of docs followed by those of a DDL string."""
    return T.StructType([T.StructField(c, docs.schema[c].dataType) for c in keep] + T.StructType.fromDDL(ddl).fields)


def packed(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs with whole rows in __doc beside the columns an operator reads: extra columns cannot clash with its output."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__doc"), *[docs[c] for c in columns])
