"""The relational store: sources, runs, iocs and their links, as Parquet tables.

Ids are 128-bit digests of the unique keys, so no sequence, single writer or global order is
needed.  A call of ``persist`` writes a batch: its sightings, runs, iocs and links, complete in
itself, under a folder of the attempt's own, and then publishes it with one marker, a small file
written last.  Readers see the parts that markers name and nothing else, so a run is there as a
whole or not at all, whoever else writes.  The marker is named by the batch's content: the same
run again finds its marker and leaves its own part unseen.  ``compact`` publishes one
part in the place of many the same way.  Rows that several batches hold, equal in all columns
and so in their id, are one row to readers.  Runs and links are a batch's own, since its name is
part of their ids: only parts that stand for one batch twice are searched for repeats of them.

Files hold ids as 16 bytes and links without their id, which follows from the two others.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCES = "id string, kind string, value string, content_hash string, first_seen timestamp, last_seen timestamp"
RUNS = "id string, source_id string, started_at timestamp, finished_at timestamp, tool_version string, options_json string"
IOCS = "id string, ioc_type string, value string, is_warning boolean, warning_list string, warning_description string"
RUN_IOCS = "id string, run_id string, ioc_id string"
SIGHTINGS = "kind string, value string, content_hash string, seen timestamp"
IOC_KEY = ["ioc_type", "value", "is_warning", "warning_list", "warning_description"]
IDS = {"id", "source_id", "run_id", "ioc_id"}
TABLES = {"sightings": SIGHTINGS, "runs": RUNS, "iocs": IOCS, "run_iocs": RUN_IOCS}


@dataclass(frozen=True)
class Options:
    defang: bool = True
    check_warnings: bool = True
    force_update: bool = False
    output_format: str = "text"

    def to_json(self) -> str:
        return json.dumps(asdict(self))


def digest(*parts: Column | str) -> Column:
    """Id of a key: parts keep their borders, so that no two keys run into one text."""
    return F.md5(F.to_json(F.array(*[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])))


def source_id(kind: str = "kind", value: str = "value") -> Column:
    return digest(kind, value)


def warning_texts() -> tuple[Column, Column, Column]:
    """Whether a row is a warning, its list and its description; both are empty for others."""
    warned = F.coalesce(F.col("is_warning"), F.lit(False))
    text = lambda c: F.when(warned, F.coalesce(c, F.lit(""))).otherwise("")
    return warned, text("warning_list"), text("description")


def ioc_rows(classified: DataFrame) -> DataFrame:
    """Distinct iocs of classified indicators; empty values are skipped, absent warnings are empty strings."""
    warned, name, description = warning_texts()
    rows = classified.filter("value IS NOT NULL AND value <> ''").select("ioc_type", "value", warned.alias("is_warning"), name.alias("warning_list"), description.alias("warning_description"))
    return rows.distinct().select(digest(*IOC_KEY).alias("id"), *IOC_KEY)


def new_iocs(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows of incoming that the store lacks."""
    return incoming.join(existing.select(*IOC_KEY), IOC_KEY, "left_anti")


def run_id(source: Column | str, now: Column, batch: str) -> Column:
    """Id of a source's run; a batch, where one is named, tells runs of one moment apart."""
    return digest(source, now, *([F.lit(batch)] if batch else []))


def run_rows(sources: DataFrame, now: Column, version: str, options: Options, batch: str = "") -> DataFrame:
    """One run a source (kind, value): started and finished at ``now``."""
    own = sources.select("kind", "value").distinct().select(source_id().alias("source_id"), now.alias("started_at"))
    return own.select(run_id("source_id", F.col("started_at"), batch).alias("id"), "source_id", "started_at", F.col("started_at").alias("finished_at"), F.lit(version).alias("tool_version"), F.lit(options.to_json()).alias("options_json"))


def link_rows(classified: DataFrame, now: Column, batch: str = "", distinct: bool = False) -> DataFrame:
    """Links of runs to iocs, each once; classified carries kind and source_value.  ``distinct`` says that its rows are, with warning texts as warning_texts gives them, and so the links."""
    ids = classified.filter("value IS NOT NULL AND value <> ''").select(
        run_id(source_id("kind", "source_value"), now, batch).alias("run_id"), digest("ioc_type", "value", *warning_texts()).alias("ioc_id"),
    )
    ids = ids if distinct else ids.distinct()
    return ids.select(digest("run_id", "ioc_id").alias("id"), "run_id", "ioc_id")


def packed(rows: DataFrame) -> DataFrame:
    """Rows as files hold them; ids that are bytes already stay so."""
    held = [c for c in rows.columns if not (c == "id" and "ioc_id" in rows.columns)]
    text = {c for c, kind in rows.dtypes if kind == "string"}
    return rows.select(*[F.unhex(c).alias(c) if c in IDS & text else F.col(c) for c in held])


def as_read(name: str) -> str:
    """The schema of a table's files."""
    fields = [f.split() for f in TABLES[name].split(", ")]
    return ", ".join(f"{c} {'binary' if c in IDS else t}" for c, t in fields if not (name == "run_iocs" and c == "id"))


def shown(c: str) -> Column:
    """An id as text."""
    return F.lower(F.hex(c)).alias(c)


def content_digest(rows: DataFrame) -> str:
    """A digest of the rows as a set with repeats, whatever their order: two sums of 64-bit hashes and a count."""
    each = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), each).cast("decimal(38,0)"))
    r = rows.agg(total(1).alias("a"), total(2).alias("b"), F.count("*").alias("n")).first()
    return f"{r.a}|{r.b}|{r.n}"


def apart(live: dict[str, dict], every: dict[str, dict]) -> bool:
    """Whether no batch stands in two live parts, as after two compactions at once."""
    def first(batch: str) -> set[str]:
        replaced = every[batch]["replaces"] if batch in every else []
        return set().union(*map(first, replaced)) if replaced else {batch}

    own = [first(b) for b in live]
    return sum(map(len, own)) == len(set().union(*own))


class Store:
    """The four tables under a folder of any store that Spark reaches.

    ``tables/<name>/part=<part>`` holds rows, ``published/<batch>`` a marker with the parts it
    stands for and the batches whose place it takes.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _place(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, name: str) -> bool:
        system, p = self._place(name)
        return system.exists(p)

    def _delete(self, name: str) -> None:
        system, p = self._place(name)
        system.delete(p, True)

    def _markers(self) -> dict[str, dict]:
        """Every marker by its batch; one is an entry of a folder and a line of JSON."""
        if not self._exists("published"):
            return {}
        texts = self.spark.read.text(f"{self.path}/published", wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("batch"), "value")
        return {r.batch: json.loads(r.value) for r in texts.collect()}

    def batches(self) -> dict[str, dict]:
        """The markers that no other one has replaced."""
        found = self._markers()
        gone = {b for m in found.values() for b in m["replaces"]}
        return {b: m for b, m in found.items() if b not in gone}

    def _publish(self, batch: str, part: str, replaces: list[str] = []) -> bool:  # noqa: B006
        """Write the marker, whole or not at all: a file of another name, then renamed.  False if it was there already."""
        system, ready = self._place(f"unpublished/{uuid.uuid4().hex}")
        out = system.create(ready, False)
        out.write(json.dumps({"part": part, "replaces": replaces}).encode())
        out.close()
        _, marker = self._place(f"published/{batch}")
        system.mkdirs(marker.getParent())
        if not system.exists(marker) and system.rename(ready, marker):
            return True
        system.delete(ready, False)
        return False

    def _write(self, rows: dict[str, DataFrame]) -> str:
        """Write the tables of one attempt, which nobody sees yet."""
        part = uuid.uuid4().hex
        for name, df in rows.items():
            packed(df).write.mode("overwrite").parquet(f"{self.path}/tables/{name}/part={part}")
        return part

    def _drop(self, part: str) -> None:
        for name in TABLES:
            self._delete(f"tables/{name}/part={part}")

    def _read_packed(self, name: str) -> DataFrame:
        """The published rows of a table with ids as bytes, equal ones once."""
        every, live = self._markers(), self.batches()
        where = f"{self.path}/tables/{name}"
        if not live:
            return self.spark.createDataFrame([], as_read(name))
        rows = self.spark.read.schema(as_read(name)).option("basePath", where).parquet(*[f"{where}/part={m['part']}" for m in live.values()])
        # Files of before held ids as text.
        rows = rows.select(*[F.when(F.octet_length(c) == 16, F.col(c)).otherwise(F.unhex(F.col(c).cast("string"))).alias(c) if c in IDS else F.col(c) for c in rows.columns if c != "part"])
        if len(live) == 1 or name in ("runs", "run_iocs") and apart(live, every):
            return rows
        return rows.distinct()

    def _read(self, name: str) -> DataFrame:
        """The published rows of a table, equal ones once."""
        rows = self._read_packed(name)
        own = {"id": digest(shown("run_id"), shown("ioc_id")).alias("id")} if name == "run_iocs" else {}
        return rows.select(*[own.get(c, shown(c) if c in IDS else F.col(c)) for c in (f.split()[0] for f in TABLES[name].split(", "))])

    def sources(self) -> DataFrame:
        """Each (kind, value) with its first and last sighting, and the last content hash that one named."""
        seen = self._read("sightings")
        last = F.max_by("content_hash", F.when(F.col("content_hash").isNotNull(), F.struct("seen", "content_hash"))).alias("content_hash")
        return seen.groupBy("kind", "value").agg(last, F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen")).select(source_id().alias("id"), "kind", "value", "content_hash", "first_seen", "last_seen")

    def runs(self) -> DataFrame:
        return self._read("runs")

    def iocs(self) -> DataFrame:
        return self._read("iocs")

    def run_iocs(self) -> DataFrame:
        return self._read("run_iocs")

    def persist(self, classified: DataFrame, now: str, version: str = "1.0", options: Options = Options(), sources: DataFrame | None = None, stored: bool = False) -> str:
        """Add one run for each source in classified (kind, source_value, ...), or in ``sources`` (kind, value[, content_hash]) if some have none.

        Returns the batch, named by all that the run consists of.  A call that fails at any
        point has added nothing and can be made again.  ``stored`` says that classified reads
        files which nobody changes and that its rows are distinct, with warning texts as
        warning_texts gives them: it is then read where it is instead of being written once more.
        """
        at = F.lit(now).cast("timestamp")
        warned, name, description = warning_texts()
        rows = classified.select("kind", "source_value", "ioc_type", "value", warned.alias("is_warning"), name.alias("warning_list"), description.alias("description"))
        staged = f"{self.path}/unpublished/{uuid.uuid4().hex}"
        try:
            if not stored:
                rows.distinct().write.parquet(f"{staged}/rows")  # what classified costs is paid once
                rows = self.spark.read.schema(rows.schema).parquet(f"{staged}/rows")
            own = rows.select("kind", F.col("source_value").alias("value")) if sources is None else sources
            own = own.select("kind", "value", (F.col("content_hash") if "content_hash" in own.columns else F.lit(None)).cast("string").alias("content_hash")).distinct()
            own.write.parquet(f"{staged}/sources")
            own = self.spark.read.schema(own.schema).parquet(f"{staged}/sources")
            named = "|".join([now, version, options.to_json(), content_digest(rows), content_digest(own)])
            batch = hashlib.md5(named.encode()).hexdigest()
            if not self._exists(f"published/{batch}"):
                part = self._write({"iocs": ioc_rows(rows), "run_iocs": link_rows(rows, at, batch, distinct=True), "sightings": own.withColumn("seen", at), "runs": run_rows(own, at, version, options, batch)})
                if not self._publish(batch, part):
                    self._drop(part)
        finally:
            self._delete(staged.removeprefix(f"{self.path}/"))
        return batch

    def compact(self) -> str | None:
        """Publish one part with the rows of all batches in their place; their files stay for readers until ``vacuum``."""
        old = sorted(self.batches())
        if len(old) < 2:
            return None
        part = self._write({name: self._read_packed(name) for name in TABLES})
        batch = hashlib.md5("|".join(old).encode()).hexdigest()
        if not self._publish(batch, part, old):
            self._drop(part)
        return batch

    def vacuum(self, older_than_s: float = 86400.0) -> int:
        """Delete the parts that no reader of the current state needs, of replaced batches and of attempts that ended unpublished, if last touched so long ago.  Returns how many."""
        needed, gone = {m["part"] for m in self.batches().values()}, 0
        limit = (time.time() - older_than_s) * 1000
        names = set()
        for table in TABLES:
            system, p = self._place(f"tables/{table}")
            if system.exists(p):
                names |= {s.getPath().getName().removeprefix("part=") for s in system.listStatus(p) if s.getModificationTime() <= limit}
        for part in names - needed:
            self._drop(part)
            gone += 1
        return gone

    def iocs_per_run(self) -> DataFrame:
        return self.run_iocs().drop("id").join(self.iocs().withColumnRenamed("id", "ioc_id"), "ioc_id").join(self.runs().withColumnRenamed("id", "run_id"), "run_id")

    def linked(self) -> DataFrame:
        """(run_id, ioc_id, the ioc's columns) of every link, ids as bytes."""
        return self._read_packed("run_iocs").join(self._read_packed("iocs").withColumnRenamed("id", "ioc_id"), "ioc_id")

    def known_links(self) -> tuple[DataFrame, int]:
        """Links (run_id, ioc_id) whose iocs are there, ids as bytes, and how many iocs they name.

        The distinct ids of links meet the iocs; the links themselves do only where some lack theirs.
        """
        links, iocs = self._read_packed("run_iocs"), self._read_packed("iocs").select(F.col("id").alias("ioc_id"))
        named = links.select("ioc_id").distinct().join(iocs.withColumn("there", F.lit(True)), "ioc_id", "left")
        r = named.agg(F.count("*").alias("n"), F.count("there").alias("there")).first()
        return links if r.n == r.there else links.join(iocs, "ioc_id", "left_semi"), r.there

    def runs_of_sources(self) -> DataFrame:
        """(run_id, kind, source_value, the run's columns), ids as bytes."""
        known = self.sources().select(F.unhex("id").alias("source_id"), "kind", F.col("value").alias("source_value"))
        return self._read_packed("runs").withColumnRenamed("id", "run_id").join(known, "source_id")

    def counts_per_run(self, *counts: Column) -> DataFrame:
        """(kind, source_value, the run's columns, counts): aggregates over each run's links with their iocs, as ``linked`` has them.

        Links are counted by run before they meet the runs, so only they and the iocs are dealt out whole.
        """
        each = self.linked().groupBy("run_id").agg(*counts)
        return self.runs_of_sources().join(each, "run_id").withColumns({c: shown(c) for c in ("run_id", "source_id")})
