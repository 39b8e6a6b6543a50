"""What must not grow faster than its input: scans of a report, bytes of a batch, tasks of a file, round trips to a state, columns of links."""

import json

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Row
from pyspark.sql import functions as F

from indicant.operators import formats, sink, store
from indicant.sources import ranges
from indicant.streaming import by_source

SCHEMA = "kind string, source_value string, ioc_type string, value string, is_warning boolean, warning_list string, description string"
NOW = "2024-01-01 00:00:00"


def classified(spark, *values):
    return spark.createDataFrame([("file", "s", "domains", v, False, None, None) for v in values], SCHEMA)


def test_a_text_report_reads_its_indicators_once(spark, tmp_path):
    classified(spark, "a", "b").write.parquet(str(tmp_path / "i"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(formats.text_reports(spark.read.parquet(str(tmp_path / "i")))).count("Relation") == 1
    assert plan(formats.section_lines(spark.read.parquet(str(tmp_path / "i")))).count("Relation") == 2


def test_batches_are_bounded_by_bytes_and_tasks_by_bytes(tmp_path):
    path = tmp_path / "large.txt"
    path.write_bytes(b"some words of a line\n" * 1_000_000)
    files = {"files": json.dumps([[str(path), path.stat().st_size]]), "overlap": 100}
    reader = ranges.ByteRanges(files | {"size": 65536, "span": 128 << 20}).reader(None)
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert max(b.nbytes for b in batches) < 2 * ranges.BATCH and sum(sum(b.column("n_bytes").to_pylist()) for b in batches) == path.stat().st_size
    small = ranges.ByteRanges(files | {"size": 3000, "span": 24000}).reader(None)
    tasks = small.partitions()
    assert len(tasks) <= 6 and sum(b.num_rows for t in tasks for b in small.read(t)) == -(-path.stat().st_size // 3000)


class Calls:
    def __init__(self):
        self.held, self.n = {}, 0

    def getMapState(self, *_):
        return self

    def exists(self):
        self.n += 1
        return bool(self.held)

    def containsKey(self, k):
        self.n += 1
        return k in self.held

    def updateValue(self, k, v):
        self.n += 1
        self.held[k] = v

    def clear(self):
        self.n += 1
        self.held = {}


def test_a_source_that_ends_at_once_asks_its_state_once():
    calls, first = Calls(), by_source.FirstOfSource(None)
    first.init(calls)
    row = lambda v: Row(key="a", ioc_type=v and "ips", value=v)
    assert [r.value for r in first.handleInputRows(("a", 0), [row("x"), row("y"), row("x"), row(None)], None)] == ["x", "y"] and calls.n == 1
    assert [r.value for r in first.handleInputRows(("a", 0), [row("x")], None)] == ["x"] and calls.held
    assert [r.value for r in first.handleInputRows(("a", 0), [row("x"), row("z"), row(None)], None)] == ["z"] and not calls.held


def test_links_are_two_short_ids_and_are_told_apart_where_parts_overlap(spark, tmp_path):
    db = store.Store(spark, str(tmp_path / "db"))
    one, two = db.persist(classified(spark, "a", "b"), NOW), db.persist(classified(spark, "c"), NOW)
    part = next((tmp_path / "db/tables/run_iocs").glob("part=*/*.parquet"))
    assert pq.read_schema(part).names == ["run_id", "ioc_id"] and len(pq.read_table(part)["ioc_id"][0].as_py()) == 16
    assert "Aggregate" not in db.run_iocs()._jdf.queryExecution().optimizedPlan().toString()
    counted = {r.n for r in db.counts_per_run(F.count("*").alias("n")).collect()}
    assert counted == {1, 2} and db.run_iocs().select(store.digest("run_id", "ioc_id")).exceptAll(db.run_iocs().select("id")).count() == 0
    for name, own in (("x", [one]), ("y", [one, two])):  # two compactions at once
        rows = {t: db._read(t) for t in store.TABLES}
        db._publish(name, db._write(rows), own)
    assert db.run_iocs().count() == 3 and db.iocs_per_run().count() == 3


def test_ids_as_text_of_older_files_are_read(spark, tmp_path):
    db = store.Store(spark, str(tmp_path / "db"))
    db.persist(classified(spark, "a", "b"), NOW)
    want = {t: sorted(map(tuple, db._read(t).collect()), key=repr) for t in store.TABLES}
    for t in store.TABLES:
        db._read(t).write.parquet(f"{tmp_path}/db/tables/{t}/part=old")
    db._publish("old", "old", list(db.batches()))
    assert {t: sorted(map(tuple, db._read(t).collect()), key=repr) for t in store.TABLES} == want


def test_steps_by_source_move_the_keys_of_orders_only(spark, tmp_path):
    import __spark_entry__

    spark.createDataFrame([(k, k % 3) for k in range(30)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    for query in ("stix_bundle_sizes", "text_sections"):
        df = __spark_entry__.queries()[query](spark, str(tmp_path))
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1 and "REPARTITION_BY_NUM" in plan
        assert df.count() == 3


def test_reports_are_written_from_one_read_and_no_name_passes_the_driver(spark, tmp_path):
    rows = [(s, t, v, w, n, None) for s in ("a", "b") for t, v, w, n in (
        ("ips", "1.1.1.1", False, None), ("ips", "1.1.1.1", False, None), ("cves", "CVE-2020-1", True, "L"), ("ips", "8.8.8.8", True, None), ("md5", "x", None, None), ("md5", None, True, "L"), ("yara", "rule", False, None))]
    rows += [("c", "md5", "x", None, None, None), ("c", "md5", "y", None, None, None), ("d", "cves", "z", True, "L", "why"), ("e", "none", "v", False, None, None)]
    spark.createDataFrame(rows, "source_value string, ioc_type string, value string, is_warning boolean, warning_list string, description string").write.parquet(str(tmp_path / "i"))
    iocs = spark.read.parquet(str(tmp_path / "i"))
    lines = formats.report_texts(iocs)
    assert lines._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    names = sink.write_reports(iocs, str(tmp_path / "out"))
    want = {(f"{r.source_value}_iocs.txt", r.report + "\n") for r in formats.text_reports(iocs).collect()}
    got = {tuple(r) for r in sink.read_reports(names.filter("source_value <> 'e'"), str(tmp_path / "out")).collect()}
    assert got == want and len(want) == 4
    writer = sink.NamedFilesWriter(str(tmp_path / "direct"))
    batch = pa.RecordBatch.from_pydict({"file": ["x", "x", "y"], "line": ["1", "2", "3"]})
    told = [writer.write(iter([batch])), writer.write(iter([]))]
    assert [len(vars(t)) for t in told] == [1, 1]
    writer.commit([*told, None])
    assert {p.name: p.read_text() for p in (tmp_path / "direct").iterdir()} == {"x": "1\n2\n", "y": "3\n"}


def test_few_substrings_are_one_pass_and_many_the_same_by_pieces(spark, monkeypatch):
    from indicant.operators import warninglists as W

    lists = spark.createDataFrame([("a", "A", None, "substring", ["domain", "url"], ["Vendor", "x.io"]), ("b", None, "d", "substring", ["url"], ["vend", None]), ("c", "C", None, "string", ["domain"], ["k"])], W.SCHEMA)
    iocs = spark.createDataFrame([(t, v) for t in ("domains", "urls", "emails", "ips", "own") for v in ("my.vendor.io", "ven", "https://Vendor.x.io/a", "x.i", "", "none")], "ioc_type string, value string")
    few = W.substring_stage(W.prepared(iocs), lists)
    assert "Join" not in few._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(W, "SUBSTRINGS_IN_PLAN", 0)
    many = W.substring_stage(W.prepared(iocs), lists)
    rows = lambda df: {tuple(r) for r in df.collect()}
    assert rows(few) == rows(many) and rows(few)
