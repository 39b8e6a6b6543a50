"""Reports written as files of their sources' names."""

import json

import pytest
from pyspark.sql import functions as F

from indicant.operators import formats, sink

SCHEMA = "source_value string, ioc_type string, value string, is_warning boolean, warning_list string, description string"


@pytest.fixture()
def iocs(spark):
    rows = [(s, "domains", f"d{k}.org", False, None, None) for s in ("/in/a.txt", "/other/a.txt", "https://h.example/x/y") for k in range(30)]
    rows += [("/in/a.txt", t, v, w, n, d) for t, v, w, n, d in (
        ("md5", 'q"uo\\te', False, None, None), ("yara", "rule r {\n strings: }", False, None, None), ("cves", "CVE-2020-1", True, "L", "why"), ("cves", "CVE-2020-2", True, "L", None),
        ("ips", "1.2.3.4", True, None, ""), ("emails", "é@x.org", False, None, None), ("domains", "d1.org", False, None, None),
    )]
    rows += [("/only/warnings.log", "ips", "8.8.8.8", True, "DNS", None), (None, "ips", "1.1.1.1", False, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_text_and_json_are_the_reports(spark, iocs, tmp_path):
    for fmt, table, column, shown in (("text", formats.text_reports(iocs), "report", str), ("json", formats.json_rows(iocs), "json", formats.pretty)):
        out = tmp_path / fmt
        names = {r.source_value: r.file for r in sink.write_reports(iocs, f"file://{out}", fmt).collect()}
        assert sorted(names.values()) == sorted(p.name for p in out.iterdir() if p.is_file() and not p.name.startswith("."))
        want = {names[r.source_value]: shown(r[column]) for r in table.collect() if r.source_value is not None}
        assert {p.name: p.read_text()[:-1] for p in out.iterdir() if p.suffix != ".crc"} == want
    assert names["/in/a.txt"] == "a_iocs.json" and names["/other/a.txt"] == "a_iocs_2.json"


def test_stix_bundles(spark, iocs, tmp_path):
    names = sink.write_reports(iocs, str(tmp_path / "s"), "stix", "2024-01-01T00:00:00Z").collect()
    want = {r.source_value: json.loads(r.bundle)["objects"] for r in formats.stix_bundles(iocs, "2024-01-01T00:00:00Z").collect()}
    for r in names:
        assert json.loads((tmp_path / "s" / r.file).read_text())["objects"] == want[r.source_value]
    with pytest.raises(ValueError):
        sink.write_reports(iocs, str(tmp_path / "s"), "stix")


def test_a_job_that_fails_leaves_nothing_and_a_repeated_one_replaces(spark, iocs, tmp_path):
    out = tmp_path / "out"
    bad = iocs.withColumn("value", F.when(F.col("value") == "d29.org", F.raise_error(F.lit("broken"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="broken"):
        sink.write_reports(bad, str(out))
    assert not out.exists() or not list(out.iterdir())
    sink.write_reports(iocs, str(out))
    before = {p.name: p.read_text() for p in out.iterdir()}
    sink.write_reports(iocs, str(out))
    assert {p.name: p.read_text() for p in out.iterdir()} == before and len(before) == 4


def test_names_that_meet_are_numbered(spark):
    sources = spark.createDataFrame([(f"/d{k}/report.txt",) for k in range(3)] + [("https://h/" + "x" * 80 + str(k),) for k in range(2)] + [(None,)], "source_value string")
    names = {r.source_value: r.file for r in sink.file_names(sources, "json").collect()}
    assert [names[f"/d{k}/report.txt"] for k in range(3)] == ["report_iocs.json", "report_iocs_2.json", "report_iocs_3.json"]
    assert len(set(names.values())) == 5 and None not in names
