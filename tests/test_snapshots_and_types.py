"""Versions of warning lists, and indicator types of one's own from extraction to bundle."""

import json
import os

from pyspark.sql import functions as F

from indicant.functions.extractors import EXTRACTORS, STIX_PATTERNS, TITLES, extractor, register, unregister
from indicant.functions.patterns import Pattern
from indicant.operators import formats, sink, snapshots
from indicant.operators import warninglists as W
from indicant.operators.extract import extract_all

GOOD = json.dumps({"name": "L", "type": "string", "matching_attributes": ["domain"], "list": ["a.org"], "version": 7})
NEWER = json.dumps({"name": "L2", "list": ["b.org", "c.org"]})


def versions(spark, *rows):
    return spark.createDataFrame([(i, t, raw) for i, t, raw in rows], "list_id string, t string, raw string").select("list_id", F.col("t").cast("timestamp").alias("fetched_at"), "raw")


def at(text):
    return F.lit(text).cast("timestamp")


def test_the_last_good_version_counts(spark):
    rows = versions(
        spark, ("a", "2024-01-01", GOOD), ("a", "2024-01-02", NEWER), ("a", "2024-01-03", NEWER[:15]), ("a", "2024-01-04", None), ("b", "2024-01-01", "[]"), ("b", "2024-01-02", '{"list": "no array"}'),
        ("c", "2024-01-01", GOOD), ("c", "2024-01-01", GOOD), ("c", "2024-01-05", NEWER), ("d", "2024-01-02", ""), ("e", "2024-01-01", '{"name": "x"}'), (None, "2024-01-01", GOOD), ("f", None, GOOD),
    )
    got = {r.list_id: (r.name, r.list, r.stale, r.n_passed) for r in snapshots.as_of(rows, at("2024-01-04 12:00")).collect()}
    assert got == {"a": ("L2", ["b.org", "c.org"], True, 2), "c": ("L", ["a.org"], True, 0), None: ("L", ["a.org"], True, 0)}
    first = {r.list_id: (r.name, r.stale) for r in snapshots.as_of(rows, at("2024-01-01 12:00")).collect()}
    assert first == {"a": ("L", False), "c": ("L", False), None: ("L", False)}
    bad = {(r.list_id, str(r.fetched_at)[:10], r.problem) for r in snapshots.quarantine(rows).collect()}
    assert bad == {("a", "2024-01-03", "unreadable"), ("a", "2024-01-04", "no content"), ("b", "2024-01-01", "unreadable"), ("b", "2024-01-02", "unreadable"), ("d", "2024-01-02", "no content"), ("e", "2024-01-01", "no list")}
    assert snapshots.as_of(rows.limit(0), at("2024-01-01")).count() == 0


def test_files_are_versions_and_classify(spark, tmp_path):
    for name, text, day in (("a/list.json", GOOD, 1), ("b/list.json", NEWER[:9], 2)):
        path = tmp_path / name
        path.parent.mkdir()
        path.write_text(text)
        os.utime(path, (86400 * day, 86400 * day))
    rows = snapshots.read_versions(spark, str(tmp_path / "*" / "list.json"))
    lists = snapshots.as_of(rows, at("1970-01-03 00:00"), hours=72)
    assert [(r.list_id, r.stale) for r in lists.collect()] == [("a", False)]
    iocs = spark.createDataFrame([("domains", "A.org"), ("domains", "b.org")], "ioc_type string, value string")
    assert [r.value for r in W.warnings_only(iocs, lists).collect()] == ["A.org"]


def test_a_registered_type_goes_all_the_way(spark, tmp_path):
    docs = spark.createDataFrame([("s", "TCK-12 and TCK-9 here")], "source_value string, text string")
    pattern = Pattern(r"\b(TCK-[0-9]+)\b", (1,), "TCK-")
    register("my_ticket", pattern, title="Tickets", stix="[x-ticket:value = '{value}']")
    try:
        found = extract_all(docs, types=["my_ticket"])
        assert "## Tickets\n\nTCK-12\nTCK-9" in formats.text_reports(found).first().report
        bundle = json.loads(formats.stix_bundles(found, "2024-01-01T00:00:00Z").first().bundle)
        assert [o["pattern"] for o in bundle["objects"]] == ["[x-ticket:value = 'TCK-12']", "[x-ticket:value = 'TCK-9']"]
        sink.write_reports(found, str(tmp_path / "r"))
        assert "## Tickets" in (tmp_path / "r" / "s_iocs.txt").read_text()
    finally:
        unregister("my_ticket")
    assert "my_ticket" not in EXTRACTORS and "my_ticket" not in TITLES and "my_ticket" not in STIX_PATTERNS
    unregister("md5")
    assert "md5" in EXTRACTORS


def test_a_registry_of_its_own_leaves_the_library_alone(spark):
    docs = spark.createDataFrame([("TCK-12 1.2.3.4",)], "text string")
    own = {"ticket": extractor(Pattern(r"\b(TCK-[0-9]+)\b", (1,), "TCK-")), "ips": EXTRACTORS["ips"]}
    assert sorted(map(tuple, extract_all(docs, registry=own).collect())) == [("ips", "1[.]2[.]3[.]4"), ("ticket", "TCK-12")]
    assert "ticket" not in EXTRACTORS
