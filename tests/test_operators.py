"""Warning lists, dedup, formats, store, sources and streaming."""

import json

import pytest
from pyspark.sql import functions as F

from indicant.operators import dedup, formats, store
from indicant.operators import warninglists as W
from indicant.operators.extract import extract_all
from indicant.sources import text as sources
from indicant.streaming import chunks, stream

LISTS = [
    ("public-dns-v4", "Public DNS Resolvers", "resolvers", "string", ["ip-src", "ip-dst", "ip"], ["8.8.8.8", "8.8.4.4", None]),
    ("google-cidr", "Google IP ranges", "", "cidr", ["ip-src", "ip-dst"], ["8.8.8.0/24", "142.250.0.0/15", "bad/99", "1.1.1.1"]),
    ("alexa-top1000", "Alexa Top 1000", "popular", "string", ["domain", "hostname"], ["google.com", "facebook.com"]),
    ("security-provider-domains", "Security Provider Domains", None, "substring", ["domain", "hostname", "url"], ["virustotal", "kaspersky"]),
    ("rx", None, None, "regex", ["domain"], ["^dyn\\d+\\.", "(broken", "(?P<n_1>zz)top"]),
    ("v6", "Six", None, "cidr", ["ipv6"], ["2001:db8::/33"]),
]
IOCS = [
    ("ips", "8.8.8[.]8"), ("ips", "8.8.8.100"), ("ips", "1.1.1.1"), ("ips", "143.0.0.1"), ("ips", "142.251.9.9"), ("domains", "Google[.]com"), ("domains", "www.virustotal.com"),
    ("domains", "dyn12.org"), ("domains", "a.zztop"), ("domains", "fine.org"), ("urls", "hxxp://x.kaspersky[.]com:80/y"), ("urls", "http://google.com/"), ("emails", "a@kaspersky.com"),
    ("emails", "b[@]fine[.]org"), ("ipv6", "2001:db8:7fff::1"), ("ipv6", "2001:db8:8000::1"), ("md5", "google.com"),
]
EXPECTED = {
    ("ips", "8.8.8[.]8"): "Public DNS Resolvers", ("ips", "8.8.8.100"): "Google IP ranges", ("ips", "142.251.9.9"): "Google IP ranges", ("domains", "Google[.]com"): "Alexa Top 1000",
    ("domains", "www.virustotal.com"): "Security Provider Domains", ("domains", "dyn12.org"): "rx", ("domains", "a.zztop"): "rx", ("urls", "hxxp://x.kaspersky[.]com:80/y"): "Security Provider Domains",
    ("ipv6", "2001:db8:7fff::1"): "Six", ("md5", "google.com"): "Alexa Top 1000",
}


@pytest.fixture(scope="module")
def lists(spark):
    return spark.createDataFrame(LISTS, W.SCHEMA)


def test_classification(spark, lists):
    iocs = spark.createDataFrame([(*r, k) for k, r in enumerate(IOCS)] + [("ips", "8.8.8[.]8", 99)], "ioc_type string, value string, pos int")
    rows = W.classify(iocs, lists).collect()
    assert {(r.ioc_type, r.value): r.warning_list for r in rows if r.is_warning} == EXPECTED
    assert {(r.ioc_type, r.value) for r in rows} == set(IOCS) - {("emails", "a@kaspersky.com")} and len(rows) == len(IOCS)
    assert {r.value for r in W.dropped_emails(iocs, lists).collect()} == {"a@kaspersky.com"}
    assert {(r.ioc_type, r.value) for r in W.warnings_only(iocs, lists).collect()} == set(EXPECTED)
    assert W.classify(iocs.limit(0), lists).count() == 0 and W.classify(iocs, lists.limit(0)).filter("is_warning").count() == 0


def test_list_tools(spark, lists):
    assert {r.category: r.n for r in W.categories(lists).collect()} == {"alexa": 1, "google": 1, "other": 1, "public": 1, "security": 1, "six": 1}
    report = {r.list_id: r for r in W.diagnose("1.1.1.1", "ips", lists, ["resolvers"]).collect()}
    assert report["google-cidr"].matched and not report["public-dns-v4"].matched and report["public-dns-v4"].n_values == 2
    dated = lists.withColumn("at", F.timestamp_seconds(F.when(F.col("list_id") == "v6", 0).otherwise(90000)))
    assert W.fresh(dated, "at", F.timestamp_seconds(F.lit(100000))).count() == 5


def test_lists_from_json(spark, tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "list.json").write_text(json.dumps({"name": "One", "type": "string", "matching_attributes": ["domain"], "list": ["a.org", None, 5]}, indent=1))
    assert [tuple(r) for r in W.load_lists(spark, f"{tmp_path}/*/list.json").collect()] == [("one", "One", None, "string", ["domain"], ["a.org", None, "5"])]


def test_dedup(spark):
    rows = [("domains", "a", 2), ("domains", "a", 1), ("domains", "A", 3), ("ips", "a", 4)]
    df = spark.createDataFrame(rows, "ioc_type string, value string, pos int")
    assert sorted((r.ioc_type, r.value, r.pos) for r in dedup.ordered_distinct(df).collect()) == [("domains", "A", 3), ("domains", "a", 1), ("ips", "a", 4)]
    maps = spark.createDataFrame([("h", "v", {"a": "1", "b": "2"}, 1), ("h", "v", {"b": "2", "a": "1"}, 2), ("h", "v", {"a": "9"}, 3)], "ioc_type string, value string, attrs map<string,string>, pos int")
    assert sorted(r.pos for r in dedup.ordered_distinct(maps).collect()) == [1, 3]
    seen = spark.createDataFrame([("domains", "a")], "ioc_type string, value string")
    assert sorted(map(tuple, dedup.unseen(df, seen).collect())) == [("domains", "A"), ("ips", "a")]
    parts = [df.select("ioc_type", "value", F.lit(w).alias("is_warning")) for w in (False, True)]
    assert dedup.union_of_sources(parts).count() == 3 + 4


CLASSED = [("s", "domains", "b[.]org", False, None, None), ("s", "domains", "a[.]org", False, None, None), ("s", "md5", 'q"u', False, None, None), ("s", "domains", "google.com", True, "Top", "popular"), ("s", "hosts", "a[.]org", False, None, None), ("t", "cves", "CVE-1", True, "L", "")]


@pytest.fixture(scope="module")
def classed(spark):
    return spark.createDataFrame(CLASSED, "source_value string, ioc_type string, value string, is_warning boolean, warning_list string, description string")


def test_json_and_text(classed):
    docs = {r.source_value: json.loads(r.json) for r in formats.json_rows(classed).collect()}
    assert docs["s"] == {"domains": ["a[.]org", "b[.]org"], "hosts": ["a[.]org"], "md5": ['q"u'], "warning_list_matches": {"domains": [{"description": "popular", "value": "google.com", "warning_list": "Top"}]}}
    assert docs["t"] == {"warning_list_matches": {"cves": [{"description": "", "value": "CVE-1", "warning_list": "L"}]}}
    assert formats.pretty('{"b":["é"],"a":[]}', True) == '{\n    "a": [],\n    "b": [\n        "\\u00e9"\n    ]\n}'
    text = {r.source_value: r.report for r in formats.text_reports(classed).collect()}
    assert text["s"] == (
        '# Indicators of Compromise (IOCs) Extracted\n\n\n## MD5 Hashes\n\nq"u\n\n## Domains\n\na[.]org\nb[.]org\n\n## Hosts\n\na[.]org\n\n# Warning List Matches\n\n'
        "The following indicators were found in warning lists and might be false positives:\n\n\n## Domains in Warning Lists\n\ngoogle.com - *Top*\n  Description: popular"
    )


def test_stix(spark, classed):
    rows = formats.stix_indicators(classed.filter("source_value = 's'")).collect()
    assert {(r.pattern, r.name, r.is_warning) for r in rows} == {("[domain-name:value = 'a.org']", "domains indicator", False), ("[domain-name:value = 'b.org']", "domains indicator", False), ("[domain-name:value = 'google.com']", "domains indicator", True), ("[file:hashes.'MD5' = 'q\"u']", "md5 indicator", False)}
    one = spark.createDataFrame([("urls", "hxxp://malicious.example[.]com/p'a\\th")], "t string, v string").select(formats.stix_pattern(F.col("t"), F.col("v"))).first()[0]
    assert one == "[url:value = 'http://malicious.example.com/p\\'a\\\\th']"
    bundle = json.loads(formats.stix_bundles(classed, "2024-01-01T00:00:00Z").filter("source_value = 't'").first().bundle)
    assert bundle["type"] == "bundle" and bundle["objects"][0]["x_warning_list"] == "L" and "x_warning_description" not in bundle["objects"][0]


@pytest.mark.parametrize(("source", "fmt", "name"), [
    ("https://example.com/a/b.html?q", "text", "example.com_b.html_iocs.txt"), ("http://example.com/", "json", "example.com_iocs.json"), ("http://h:80/x y", "stix", "h_80_x_y_iocs.stix.json"),
    ("/data/report.v1.pdf", "json", "report.v1_iocs.json"), ("plain", "text", "plain_iocs.txt"), ("/d/" + "n" * 80 + ".txt", "text", "n" * 50 + "_iocs.txt"), (".hidden", "text", ".hidden_iocs.txt"),
])
def test_output_filename(spark, source, fmt, name):
    assert spark.createDataFrame([(source,)], "s string").select(formats.output_filename(F.col("s"), fmt)).first()[0] == name


def test_store(spark, classed, tmp_path):
    rows = classed.withColumn("kind", F.lit("file"))
    db = store.Store(spark, str(tmp_path / "db"))
    db.persist(rows, "2024-01-01 00:00:00")
    db.persist(rows.filter("source_value = 's'"), "2024-02-01 00:00:00", options=store.Options(defang=False))
    assert (db.sources().count(), db.runs().count(), db.iocs().count(), db.run_iocs().count()) == (2, 3, 6, 11)
    seen = {r.value: (str(r.first_seen)[:10], str(r.last_seen)[:10]) for r in db.sources().collect()}
    assert seen == {"s": ("2024-01-01", "2024-02-01"), "t": ("2024-01-01", "2024-01-01")}
    assert db.iocs_per_run().count() == 11 and db.runs().join(db.sources().withColumnRenamed("id", "source_id"), "source_id").count() == 3
    assert json.loads(db.runs().orderBy("started_at").collect()[-1].options_json)["defang"] is False


def test_store_replaces_a_repeated_batch(spark, classed, tmp_path):
    rows = classed.withColumn("kind", F.lit("file"))
    db = store.Store(spark, str(tmp_path / "db"))
    sizes = lambda: (db.sources().count(), db.runs().count(), db.iocs().count(), db.run_iocs().count())
    db.persist(rows.filter("source_value = 's'"), "2024-01-01 00:00:00")
    batch = db.persist(rows, "2024-02-01 00:00:00")
    once, ids = sizes(), {r.id for r in db.iocs().collect()}
    assert db.persist(rows, "2024-02-01 00:00:00") == batch and sizes() == once and {r.id for r in db.iocs().collect()} == ids
    hashed = spark.createDataFrame([("file", "s", "h1")], "kind string, value string, content_hash string")
    db.persist(rows.limit(0), "2024-03-01 00:00:00", sources=hashed)
    assert {r.value: r.content_hash for r in db.sources().collect()} == {"s": "h1", "t": None}
    assert len(ids) == db.iocs().count() and all(len(i) == 32 for i in ids)


def test_regexes_that_cannot_be_joined(spark):
    lists = spark.createDataFrame([("r", "R", "", "regex", ["domain"], [r"^(zz)\.", r"^(..)\1\.", "(?P<a>q)(?P=a)", "(?P<a>r)(?P=a)", "(?i)X", "(bad", *[f"^n{k}$" for k in range(450)]])], W.SCHEMA)
    assert len(W.expressions(W.valid_regexes(lists)["r"])) == 4 + 3
    values = ["abab.org", "abac.org", "zz.org", "qq", "rr", "qr", "x1", "n449", "n450"]
    found = W.warnings_only(spark.createDataFrame([("domains", v) for v in values], "ioc_type string, value string"), lists)
    assert {r.value for r in found.collect()} == {"abab.org", "zz.org", "qq", "rr", "x1", "n449"}


def test_substrings_against_all_pairs(spark):
    import random

    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcé.") for _ in range(rng.randint(0, n)))
    entries, values = [word(9) for _ in range(60)] + ["", "a" * 40], sorted({word(12) for _ in range(150)} | {"ab", ""})
    lists = spark.createDataFrame([("s", "S", "", "substring", ["domain"], [*entries, None])], W.SCHEMA)
    rows = W.prepared(spark.createDataFrame([("domains", v) for v in values], "ioc_type string, value string"))
    for some in (entries, [e for e in entries if len(e) > 3]):
        lists = spark.createDataFrame([("s", "S", "", "substring", ["domain"], [*some, None])], W.SCHEMA)
        pairs = W.pairs_frame(spark, [("domains", m) for m in W.metadata(lists)])
        got = {r.value for r in W.substring_hits(rows, lists, pairs).collect()}
        assert got == {r.value for r in rows.collect() if any(e in r.clean or r.clean in e for e in some)}


HTML = """<!DOCTYPE html><html><head><title>no</title></head><body><script>var t="</p>";</script><style>p{}</style><!-- c > d -->
<h1>Bad &amp; worse</h1><p>1 &lt; 2&nbsp;&#233;&copy;</p><noscript>x</noscript> a&amp;lt;b</body></html>"""


def test_html(spark):
    cases = [HTML, " hxxp://evil[.]com/x \n", "", "plain  text"]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(cases)), "k int, h string").select(sources.html_to_text(F.col("h")), "k").orderBy("k").collect()]
    assert got == ["Bad & worse 1 < 2 é© a&lt;b", "hxxp://evil[.]com/x", "", "plain text"]


def test_reading_files(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"ok \xff 1.2.3.4")
    (tmp_path / "b.HTM").write_text("<p>u@v.org</p>")
    (tmp_path / "c.pdf").write_bytes(b"%PDF 9.8.7.6")
    rows = {r.source_value.rsplit("/", 1)[1]: r.text for r in sources.read_documents(spark, str(tmp_path), lambda b: b.decode()).collect()}
    assert rows == {"a.log": "ok  1.2.3.4", "b.HTM": "u@v.org", "c.pdf": "%PDF 9.8.7.6"}
    with pytest.raises(Exception, match="no PDF parser"):
        sources.read_documents(spark, str(tmp_path)).collect()
    (tmp_path / "d.pdf").write_bytes(b"\xff")
    (tmp_path / "e.txt").write_bytes("own \ufffd mark ".encode() + b"\xe2\x82 cut")
    lax = sources.read_documents(spark, str(tmp_path), lambda b: b.decode(), max_bytes=20, strict=False)
    rows = {r.source_value.rsplit("/", 1)[1]: r.text for r in lax.collect()}
    assert rows == {"a.log": "ok  1.2.3.4", "b.HTM": "u@v.org", "c.pdf": "%PDF 9.8.7.6", "d.pdf": "", "e.txt": "own \ufffd mark  cut"}
    (tmp_path / "d.pdf").unlink()
    with pytest.raises(Exception, match="too large"):
        sources.read_text(spark, str(tmp_path), max_bytes=3).collect()


def test_file_types(spark):
    rows = spark.createDataFrame([("a/b.PDF", "text/plain"), ("x.htm", None), ("y", "application/xhtml+xml"), ("z.md", "image/png"), (".pdf", "")], "p string, m string")
    got = [tuple(r) for r in rows.select(sources.detect_type(F.col("p"), F.col("m")), sources.type_by_extension(F.col("p")), sources.parser_for(F.col("p"))).collect()]
    assert got == [("text", "pdf", None), ("html", "html", "html"), ("html", "text", None), ("text", "text", None), ("text", "text", "pdf")]


def test_chunks(spark):
    text = "".join(chr(97 + k % 26) for k in range(25))
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, text string")
    behind = [r.text for r in chunks.chunked(df, size=10, overlap=3).orderBy("chunk_no").collect()]
    assert behind == [text[0:10], text[7:20], text[17:25]]
    assert [r.text for r in chunks.chunked(df, size=10, overlap=3, ahead=True).orderBy("chunk_no").collect()] == [text[0:13], text[10:23], text[20:25]]
    assert [r.text for r in chunks.chunked(df, size=10, overlap=0).orderBy("chunk_no").collect()] == [text[0:10], text[10:20], text[20:25]]
    long = spark.createDataFrame([(1, "\n".join(f"10.0.{k}.1 test{k}.evil.org" for k in range(200)))], "id int, text string")
    types = ["ips", "domains"]
    whole = set(map(tuple, extract_all(long, types=types).collect()))
    assert whole <= set(map(tuple, chunks.extract_chunked(long, types=types, size=500, overlap=60).collect()))


def test_streaming(spark, tmp_path):
    src = tmp_path / "in"
    rows = lambda *r: spark.createDataFrame(list(r), "doc_id bigint, text string").coalesce(1).write.mode("append").parquet(str(src))
    rows((1, "1.2.3.4 and 1.2.3.4"), (2, "1.2.3.4"))

    def run():
        found = stream.extract_stream(stream.stream_parquet(spark, str(src), "doc_id bigint, text string"), ["doc_id"], types=["ips"])
        stream.run_available(found, str(tmp_path / "out"), str(tmp_path / "check"))
        return sorted((r.doc_id, r.value) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [(1, "1[.]2[.]3[.]4"), (2, "1[.]2[.]3[.]4")]
    rows((1, "1.2.3.4 5.6.7.8"))
    assert run() == [(1, "1[.]2[.]3[.]4"), (1, "5[.]6[.]7[.]8"), (2, "1[.]2[.]3[.]4")]


def test_streaming_gives_no_part_as_a_whole(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    spark.createDataFrame([(k, f"10.0.0.{k}") for k in range(6)], "doc_id bigint, text string").repartition(6).write.parquet(src)
    found = stream.extract_stream(stream.stream_parquet(spark, src, "doc_id bigint, text string", files_per_trigger=1), ["doc_id"], types=["ips"])
    with pytest.raises(TimeoutError):
        stream.run_available(found, out, check, timeout_s=0.01)
    stream.run_available(found, out, check)
    assert sorted(r.doc_id for r in spark.read.schema("doc_id bigint").parquet(out).collect()) == list(range(6))
