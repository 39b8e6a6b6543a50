"""Registered queries of the indicator operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.extractors import EXTRACTORS, extractor
from ..functions.patterns import Pattern
from ..operators import dedup, formats, sink, snapshots, store
from ..operators import warninglists as W
from ..operators.extract import counts_by_type, extract_all, extract_wide
from ..sources import text as sources
from ..storage import shared_folder, written
from ..streaming import chunks, stream
from .reports import IOCS, LISTS, text_sql

NOW, LATER, LATEST = "2024-01-01 00:00:00", "2024-02-01 00:00:00", "2024-03-01 00:00:00"
CLASSIFIED = "kind string, source_value string, ioc_type string, value string, is_warning boolean, warning_list string, description string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reports(spark: SparkSession, sf_dir: str, *types: str, parts: int = 0) -> DataFrame:
    """(o_orderkey, source_value, text): report texts of the given types, one a line, for every order; with parts, a source's in one of so many."""
    text = " || chr(10) || ".join(f"({text_sql(t, 'spark')})" for t in types)
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "CAST(o_custkey AS STRING) AS source_value")
    orders = orders.repartition(parts, "source_value") if parts else orders
    return orders.selectExpr("o_orderkey", "source_value", f"{text} AS text")


def extraction(ioc_type: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        values = EXTRACTORS[ioc_type](F.col("text"), True)
        return reports(spark, sf_dir, ioc_type).select("o_orderkey", F.explode(values).alias("value"))

    query.__name__ = f"extract_{ioc_type}"
    return query


def extract_all_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All types over every document, distinct by document, counted by type."""
    found = extract_all(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return counts_by_type(found)


def extract_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_all(table(spark, sf_dir, "documents").select("doc_id", "text"), types=["emails", "ips", "sha1"])


def extract_fanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without defanging."""
    return extract_all(reports(spark, sf_dir, "urls", "emails").select("o_orderkey", "text"), types=["urls", "emails"], defang=False)


def extract_wide_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = extract_wide(reports(spark, sf_dir, "emails", "asn", "cves").select("o_orderkey", "text"), types=["emails", "asn", "cves"])
    size = lambda t: F.coalesce(F.size(F.try_element_at("iocs", F.lit(t))), F.lit(0)).cast("long").alias(f"n_{t}")
    return wide.select("o_orderkey", size("emails"), size("asn"), size("cves"))


def hash_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = "CASE o_orderkey % 4 WHEN 0 THEN md5(CAST(o_orderkey AS STRING)) WHEN 1 THEN repeat('ab', 16) WHEN 2 THEN sha2(CAST(o_orderkey AS STRING), 256) ELSE repeat('41', 32) || '5A5B5C5D' END"
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{value} AS value")
    return rows.select("o_orderkey", "value", T.is_valid_hash(F.col("value")).alias("valid"))


DOMAIN_CASES = ["'a' || S || '.com'", "'www.Google.com'", "'evil.github.com'", "'learn.microsoft.com'", "'x.learn.microsoft.com'", "'foo.exe'", "'window.com'", "repeat('a', 64) || '.net'", "'badminton.google.com'", "'nodots'", "'x.aws.amazon.com'", "'malware.aws.amazon.com'", "'vue.react.io'"]


def cased(cases: list[str], key: str) -> str:
    whens = " ".join(f"WHEN {k} THEN {c.replace('S', f'CAST({key} AS STRING)')}" for k, c in enumerate(cases))
    return f"CASE {key} % {len(cases)} {whens} END"


def domain_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{cased(DOMAIN_CASES, 'o_orderkey')} AS value")
    return rows.select("o_orderkey", "value", T.is_valid_domain(F.col("value")).alias("valid"))


def defang_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", "url")
    return rows.select("page_id", T.defang_url(F.col("url")).alias("url_defanged"), T.defang_dotted(T.url_host(F.col("url"))).alias("host_defanged"), T.defang_email(F.concat(F.lit("x@"), T.url_host(F.col("url")))).alias("email_defanged"))


REFANG_CASES = ["'hxxp://a' || S || '[.]com'", "'hXXps://b(.)org{/}x'", "'u[@]mail{.}net'", "'h__p://c[:]80[//]d'", "'v[@ ]w(@)x{@}y'", "'plain' || S"]


def refang_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{cased(REFANG_CASES, 'c_custkey')} AS value")
    return rows.select("c_custkey", T.refang(F.col("value")).alias("clean"))


def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", sources.html_to_text(F.col("html")).alias("text"))


def extract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs and file names of the pages' addresses."""
    return extract_all(table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("text")), types=["urls", "filenames"])


MIMES = ["'application/pdf'", "'TEXT/HTML'", "'application/xml'", "'text/plain'", "'image/png'"]
PATHS = ["'/d/a' || S || '.PDF'", "'b.htm'", "'c.xml'", "'x.log'", "'y.unknown'", "'noext'", "'.pdf'"]


def detect_file_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{cased(MIMES, 'o_orderkey')} AS mime", f"{cased(PATHS, 'o_orderkey')} AS path")
    return rows.select("o_orderkey", sources.detect_type(F.col("path"), F.col("mime")).alias("by_mime"), sources.detect_type(F.col("path")).alias("by_path"), sources.parser_for(F.col("path")).alias("parser"))


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", "url")
    return rows.select("page_id", T.url_host(F.col("url")).alias("host"), T.url_path(F.col("url")).alias("path"), sources.is_valid_url(F.col("url")).alias("valid"), sources.temp_filename(F.col("url"), F.lit("text/html; charset=utf-8")).alias("temp_name"))


def output_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").selectExpr("page_id", "url", "'/data/report.' || CAST(page_id AS STRING) || '.txt' AS path")
    return rows.select("page_id", formats.output_filename(F.col("url"), "json").alias("of_url"), formats.output_filename(F.col("path"), "stix").alias("of_file"))


def table_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").selectExpr("n_nationkey", "array(array(n_name, NULL, CAST(n_regionkey AS STRING)), array('', NULL), array(n_name)) AS rows")
    return rows.select("n_nationkey", sources.table_text(F.col("rows")).alias("text"))


def warning_lists(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LISTS, W.SCHEMA)


def iocs(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "customer").createOrReplaceTempView("indicant_customer")
    return spark.sql(IOCS.replace("FROM customer", "FROM indicant_customer"))


def stage(number: int) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        lists, values = warning_lists(spark), W.prepared(iocs(spark, sf_dir))
        by_type = W.relevant(W.metadata(lists))
        pairs = W.pairs_frame(spark, [(t, m) for t, own in by_type.items() for m in own])
        if number == 0:
            hits = W.string_hits(values, lists, pairs)
        elif number == 1:
            hits = W.regex_hits(values, W.valid_regexes(lists), by_type)
        elif number == 2:
            hits = W.cidr_hits(values, W.networks(lists), pairs)
        else:
            hits = W.substring_stage(values, lists)
        return hits.select("ioc_type", "value", "warning_list").distinct()

    return query


def wl_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.classify(iocs(spark, sf_dir), warning_lists(spark)).select("ioc_type", "value", "is_warning", "warning_list", "description")


def wl_warnings_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.warnings_only(iocs(spark, sf_dir), warning_lists(spark)).groupBy("ioc_type", "warning_list").agg(F.count("*").alias("n"))


def wl_email_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.dropped_emails(iocs(spark, sf_dir), warning_lists(spark))


def region_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of networks for each region, one network a nation."""
    nations = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.concat(F.lit("10."), F.lpad(F.col("n_nationkey").cast("string"), 2, "1"), F.lit(".0.0/16")))).alias("list"))
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    name = F.concat("r_name", F.lit(" IP ranges"))
    return nations.join(regions, "n_regionkey").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("list_id"), name.alias("name"), F.lit("").alias("description"), F.lit("cidr").alias("type"), F.array(F.lit("ip-src")).alias("matching_attributes"), "list")


def wl_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.categories(region_lists(spark, sf_dir))


def wl_diagnose(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = W.diagnose("10.17.3[.]8", "ips", region_lists(spark, sf_dir), ["ranges"])
    return report.select("list_id", "name", "type", "n_values", "matched", F.array_join("sample", ",").alias("sample"))


def list_fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three fetches of a list for each nation: some cut short, some without content or a list, some after the moment that is asked for."""
    raw = F.to_json(F.struct(F.concat("n_name", F.lit(" v"), F.col("v").cast("string")).alias("name"), F.array(F.lit("domain")).alias("matching_attributes"), F.array_repeat(F.lower("n_name"), F.col("v") + 1).alias("list")))
    key, v = F.col("n_nationkey"), F.col("v")
    broken = F.when((v == 1) & (key % 3 == 0), F.left(raw, F.lit(20))).when((v == 2) & (key % 4 == 0), "").when((v == 0) & (key % 6 == 1), '{"name": "no list"}').when((v == 2) & (key % 7 == 2), F.lit(None)).otherwise(raw)
    at = F.element_at(F.array(F.lit("2024-01-01"), F.lit("2024-01-31 13:00"), F.when(key % 5 == 0, "2024-03-01").otherwise("2024-02-01")), v + 1)
    rows = table(spark, sf_dir, "nation").select("*", F.explode(F.array(*map(F.lit, range(3)))).alias("v"))
    return rows.select(F.concat(F.lit("n"), key.cast("string")).alias("list_id"), at.cast("timestamp").alias("fetched_at"), broken.alias("raw"))


def wl_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last good version of each list at noon of 1 February, and whether it is stale."""
    lists = snapshots.as_of(list_fetches(spark, sf_dir), F.lit("2024-02-01 12:00:00").cast("timestamp"))
    return lists.select("list_id", "name", F.size("list").cast("long").alias("n_values"), F.date_format("fetched_at", "yyyy-MM-dd").alias("fetched"), "stale", "n_passed")


def wl_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.quarantine(list_fetches(spark, sf_dir)).select("list_id", F.date_format("fetched_at", "yyyy-MM-dd").alias("fetched"), "problem", F.length("raw").cast("long").alias("n_chars"))


def wl_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every list that holds a value, which of them wins, and the values that none holds."""
    return W.explain(iocs(spark, sf_dir), warning_lists(spark)).select("ioc_type", "value", "stage", "warning_list", "wins", "is_warning")


BASE = ("emails", "asn", "cves")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_value, o_orderkey, ioc_type, value) of three types, by customer and order."""
    return extract_all(reports(spark, sf_dir, *BASE), keys=["source_value", "o_orderkey"], types=list(BASE))


def dedup_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.ordered_distinct(base(spark, sf_dir), "o_orderkey").select("ioc_type", "value", "o_orderkey")


def dedup_incremental_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base(spark, sf_dir)
    odd = F.col("source_value").cast("long") % 2 == 1
    return dedup.unseen(rows.filter(odd), rows.filter(~odd))


def multi_source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base(spark, sf_dir)
    odd = F.col("source_value").cast("long") % 2 == 1
    return dedup.union_of_sources([rows.filter(odd), rows.filter(~odd)])


def counts_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts_by_type(base(spark, sf_dir), total=True)


def as_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """base, with CVEs of even years on a warning list."""
    warned = (F.col("ioc_type") == "cves") & F.col("value").rlike("(?i)^cve-20[0-9][02468]")
    # Two keys an order are moved instead of what is found in its text; all steps by source then stay in their tasks.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = reports(spark, sf_dir, *BASE, parts=parts)
    rows = extract_all(texts, keys=["source_value"], types=list(BASE)).distinct()
    return rows.select("*", warned.alias("is_warning"), F.when(warned, "Even 'years'").alias("warning_list"), F.when(warned, "").alias("description"))


def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.json_rows(as_classified(spark, sf_dir))


def text_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.text_reports(as_classified(spark, sf_dir))


def stix_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.stix_indicators(as_classified(spark, sf_dir))


def stix_bundle_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    bundles = formats.stix_bundles(as_classified(spark, sf_dir), "2024-01-01T00:00:00.000Z")
    return bundles.select("source_value", F.expr("size(from_json(bundle, 'objects array<struct<pattern:string>>').objects)").cast("long").alias("n_objects"))


def written_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text file for each source, written line by line and read back."""
    where = shared_folder(spark, "reports")
    names = sink.write_reports(written(as_classified(spark, sf_dir), "reports-iocs"), where)
    return sink.read_reports(names, where)


def command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each nation through the command line, and the JSON reports that it writes."""
    import contextlib
    import io

    from ..__main__ import main

    where = shared_folder(spark, "command-line")
    spark.dataSource.register(sink.NamedFiles)
    lines = table(spark, sf_dir, "nation").selectExpr("CAST(n_nationkey AS STRING) || '.txt' AS file", "'from 10.' || CAST(n_nationkey AS STRING) || '.3.4 to u' || CAST(n_nationkey AS STRING) || '@mail.org or CVE-2024-1234' AS line")
    lines.repartition(4, "file").sortWithinPartitions("file").write.format("named_files").option("path", f"{where}/in").mode("append").save()
    with contextlib.redirect_stdout(io.StringIO()):
        main([f"{where}/in", "--format", "json", "--types", "ips,emails", "--output", f"{where}/out"])
    reports = spark.read.schema("ips array<string>, emails array<string>, cves array<string>").option("multiLine", True).json(f"{where}/out")
    return reports.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.array_join("ips", ",").alias("ips"), F.array_join("emails", ",").alias("emails"), F.coalesce(F.array_join("cves", ","), F.lit("none")).alias("cves"))


def persist_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources after two runs: all orders' customers, then those of open orders."""
    orders = table(spark, sf_dir, "orders")
    seen = lambda df: df.select(F.lit("file").alias("kind"), F.col("o_custkey").cast("string").alias("value"))
    db, none = store.Store(spark, shared_folder(spark, "sources")), spark.createDataFrame([], CLASSIFIED)
    db.persist(none, NOW, sources=seen(orders))
    db.persist(none, LATER, sources=seen(orders.filter("o_orderkey % 3 = 0")))
    return db.sources().select("kind", "value", F.date_format("first_seen", "yyyy-MM-dd").alias("first_seen"), F.date_format("last_seen", "yyyy-MM-dd").alias("last_seen"))


def persist_iocs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """iocs that a second run adds: what odd customers have and even ones lack."""
    rows = as_classified(spark, sf_dir)
    odd = F.col("source_value").cast("long") % 2 == 1
    return store.new_iocs(store.ioc_rows(rows.filter(~odd)), store.ioc_rows(rows.filter(odd))).drop("id")


def persist_run_iocs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every run with its indicators, read back as counts by source."""
    rows = written(as_classified(spark, sf_dir).withColumn("kind", F.lit("file")), "run-iocs")  # four steps read it
    now = F.lit(NOW).cast("timestamp")
    runs = store.run_rows(rows.select("kind", F.col("source_value").alias("value")), now, "1.0", store.Options()).withColumnRenamed("id", "run_id")
    own = rows.select("kind", "source_value").distinct().select(store.source_id("kind", "source_value").alias("source_id"), "source_value")
    links = store.link_rows(rows, now, distinct=True).select("run_id", "ioc_id").join(store.ioc_rows(rows).select(F.col("id").alias("ioc_id"), "is_warning"), "ioc_id")
    counted = links.groupBy("run_id").agg(F.count("*").alias("n"), F.count_if("is_warning").alias("w"))
    joined = runs.select("run_id", "source_id").join(own, "source_id").join(counted, "run_id")
    return joined.groupBy("source_value").agg(F.sum("n").alias("n_iocs"), F.sum("w").alias("n_warnings"))


def shared_iocs_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty indicators with most sources."""
    counts = base(spark, sf_dir).groupBy("ioc_type", "value").agg(F.countDistinct("source_value").alias("n_sources"))
    return counts.orderBy(F.desc("n_sources"), "ioc_type", "value").limit(20)


def chunked_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunks.extract_chunked(docs, keys=["doc_id"], types=["emails", "ips", "sha1"], size=1 << 20)


def chunk_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    parts = chunks.chunked(docs, size=1000, overlap=100)
    return parts.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"))


def stream_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a file stream, each indicator once for its document."""
    where = shared_folder(spark, "stream")
    source = stream.stream_parquet(spark, f"{sf_dir}/documents.parquet", "doc_id bigint, text string")
    found = stream.extract_stream(source, ["doc_id"], types=["emails", "ips", "sha1"])
    stream.run_available(found, f"{where}/out", f"{where}/checkpoint")
    return spark.read.schema("doc_id bigint, ioc_type string, value string").parquet(f"{where}/out")


def extract_page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators of the visible texts of the pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", sources.html_to_text(F.col("html")).alias("text"))
    return extract_all(pages, types=["emails", "ips", "sha1"])


def extract_url_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains that only the host of a URL shows: a label that ends with a hyphen, a port."""
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "'see http://c2-.evil' || CAST(o_orderkey % 50 AS STRING) || '.com:8080/x.' AS text")
    return extract_all(rows, types=["domains"])


def tickets() -> dict[str, Callable]:
    """A registry with a type of one's own, with a check of its values."""
    return {"ticket": extractor(Pattern(r"\b(TCK-[0-9]+)\b", (1,), "TCK-"), lambda v: F.length(v) > 5)}


def extract_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "'TCK-' || CAST(o_orderkey AS STRING) || ' and TCK-x' AS text")
    return extract_all(rows, registry=tickets())


def registered_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type in warning lists, report sections and STIX patterns."""
    rows = table(spark, sf_dir, "nation").selectExpr("n_name AS source_value", "'TCK-' || CAST(100 + n_nationkey AS STRING) || ' TCK-7' AS text")
    lists = spark.createDataFrame([("o", "Old tickets", "", "regex", ["other"], ["^TCK-1[01]"])], W.SCHEMA)
    found = W.classify(extract_all(rows, keys=["source_value"], registry=tickets()), lists)
    reports = formats.text_reports(found, titles={"ticket": "Tickets"})
    patterns = formats.stix_indicators(found, patterns={"ticket": "[x-ticket:value = '{value}']"})
    return reports.join(patterns.select("source_value", "pattern", "is_warning"), "source_value")


HARD_HTML = {
    "decimal, hexadecimal and named": ("<p>a&#x27;b &eacute;&rsquo; ' || S || '&#128512;&#x1F600; &fjlig;</p>", "a''b é’ ' || S || '😀😀 fj"),
    "unknown and unfinished": ("x &nosuch; &amp;lt; ' || S || ' &amp y", "x &nosuch; &lt; ' || S || ' & y"),
    "names without semicolon": ("&copy 2024 &notit; &notin; &ampamp &copy' || S || ' &eacutex&", "© 2024 ¬it; ∉ &amp ©' || S || ' éx&"),
    "quoted ends of tags": ("<a title=\"x>y http://leak.example.org\" b = ''>''>c' || S || '</a> d<br alt=\"never closed>e <i don''t>it''s</i>", "c' || S || ' d e it''s"),
    "script in a comment, comment in a script": ("a<!-- <script> -->b' || S || '<script data-x=\">\">x = \"<!--\"</script>c", "a b' || S || ' c"),
    "script never closed": ("<b>k' || S || '</b><script>var u = \"http://leak.example.org\";", "k' || S || '"),
    "comment never closed": ("t' || S || ' <!-- gone <i>x</i>", "t' || S || '"),
    "Windows-1252 and no characters": ("&#150;&#x80;' || S || '&#0;&#xD800;", "–€' || S || '��"),
    "tags as spaces": ("<ul><li>a<li>b' || S || '</ul><style>p{}</style>c<br/>d", "a b' || S || ' c d"),
}


def html_hard_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{cased([f"'{h}'" for h, _ in HARD_HTML.values()], 'o_orderkey')} AS html")
    return pages.select("o_orderkey", sources.html_to_text(F.col("html")).alias("text"))


def wl_regex_backrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns that refer to their groups or give them the same names, beside broken and plain ones."""
    own = [
        ("a", "Doubled", "", "regex", ["domain"], [r"^(zz)\.", r"^(..)\1\.", "(broken"]),
        ("b", "Named", "", "regex", ["domain"], [r"^(?P<a>pq)(?P=a)x", r"^(?P<a>rs)-(?P=a)\."]),
    ]
    word = "CASE c_custkey % 6 WHEN 0 THEN 'abab' WHEN 1 THEN 'abac' WHEN 2 THEN 'zz' WHEN 3 THEN 'pqpqx' WHEN 4 THEN 'rs-rs' ELSE 'rs-pq' END"
    rows = table(spark, sf_dir, "customer").selectExpr("'domains' AS ioc_type", f"{word} || '.org' || CAST(c_custkey AS STRING) AS value")
    return W.warnings_only(rows, spark.createDataFrame(own, W.SCHEMA)).select("value", "warning_list")


def wl_substring_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten thousand substrings against every customer's domain, either in the other."""
    entries = spark.range(10_000).agg(F.collect_list(F.concat(F.lit("-Vend"), F.col("id").cast("string"), F.lit(".co"))).alias("list"))
    lists = entries.select(F.lit("s").alias("list_id"), F.lit("Many").alias("name"), F.lit("").alias("description"), F.lit("substring").alias("type"), F.array(F.lit("domain")).alias("matching_attributes"), "list")
    rows = table(spark, sf_dir, "customer").selectExpr("'domains' AS ioc_type", "CASE WHEN c_custkey % 7 = 0 THEN 'vend' || CAST(c_custkey AS STRING) ELSE 'x-vend' || CAST(c_custkey * 17 % 20000 AS STRING) || '.com' END AS value")
    return W.warnings_only(rows, lists).select("value", "warning_list").distinct()


def one_list(entries: DataFrame, kind: str) -> DataFrame:
    """A list of domains of the entries (entry)."""
    return entries.agg(F.collect_list("entry").alias("list")).select(F.lit("m").alias("list_id"), F.lit("Many").alias("name"), F.lit("").alias("description"), F.lit(kind).alias("type"), F.array(F.lit("domain")).alias("matching_attributes"), "list")


SUFFIX_CASES = ["'a.cdn' || # || '.cloudfront.net'", "'x' || S || '.cloudfront.net'", "'cdn' || S", "'plain' || S || '.org'", "'cloudfront.net'", "'CDN' || S || '.cloudfront.net'"]
SUFFIX_SQL = cased(SUFFIX_CASES, "c_custkey").replace("#", "CAST(c_custkey * 37 % 20000 AS STRING)")


def wl_substring_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten thousand entries that all end alike against every customer's domain, many of which end so too."""
    lists = one_list(spark.range(10_000).selectExpr("'cdn' || CAST(id AS STRING) || '.cloudfront.net' AS entry"), "substring")
    rows = table(spark, sf_dir, "customer").selectExpr("'domains' AS ioc_type", f"{SUFFIX_SQL} AS value")
    return W.warnings_only(rows, lists).select("value", "warning_list").distinct()


SHOP_CASES = ["'shop' || # || 'x' || S || '.example.com'", "'www.shOP' || # || 'x.example.org'", "'myshop' || # || 'x.example.com'", "'shop' || # || 'x.example.net'", "'q' || S"]
SHOP_SQL = cased(SHOP_CASES, "c_custkey").replace("#", "CAST(c_custkey * 97 % 80000 AS STRING)")


def wl_regex_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty thousand regular expressions, a few of them without a text to look for, a few broken."""
    pattern = "CASE WHEN id % 10000 = 1 THEN '^[q]' || CAST(id AS STRING) || '$' WHEN id % 10000 = 2 THEN '(bad' ELSE '(?:^|[.])shop' || CAST(id AS STRING) || 'x[0-9]*[.]example[.](?:com|org)$' END"
    rows = table(spark, sf_dir, "customer").selectExpr("'domains' AS ioc_type", f"{SHOP_SQL} AS value")
    return W.warnings_only(rows, one_list(spark.range(50_000).selectExpr(f"{pattern} AS entry"), "regex")).select("value", "warning_list")


def chunked_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes across the borders of many small chunks, which overlap by more than a hash."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunks.extract_chunked(docs, keys=["doc_id"], types=["sha1"], size=150, overlap=60)


def chunked_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with chunks that look ahead."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return extract_all(chunks.chunked(docs, size=150, overlap=60, ahead=True).drop("chunk_no"), types=["sha1"]).distinct()


def warning_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..api import warning_lines as lines

    return lines(as_classified(spark, sf_dir))


def hashes_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").selectExpr("CASE WHEN n_nationkey % 3 > 0 THEN 'md5' END AS type", "CASE WHEN n_nationkey % 5 > 0 THEN md5(n_name) END AS value")
    return formats.hashes_section(rows)


def store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs written to a store, one of them twice, and read back: iocs and warnings by run."""
    db = store.Store(spark, shared_folder(spark, "store"))
    rows = as_classified(spark, sf_dir).withColumn("kind", F.lit("file"))
    odd = rows.filter("CAST(source_value AS BIGINT) % 2 = 1")
    for part, now in ((rows, NOW), (odd, LATER), (odd, LATER)):
        db.persist(part, now)
    per_run = db.counts_per_run(F.count("*").alias("n"), F.count_if("is_warning").alias("w"))
    return per_run.groupBy("source_value", F.date_format("started_at", "yyyy-MM-dd").alias("started")).agg(F.sum("n").alias("n_iocs"), F.sum("w").alias("n_warnings"))


def store_replaced_and_concurrent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run written twice, one that ended before it was published, two of one moment, two writers at once, and a compaction: runs and links by source, and in all."""
    from concurrent.futures import ThreadPoolExecutor

    where = shared_folder(spark, "store")
    as_classified(spark, sf_dir).withColumn("kind", F.lit("file")).write.parquet(f"{where}/classified")
    rows = spark.read.parquet(f"{where}/classified")
    db = store.Store(spark, f"{where}/db")
    number = F.col("source_value").cast("long")
    for _ in range(2):
        db.persist(rows, NOW, stored=True)
    db._write({"iocs": store.ioc_rows(rows.withColumn("value", F.concat("value", F.lit("x"))))})
    for kind in ("cves", "emails"):
        db.persist(rows.filter(F.col("ioc_type") == kind), LATER, stored=True)
    with ThreadPoolExecutor(2) as two:
        list(two.map(lambda part: store.Store(spark, f"{where}/db").persist(part, LATEST, stored=True), [rows.filter(number % 2 == 1), rows.filter(number % 3 == 0)]))
    db.compact()
    db.persist(rows, NOW, stored=True)
    db.vacuum(0)
    links, n_iocs = db.known_links()
    started = F.date_format("started_at", "yyyy-MM-dd").alias("started")
    runs = written(db.runs_of_sources().join(links.groupBy("run_id").agg(F.count("*").alias("n")), "run_id").select("run_id", "source_value", started, "n"), "store-runs")
    counted = runs.groupBy("source_value", "started").agg(F.count("*").alias("n_runs"), F.sum("n").alias("n_links"))
    groups = written(counted.withColumn("group", F.monotonically_increasing_id()), "store-groups")
    # A run has an ioc once; only where a source has several runs of a day can they share some.
    several = runs.join(groups.filter("n_runs > 1"), ["source_value", "started"]).select("run_id", "group")
    shared = links.join(several, "run_id").select("group", "ioc_id").distinct().groupBy("group").agg(F.count("*").alias("n"))
    each = groups.join(shared, "group", "left").select("source_value", "started", "n_runs", "n_links", F.coalesce("n", "n_links").alias("n_iocs"))
    total = groups.agg(F.sum("n_runs").alias("n_runs"), F.sum("n_links").alias("n_links")).withColumn("n_iocs", F.lit(n_iocs).cast("long"))
    return each.union(total.select(F.lit("all").alias("source_value"), F.lit("all").alias("started"), "n_runs", "n_links", "n_iocs"))


def nation_files(spark: SparkSession, sf_dir: str) -> list[str]:
    """A file for each nation, of several kinds, one of them large."""
    where = shared_folder(spark, "files")
    rows = table(spark, sf_dir, "nation").selectExpr("n_nationkey", "CASE WHEN n_nationkey = 3 THEN repeat('x', 5000) WHEN n_nationkey % 2 = 0 THEN n_name ELSE '<p>&lt;' || n_name || '</p><script>no' END AS value", "element_at(array('txt', 'html', 'log', 'htm', 'pdf', 'xml'), CAST(n_nationkey % 6 AS INT) + 1) AS ending")
    for ending in ("txt", "html", "log", "htm", "pdf", "xml"):
        rows.filter(F.col("ending") == ending).select("n_nationkey", "value").repartition(1, "n_nationkey").write.option("compression", "none").partitionBy("n_nationkey").mode("overwrite").text(f"{where}/{ending}")
    named = []
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(where)
    fs = root.getFileSystem(conf)
    for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{where}/*/n_nationkey=*/part-*")):  # a file for each nation
        path = status.getPath()
        ending = path.getParent().getParent().getName()
        target = jvm.org.apache.hadoop.fs.Path(f"{where}/{path.getParent().getName().rpartition('=')[2]}.{ending}")
        fs.rename(path, target)
        named.append(target.toString())
    return named


def nation_key() -> Column:
    return F.regexp_extract("source_value", "([0-9]+)[.][a-z]+$", 1).cast("long").alias("n_nationkey")


def read_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of several kinds written and read back by their detected type, one too large and one PDF without a parser."""
    found = sources.read_documents(spark, nation_files(spark, sf_dir), max_bytes=4000, strict=False)
    return found.select(nation_key(), F.rtrim("text", F.lit("\n")).alias("text"))


def no_vowels(content: bytes) -> str:
    """Stands for a PDF parser: it refuses what starts with a vowel."""
    if content[:1] in b"AEIOU":
        raise ValueError(f"bad header {content[:1].decode()}")
    return content.decode().strip()


def read_files_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files in one scan with a parser: each with its text, or the stage that refused it and why."""
    found = sources.read_all(spark, nation_files(spark, sf_dir), no_vowels, max_bytes=4000)
    return found.select(nation_key(), "kind", F.rtrim("text", F.lit("\n")).alias("text"), "stage", "error")




def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import ingest

    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {f"extract_{t}": extraction(t) for t in EXTRACTORS}
    out |= {n: stage(k) for k, n in enumerate(("wl_string_join", "wl_regex_join", "wl_cidr_join", "wl_substring_join"))}
    own = (
        extract_all_counts, extract_documents, extract_fanged, extract_wide_counts, extract_pages, hash_validity, domain_validity, defang_values,
        refang_values, html_to_text, detect_file_type, url_parts, output_filename, table_text, wl_classify, wl_warnings_only, wl_email_drop,
        wl_categories, wl_diagnose, wl_explain, wl_as_of, wl_quarantine, dedup_ordered, dedup_incremental_anti, multi_source_union, counts_with_total, json_rows, text_sections,
        stix_patterns, stix_bundle_sizes, written_reports, command_line, persist_sources, persist_iocs, persist_run_iocs, shared_iocs_topk, chunked_extract, chunk_sizes,
        stream_extract, extract_page_texts, extract_url_domains, extract_registered, registered_reports, html_hard_cases, wl_regex_backrefs, wl_substring_many,
        wl_substring_suffixes, wl_regex_many, chunked_small,
        chunked_ahead, warning_lines, hashes_section, store_round_trip, store_replaced_and_concurrent, read_files,
        read_files_once,
    )
    return out | {f.__name__: f for f in own} | ingest.queries()
