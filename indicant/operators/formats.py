"""Output formats of classified indicators, as columns.

Input rows: (source_value, ioc_type, value, is_warning, warning_list, description).
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lists as L
from ..functions import text as T
from ..functions.extractors import STIX_PATTERNS, TITLES


def with_warning_columns(iocs: DataFrame) -> DataFrame:
    """Indicators that were never classified are all normal."""
    missing = {"is_warning": F.lit(False), "warning_list": F.lit(None).cast("string"), "description": F.lit(None).cast("string")}
    return iocs.withColumns({c: v for c, v in missing.items() if c not in iocs.columns})


def json_rows(iocs: DataFrame, key: str = "source_value") -> DataFrame:
    """(key, json): types and values sorted; warnings under warning_list_matches."""
    rows = with_warning_columns(iocs)
    entry = F.to_json(F.struct(F.coalesce("description", F.lit("")).alias("description"), "value", F.coalesce("warning_list", F.lit("")).alias("warning_list")))
    one = rows.groupBy(key, "ioc_type").agg(
        F.sort_array(F.collect_set(F.when(~F.col("is_warning"), F.col("value")))).alias("normal"),
        F.sort_array(F.collect_list(F.when(F.col("is_warning"), entry))).alias("warned"),
    )
    quote = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    normal = F.when(F.size("normal") > 0, F.struct("ioc_type", F.concat(quote(F.col("ioc_type")), F.lit(":"), F.to_json("normal")).alias("text")))
    warned = F.when(F.size("warned") > 0, F.struct("ioc_type", F.concat(quote(F.col("ioc_type")), F.lit(":["), F.array_join("warned", ","), F.lit("]")).alias("text")))
    matches = F.lit("warning_list_matches")
    each = one.groupBy(key).agg(F.collect_list(normal).alias("n"), F.collect_list(warned).alias("w"))
    joined = lambda c: F.array_join(F.transform(F.sort_array(c), lambda x: x.text), ",")
    own = F.when(F.size("w") > 0, F.array(F.struct(matches.alias("ioc_type"), F.concat(F.lit('"warning_list_matches":{'), joined(F.col("w")), F.lit("}")).alias("text"))))
    return each.select(key, F.concat(F.lit("{"), joined(F.concat("n", F.coalesce(own, F.array().cast("array<struct<ioc_type:string,text:string>>")))), F.lit("}")).alias("json"))


def pretty(document: str, ascii_only: bool = False) -> str:
    """A JSON row as the indented document that is printed (ascii_only) or saved."""
    return json.dumps(json.loads(document), indent=4, sort_keys=True, ensure_ascii=ascii_only)


TITLE = "# Indicators of Compromise (IOCs) Extracted\n"
INTRO = "\n# Warning List Matches\n\nThe following indicators were found in warning lists and might be false positives:\n"


#: Columns of indicators besides their source.
IOC_COLUMNS = ["ioc_type", "value", "is_warning", "warning_list", "description"]


def section_rows(iocs: DataFrame, key: str, titles: dict[str, str] | None, more: list[str] | None = None) -> tuple[DataFrame, Callable[[Column], Column], Callable[[Column], Column]]:
    """(key, more..., part, pos, value, note) of the indicators that a report shows, and what makes lines of them.

    part is null for one that is neither normal nor a warning, note for one whose line is its
    value.  The first function gives a row's own line, the second the lines above it.
    """
    sections = [*L.SECTIONS, *(TITLES | (titles or {})).items()]
    places = F.create_map(*[x for k, (t, _) in enumerate(sections) for x in (F.lit(t), F.lit(k))])
    names = F.array(*[F.lit(name) for _, name in sections])
    rows = with_warning_columns(iocs).filter(F.col("ioc_type").isin([t for t, _ in sections]))
    warned = F.col("is_warning")
    note = F.concat(F.col("value"), F.lit(" - *"), F.coalesce("warning_list", F.lit("Unknown list")), F.lit("*"), F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit("\n  Description: "), F.col("description"))).otherwise(""))
    yara = F.when(F.col("ioc_type") == "yara", F.concat(F.lit("```\n"), F.col("value"), F.lit("\n```\n")))
    part = F.when(warned, 3).when(~warned, 1)
    rows = rows.select(key, *(more or []), part.alias("part"), F.element_at(places, F.col("ioc_type")).alias("pos"), "value", F.when(warned, note).otherwise(yara).alias("note"))
    line = lambda part, pos, rank, text: F.struct(part.alias("part"), pos.alias("pos"), rank.alias("rank"), text.alias("line"))
    none, above = F.lit(""), F.lit(-1)
    own = lambda r: line(r["part"], r["pos"], F.concat(F.lit("v"), r["value"]), F.coalesce(r["note"], r["value"]))
    head = lambda r: line(r["part"], r["pos"], none, F.concat(F.lit("\n## "), F.get(names, r["pos"]), F.when(r["part"] == 3, " in Warning Lists\n").otherwise("\n")))
    first, intro = line(F.lit(0), above, none, F.lit(TITLE)), line(F.lit(2), above, none, F.lit(INTRO))
    heads = lambda r: F.when(r["part"] == 3, F.array(first, intro, head(r))).when(r["part"] == 1, F.array(first, head(r))).otherwise(F.array(first))
    return rows, own, heads


def section_lines(iocs: DataFrame, key: str = "source_value", titles: dict[str, str] | None = None) -> DataFrame:
    """(key, part, pos, rank, line): the lines of the text report with the order they go in.

    Registered types, and those of ``titles``, have sections behind the library's; other types have none.
    part 0 is the title, 1 the sections, 2 the warnings' title, 3 the warnings' sections.
    iocs are read twice.
    """
    rows, own, heads = section_rows(iocs, key, titles)
    row = F.struct("part", "pos", "value", "note")
    kinds = rows.select(key, "part", "pos").distinct().select(key, F.explode(heads(F.struct("part", "pos"))).alias("l")).distinct()
    return kinds.select(key, "l.*").unionByName(rows.filter("part IS NOT NULL").select(key, own(row).alias("l")).select(key, "l.*"))


def report_texts(iocs: DataFrame, key: str = "source_value", titles: dict[str, str] | None = None) -> DataFrame:
    """iocs' rows (..., line) in the order of section_lines, each line with those that stand above it for the first time in its report.

    iocs are read once; a source's rows are sorted together and what spills is kept on disk.  Columns besides stay.
    """
    rows, own, heads = section_rows(iocs, key, titles, [c for c in iocs.columns if c not in IOC_COLUMNS + [key]])
    l = own(F.struct("part", "pos", "value", "note"))  # noqa: E741
    rows = rows.withColumns({"rank": l["rank"], "line": l["line"]})
    order = Window.partitionBy(key).orderBy("part", "pos", "rank", "line")
    rows = rows.withColumns({"__before": F.lag(F.struct("part", "pos")).over(order), "__heads": heads(F.struct("part", "pos"))})
    head, intro = F.element_at("__heads", -1)["line"], F.get("__heads", F.lit(1))["line"]
    first, before = F.col("__before").isNull(), F.col("__before.part")
    new = F.col("part").isNotNull() & (first | ~(F.col("__before") == F.struct("part", "pos")))
    warned = new & (F.col("part") == 3) & (first | (F.coalesce(before, F.lit(0)) < 3))
    text = F.concat_ws("\n", F.when(first, F.lit(TITLE)), F.when(warned, intro), F.when(new, head), F.when(F.col("part").isNotNull(), F.col("line")))
    shown = rows.filter(first | new | (F.col("part").isNotNull() & F.col("line").isNotNull()))
    return shown.withColumn("line", text).drop("__before", "__heads", "part", "pos", "rank", "value", "note")


def text_reports(iocs: DataFrame, key: str = "source_value", titles: dict[str, str] | None = None) -> DataFrame:
    """(key, report): one text document a source, for sources of a size to print; sink.write_reports streams any.

    iocs are read once: a source's rows are gathered and become lines there.
    """
    rows, own, heads = section_rows(iocs, key, titles)
    gathered = rows.groupBy(key).agg(F.collect_list(F.struct("part", "pos", "value", "note")).alias("r"))
    kinds = F.array_distinct(F.transform("r", lambda r: F.struct(r["part"].alias("part"), r["pos"].alias("pos"))))
    shown = F.transform(F.filter("r", lambda r: r["part"].isNotNull()), own)
    ordered = F.sort_array(F.concat(F.array_distinct(F.flatten(F.transform(kinds, heads))), shown))
    return gathered.select(key, F.array_join(F.transform(ordered, lambda x: x.line), "\n").alias("report"))


def hashes_section(hashes: DataFrame) -> DataFrame:
    """Legacy hash entries (type, value): by type, unknown without one, then value."""
    return hashes.select(F.coalesce("type", F.lit("unknown")).alias("type"), F.coalesce("value", F.lit("")).alias("value")).orderBy("type", "value")


def stix_pattern(ioc_type: Column, value: Column, patterns: dict[str, str] | None = None) -> Column:
    """STIX 2.1 pattern of an indicator, registered types and those of ``patterns`` included; null for types without one."""
    clean = F.replace(F.replace(T.refang(value), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    ends = {t: template.split("{value}") for t, template in (L.STIX | STIX_PATTERNS | (patterns or {})).items()}
    side = lambda k: F.try_element_at(F.create_map(*[F.lit(x) for t, two in ends.items() for x in (t, two[k])]), ioc_type)
    return F.concat(side(0), clean, side(1))


def stix_indicators(iocs: DataFrame, key: str = "source_value", patterns: dict[str, str] | None = None) -> DataFrame:
    """One row per (key, pattern), normal indicators before warnings: pattern, name, warning columns."""
    known = F.col("ioc_type").isin([*L.STIX, *STIX_PATTERNS, *(patterns or {})])
    rows = with_warning_columns(iocs).filter(known & (F.col("value") != "")).withColumn("pattern", stix_pattern(F.col("ioc_type"), F.col("value"), patterns))
    pick = F.min(F.struct("is_warning", "ioc_type", F.coalesce("warning_list", F.lit("")).alias("warning_list"), F.coalesce("description", F.lit("")).alias("description")))
    return rows.groupBy(key, "pattern").agg(pick.alias("p")).select(key, "pattern", F.concat("p.ioc_type", F.lit(" indicator")).alias("name"), "p.is_warning", "p.warning_list", "p.description")


def stix_uuid(c: Column) -> Column:
    """A text's digest in the form of a version 5 UUID."""
    part = lambda h, at, n: F.substr(h, F.lit(at), F.lit(n))
    return T.let(F.sha2(c, 256), lambda h: F.concat(part(h, 1, 8), F.lit("-"), part(h, 9, 4), F.lit("-5"), part(h, 14, 3), F.lit("-8"), part(h, 18, 3), F.lit("-"), part(h, 21, 12)))


def stix_objects(iocs: DataFrame, valid_from: str, key: str = "source_value") -> DataFrame:
    """(key, is_warning, pattern, json): STIX indicators as JSON objects.  Ids derive from what they name, so a rerun gives the same."""
    warned = F.col("is_warning")
    indicator = F.to_json(F.struct(
        F.lit("indicator").alias("type"), F.lit("2.1").alias("spec_version"), F.concat(F.lit("indicator--"), stix_uuid(F.col("pattern"))).alias("id"),
        F.lit(valid_from).alias("created"), F.lit(valid_from).alias("modified"), "name", F.array(F.lit("unknown")).alias("indicator_types"), "pattern",
        F.lit("stix").alias("pattern_type"), F.lit("2.1").alias("pattern_version"), F.lit(valid_from).alias("valid_from"),
        F.when(warned, F.col("warning_list")).alias("x_warning_list"), F.when(warned & (F.col("description") != ""), F.col("description")).alias("x_warning_description"),
    ))
    return stix_indicators(iocs, key).select(key, "is_warning", "pattern", indicator.alias("json"))


def stix_bundles(iocs: DataFrame, valid_from: str, key: str = "source_value") -> DataFrame:
    """(key, bundle): STIX bundles as JSON, for sources of a size to print; sink.write_reports streams any."""
    grouped = stix_objects(iocs, valid_from, key).select(key, F.struct("is_warning", "pattern", "json").alias("i")).groupBy(key).agg(F.sort_array(F.collect_list("i")).alias("i"))
    bundles = grouped.select(key, F.array_join(F.transform("i", lambda x: x.json), ",").alias("objects"))
    return bundles.select(key, F.concat(F.lit('{"type":"bundle","id":"bundle--'), stix_uuid(F.concat_ws("|", F.col(key).cast("string"), "objects")), F.lit('","objects":['), F.col("objects"), F.lit("]}")).alias("bundle"))


def write_text(df: DataFrame, column: str, path: str) -> None:
    """Save one text column, a document a line group, to a folder."""
    df.select(column).write.mode("overwrite").text(path)


EXT = {"text": ".txt", "json": ".json", "stix": ".stix.json"}


def output_filename(source: Column, fmt: str = "text") -> Column:
    """Name of a source's output: host and last path part of URLs, the stem of files, 50 characters at most."""
    url = source.rlike("^https?://")
    path = T.url_path(source)
    last = F.element_at(F.split(F.regexp_replace(path, "^/+|/+$", ""), "/"), -1)
    named = F.concat(T.url_host(source), F.when((path != "") & (path != "/") & (last != ""), F.concat(F.lit("_"), last)).otherwise(""))
    base = F.element_at(F.split(F.regexp_replace(source, "/+$", ""), "/"), -1)
    stem = F.when(base.rlike(r"^.+\.[^.]+$"), F.regexp_replace(base, r"\.[^.]*$", "")).otherwise(base)
    name = F.when(url, F.regexp_replace(named, r"(?U)[^\w\-.]", "_")).otherwise(stem)
    return F.concat(F.left(name, F.lit(50)), F.lit(f"_iocs{EXT.get(fmt, '.txt')}"))
