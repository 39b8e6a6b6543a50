"""Classification of indicators against warning lists, as joins.

Lists come as rows (list_id, name, description, type, matching_attributes, list).  Their
metadata, with the size of each, is small and steers the plan from the driver.  Few regular
expressions and substrings become part of the projection, few strings and networks are sent to
the tasks; entries of longer lists stay distributed and are met by joins.
Checks run once for each distinct (type, value).  Stages: exact string, regular expression,
CIDR, substring; the first stage wins, within a stage the smallest list rank (by list id).
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lists as L
from ..functions import literals
from ..functions import text as T
from ..functions.extractors import EXTRACTORS
from ..storage import written
from .containment import GRAM, SENT_PIECES, Pieces

SCHEMA = "list_id string, name string, description string, type string, matching_attributes array<string>, list array<string>"
#: Regular expressions of one alternation.
ALTERNATION = 200
#: Up to so many regular expressions, substrings and characters of substrings are part of the projection; keys that are sent.
REGEX_IN_PLAN, SUBSTRINGS_IN_PLAN, CHARS_IN_PLAN, SENT_KEYS = 1000, 200, 1 << 14, 500_000
#: Stands for the types that no extractor gives: all lists are theirs.
OTHER = "*"


def known_types() -> list[str]:
    """The types of the registry, registered ones included, when a plan is made."""
    return [*EXTRACTORS, "imphash"]


def kind() -> Column:
    """A row's type as the lists know it."""
    return F.when(F.col("ioc_type").isin(known_types()), F.col("ioc_type")).otherwise(OTHER)


def load_lists(spark: SparkSession, path: str) -> DataFrame:
    """Lists from a folder of JSON files, one list each; the file's folder names the list."""
    raw = spark.read.schema("name string, description string, type string, matching_attributes array<string>, list array<string>").option("multiLine", True).json(path)
    return raw.withColumn("list_id", F.element_at(F.split(F.input_file_name(), "/"), -2)).select(*[f.split()[0] for f in SCHEMA.split(", ")])


def fresh(lists: DataFrame, fetched_col: str, now: Column, hours: int = 24) -> DataFrame:
    """Lists whose cached copy is younger than ``hours``."""
    return lists.filter(F.col(fetched_col) > now - F.expr(f"INTERVAL {int(hours)} HOURS"))


@dataclass(frozen=True)
class Meta:
    list_id: str
    rank: int
    name: str
    description: str
    type: str
    attributes: tuple[str, ...]
    entries: int = 0
    chars: int = 0


def metadata(lists: DataFrame) -> list[Meta]:
    """One entry a list, ranked by id, with its size; a missing name is the id, a missing description empty."""
    size = F.coalesce(F.size("list"), F.lit(0)).alias("entries")
    chars = F.coalesce(F.aggregate("list", F.lit(0).cast("bigint"), lambda n, e: n + F.coalesce(F.length(e), F.lit(0))), F.lit(0)).alias("chars")
    rows = lists.select("list_id", "name", "description", F.coalesce("type", F.lit("string")).alias("type"), "matching_attributes", size, chars).collect()
    return [
        Meta(r.list_id, k, r.name if r.name is not None else r.list_id, r.description or "", r.type, tuple(a for a in r.matching_attributes or [] if a is not None), max(r.entries, 0), r.chars)
        for k, r in enumerate(sorted(rows, key=lambda r: r.list_id))
    ]


def relevant(meta: list[Meta]) -> dict[str, list[Meta]]:
    """Lists by indicator type: those whose attributes name it, or all where none does."""
    named = {t: [m for m in meta if any(k in a.lower() for a in m.attributes for k, kt in L.ATTRIBUTE_TYPES.items() if kt == t)] for t in known_types()}
    return {t: own or meta for t, own in named.items()} | {OTHER: meta}


def applicable(m: Meta, ioc_type: str) -> bool:
    """Whether a substring list's attributes overlap the type's attribute names, either way round."""
    names = [n.format(type=ioc_type) for n in L.TYPE_ATTRIBUTES.get(ioc_type, L.OTHER_ATTRIBUTES)]
    return any(n.lower() in a.lower() or a.lower() in n.lower() for n in names for a in m.attributes)


def pairs_frame(spark: SparkSession, pairs: list[tuple[str, Meta]]) -> DataFrame:
    """(kind, list_id, list_rank, warning_list, description): what the metadata says, so its size is that of the lists' number."""
    rows = [(t, m.list_id, m.rank, m.name, m.description) for t, m in pairs]
    return spark.createDataFrame(rows, "kind string, list_id string, list_rank int, warning_list string, description string")


def entries(lists: DataFrame, kind: str) -> DataFrame:
    chosen = lists.filter(F.coalesce("type", F.lit("string")) == kind)
    return chosen.select("list_id", F.explode("list").alias("entry")).filter("entry IS NOT NULL")


def prepared(iocs: DataFrame) -> DataFrame:
    """Distinct (ioc_type, value) with what is checked: the refanged value and, for URLs, its host."""
    host = lambda c: T.let(T.without_port(T.url_host(c)), lambda h: F.when(h != "", h))
    rows = iocs.select("ioc_type", "value").filter("value IS NOT NULL").distinct()
    both = T.let(T.refang(F.col("value")), lambda c: F.struct(c.alias("clean"), F.when(F.col("ioc_type") == "urls", host(c)).alias("host")))
    # A generator of one row, so that the stages below read the refanged value instead of working it out each time.
    return rows.select("ioc_type", "value", kind().alias("kind"), F.inline(F.array(both)))


HIT_TYPE = "struct<stage:int,which:int,list_rank:int,warning_list:string,description:string>"
HIT = ["ioc_type", "value", "stage", "which", "list_rank", "warning_list", "description"]


def string_table(lists: DataFrame, pairs: DataFrame) -> DataFrame:
    return entries(lists, "string").select("list_id", F.lower("entry").alias("key")).join(F.broadcast(pairs), "list_id")


def string_hits(values: DataFrame, lists: DataFrame, pairs: DataFrame) -> DataFrame:
    """Exact matches, a hash join on the lower-case value or host."""
    keys = F.array(F.struct(F.lit(0).alias("which"), F.lower("clean").alias("key")), F.struct(F.lit(1).alias("which"), F.lower("host").alias("key")))
    probe = values.select("ioc_type", "value", "kind", F.explode(keys).alias("k")).select("ioc_type", "value", "kind", "k.which", "k.key").filter("key IS NOT NULL")
    return probe.join(string_table(lists, pairs), ["kind", "key"]).withColumn("stage", F.lit(0)).select(*HIT)


def java_regex(pattern: str) -> str:
    """Named groups in Java's spelling; their names may hold letters and digits only."""
    named = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<g{m[1].replace('_', '')}>", pattern)
    return re.sub(r"\(\?P=(\w+)\)", lambda m: rf"\k<g{m[1].replace('_', '')}>", named)


def valid_regexes(lists: DataFrame) -> dict[str, list[str]]:
    """Patterns by list that compile; others are left out.  They become part of the plan, so all come to the driver."""
    spark = lists.sparkSession
    compile_ = spark._jvm.java.util.regex.Pattern.compile
    out: dict[str, list[str]] = {}
    for r in entries(lists, "regex").distinct().orderBy("list_id", "entry").toLocalIterator():
        try:
            compile_(java_regex(r.entry))
        except Exception:  # noqa: BLE001  an invalid pattern is skipped, whatever Java says of it
            continue
        out.setdefault(r.list_id, []).append(java_regex(r.entry))
    return out


def own_group_numbers(pattern: str) -> bool:
    """Whether a pattern refers to its groups or names them, so that it cannot stand beside others in one expression."""
    return re.search(r"\\(?:[1-9]|k)|\(\?<[a-zA-Z]|\\Q|\(\?[a-zA-Z-]+\)", pattern) is not None


def expressions(patterns: list[str]) -> list[str]:
    """The patterns as few expressions, each compiled once: alternations, and alone what cannot be joined."""
    alone = [p for p in patterns if own_group_numbers(p)]
    plain = [p for p in patterns if not own_group_numbers(p)]
    return [f"(?iu)(?:{p})" for p in alone] + ["(?iu)" + "|".join(f"(?:{p})" for p in plain[i : i + ALTERNATION]) for i in range(0, len(plain), ALTERNATION)]


def holds_any(c: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.rlike(e) for e in expressions(patterns)])


def best_of(checks: list[Column]) -> Column:
    """The best of some matches, null without one."""
    return F.array_min(F.array(F.lit(None).cast(HIT_TYPE), *checks))


def regex_checks(patterns: dict[str, list[str]], by_type: dict[str, list[Meta]]) -> list[Column]:
    """For each list its match, null without one, as part of the projection."""
    checks = []
    for m in {m.list_id: m for own in by_type.values() for m in own}.values():
        if m.list_id in patterns:
            types = [t for t, own in by_type.items() if m in own]
            own = patterns[m.list_id]
            found = F.col("kind").isin(types) & (holds_any(F.col("clean"), own) | F.coalesce(holds_any(F.col("host"), own), F.lit(False)))
            checks.append(F.when(found, hit_of(1, F.lit(0), F.lit(m.rank), F.lit(m.name), F.lit(m.description)).cast(HIT_TYPE)))
    return checks


def hit_of(stage: int | Column, which: Column, rank: Column, name: Column, description: Column) -> Column:
    return F.struct(F.lit(stage).alias("stage"), which.alias("which"), rank.alias("list_rank"), name.alias("warning_list"), description.alias("description"))


def regex_hits(values: DataFrame, patterns: dict[str, list[str]], by_type: dict[str, list[Meta]]) -> DataFrame:
    return values.select("ioc_type", "value", best_of(regex_checks(patterns, by_type)).alias("h")).filter("h IS NOT NULL").select("ioc_type", "value", "h.*").select(*HIT)


def bits(hexed: Column) -> Column:
    """Family digit and address bits of address_hex()."""
    chunk = lambda h, at: F.lpad(F.conv(F.substr(h, F.lit(at), F.lit(8)), 16, 2), 32, "0")
    return T.let(hexed, lambda h: F.when(h.startswith("4"), chunk(h, 2)).when(h.startswith("6"), F.concat(chunk(h, 2), chunk(h, 10), chunk(h, 18), chunk(h, 26))))


def networks(lists: DataFrame, exact: bool = False) -> DataFrame:
    """(list_id, family, len, prefix) of CIDR entries; host bits are allowed.  exact: bare addresses count too."""
    e = entries(lists, "cidr").withColumn("slash", F.contains("entry", F.lit("/")))
    e = e.filter("slash") if not exact else e
    hexed = T.address_hex(F.substring_index("entry", "/", 1))
    size = F.when(F.col("slash"), F.regexp_extract("entry", "/([0-9]{1,3})$", 1).try_cast("int")).otherwise(F.when(hexed.startswith("4"), 32).otherwise(128))
    rows = e.select("list_id", F.substr(hexed, F.lit(1), F.lit(1)).alias("family"), size.alias("len"), bits(hexed).alias("b"))
    good = F.col("len").between(0, F.when(F.col("family") == "4", 32).otherwise(128))
    return rows.filter(good).select("list_id", "family", "len", F.substr("b", F.lit(1), F.col("len")).alias("prefix")).distinct()


def cidr_hits(values: DataFrame, nets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Containment as a hash join: each address meets one prefix for every prefix length in use."""
    sizes = nets.groupBy("family").agg(F.array_sort(F.collect_set("len")).alias("sizes"))
    hexed = T.address_hex(F.col("clean"))
    probe = values.filter(F.col("ioc_type").isin("ips", "ipv6")).select("ioc_type", "value", F.substr(hexed, F.lit(1), F.lit(1)).alias("family"), bits(hexed).alias("b"))
    cut = probe.join(F.broadcast(sizes), "family").select("ioc_type", "value", "family", "b", F.explode("sizes").alias("len"))
    keyed = cut.select("ioc_type", "value", "family", "len", F.substr("b", F.lit(1), F.col("len")).alias("prefix"))
    found = keyed.join(nets.join(F.broadcast(pairs.withColumnRenamed("kind", "ioc_type")), "list_id"), ["ioc_type", "family", "len", "prefix"])
    return found.withColumns({"stage": F.lit(2), "which": F.lit(0)}).select(*HIT)


def low_sides(values: DataFrame, low=F.lower) -> DataFrame:
    """(ioc_type, value, kind, v): each value's texts to look into, itself and its host in lower case."""
    return values.select("ioc_type", "value", "kind", F.explode(F.array_distinct(F.array_compact(F.array(low("clean"), low("host"))))).alias("v"))


def substring_hits(values: DataFrame, lists: DataFrame, pairs: DataFrame, sent: bool = True) -> DataFrame:
    """Either contains the other, on the value or the host, lower case: (..., which 0).  An empty text is part of everything."""
    table = entries(lists, "substring").select("list_id", F.lower("entry").alias("e")).distinct()
    index = Pieces(table.select("e").distinct(), low_sides(values), sent=sent)
    met = index.in_texts().union(index.around_texts()).select("ioc_type", "value", "kind", "e")
    found = met.join(table, "e").join(F.broadcast(pairs), ["kind", "list_id"])
    return found.withColumns({"stage": F.lit(3), "which": F.lit(0)}).select(*HIT)


def substring_checks(texts: dict[str, list[str]], by_type: dict[str, list[Meta]]) -> list[Column]:
    """The same of few entries, as part of the projection: for each list its match, null without one."""
    checks = []
    for m in {m.list_id: m for own in by_type.values() for m in own}.values():
        if m.list_id in texts:
            own = texts[m.list_id]
            types = [t for t, ms in by_type.items() if m in ms and applicable(m, t)]
            every, one = F.lit("\n".join(own)), F.array(*map(F.lit, own))
            inside = lambda c: F.contains(every, c) & F.exists(one, lambda e: F.contains(e, c))  # noqa: E731,B023
            holds = lambda c: T.let(F.lower(c), lambda v: T.any_of(v, own) | inside(v))  # noqa: E731,B023
            found = F.col("kind").isin(types) & (holds(F.col("clean")) | F.coalesce(holds(F.col("host")), F.lit(False)))
            checks.append(F.when(found, hit_of(3, F.lit(0), F.lit(m.rank), F.lit(m.name), F.lit(m.description)).cast(HIT_TYPE)))
    return checks


def few_texts(lists: DataFrame) -> dict[str, list[str]]:
    """The substrings by list, for lists of a checked size."""
    out: dict[str, list[str]] = {}
    for r in entries(lists, "substring").select("list_id", F.lower("entry").alias("e")).distinct().orderBy("list_id", "e").collect():
        out.setdefault(r.list_id, []).append(r.e)
    return out


def substring_stage(values: DataFrame, lists: DataFrame) -> DataFrame:
    """The substring stage by itself, as matches takes it: few entries in one pass over the values, many joined by their pieces."""
    meta = metadata(lists)
    by_type, own = relevant(meta), [m for m in meta if m.type == "substring"]
    chars = sum(m.chars for m in own)
    fitting = [(t, m) for t, ms in by_type.items() for m in ms if m.type == "substring" and applicable(m, t)]
    if sum(m.entries for m in own) > SUBSTRINGS_IN_PLAN or chars > CHARS_IN_PLAN:
        return substring_hits(values, lists, pairs_frame(values.sparkSession, fitting), chars * GRAM <= SENT_PIECES)
    looked = values.filter(F.col("kind").isin(sorted({t for t, _ in fitting})))
    every = F.array(F.lit(None).cast(HIT_TYPE), *substring_checks(few_texts(lists), by_type))
    return looked.select("ioc_type", "value", F.inline(F.array_compact(every))).select(*HIT)


SHORTEST = 3


def regex_literals(lists: DataFrame) -> DataFrame:
    """(list_id, pattern, part, literal), stored: for each readable regular expression sets (part) of texts of which its matches hold one; without any, one row of nulls."""

    def factor(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            rows = []
            for list_id, pattern in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = literals.required(pattern, SHORTEST)
                if found is not None:
                    rows += [(list_id, pattern, k, text) for k, texts in enumerate(found) for text in texts] or [(list_id, pattern, None, None)]
            columns = list(zip(*rows)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.string()))], names=["list_id", "pattern", "part", "literal"])

    spread = entries(lists, "regex").distinct().repartition(lists.sparkSession.sparkContext.defaultParallelism)
    return written(spread.mapInArrow(factor, "list_id string, pattern string, part int, literal string"), "regex-literals")


@lru_cache(maxsize=100_000)
def compiled(pattern: str) -> re.Pattern | None:
    try:
        return re.compile(pattern, re.IGNORECASE)
    except (re.error, OverflowError, RecursionError):
        return None


def indexed_regex_hits(values: DataFrame, table: DataFrame, pairs: DataFrame) -> DataFrame:
    """Matches of the regular expressions in regex_literals' table: a pattern is tried on the values that hold one of its texts only.

    Of a pattern's sets the one whose texts fewest values hold is looked for.  Patterns stay
    data: the plan is the same for any number.
    """
    folded = lambda c: F.lower(F.translate(c, *literals.FOLDED))
    texts = table.filter("part IS NOT NULL")
    literal = texts.select(F.col("literal").alias("e")).distinct()
    chars = literal.agg(F.coalesce(F.sum(F.length("e")), F.lit(0)).alias("n")).first().n
    index = Pieces(literal, low_sides(values, folded), range(SHORTEST, GRAM + 1), chars * 2 <= SENT_PIECES)
    rated = texts.join(index.keys.withColumnRenamed("e", "literal"), "literal").groupBy("list_id", "pattern", "part").agg(F.sum("n_texts").alias("n"), F.sum("n_entries").alias("m"), F.collect_set(F.struct("g", F.col("literal").alias("e"))).alias("keys"))
    best = rated.groupBy("list_id", "pattern").agg(F.min_by("keys", F.struct("n", "m", "part")).alias("keys"))
    keys = best.select("list_id", "pattern", F.inline("keys"))
    candidates = index.met(keys).select("ioc_type", "value", "kind", "list_id", "pattern").distinct()
    both = candidates.join(F.broadcast(pairs), ["kind", "list_id"]).select("ioc_type", "value", "pattern", "list_rank", "warning_list", "description")
    tried = both.select("*", T.refang(F.col("value")).alias("clean"))
    tried = tried.select("*", F.when(F.col("ioc_type") == "urls", T.let(T.without_port(T.url_host(F.col("clean"))), lambda h: F.when(h != "", h))).alias("host"))

    def matched(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(k).to_pylist() for k in (b.schema.get_field_index(n) for n in ("pattern", "clean", "host"))))
            yield b.filter(pa.array([bool((p := compiled(pattern)) and (p.search(clean) or (host and p.search(host)))) for pattern, clean, host in rows], pa.bool_()))

    found = tried.mapInArrow(matched, tried.schema)
    return found.withColumns({"stage": F.lit(1), "which": F.lit(0)}).select(*HIT)


def key_index(lists: DataFrame, pairs: DataFrame, nets: DataFrame | None) -> DataFrame:
    """(kind, key, m): the list of every string and network, keyed for one hash join; a key of several lists has several rows."""
    chosen = lambda df, stage, key: df.select("kind", key.alias("key"), F.struct(F.lit(stage).alias("stage"), "list_rank", "warning_list", "description").alias("m"))
    table = chosen(string_table(lists, pairs), 0, F.concat(F.lit("s:"), F.col("key")))
    if nets is not None:
        table = table.unionByName(chosen(nets.join(F.broadcast(pairs), "list_id"), 2, F.concat_ws(":", F.lit("c"), "family", F.col("len").cast("string"), "prefix")))
    return table


def probe_keys(sizes: dict[str, list[int]]) -> Column:
    """(which, key) of a value: itself, its host and, for addresses, its prefixes of the lengths in use."""
    text = F.array(F.struct(F.lit(0).alias("which"), F.concat(F.lit("s:"), F.lower("clean")).alias("key")), F.struct(F.lit(1).alias("which"), F.concat(F.lit("s:"), F.lower("host")).alias("key")))
    if not any(sizes.values()):
        return text
    cut = lambda b, f, n: F.struct(F.lit(0).alias("which"), F.concat(F.lit(f"c:{f}:{n}:"), F.substr(b, F.lit(1), F.lit(n))).alias("key"))
    each = lambda h: T.let(bits(h), lambda b: F.when(h.startswith("4"), F.array(*[cut(b, "4", n) for n in sizes["4"]])).when(h.startswith("6"), F.array(*[cut(b, "6", n) for n in sizes["6"]])))
    none = F.array().cast("array<struct<which:int,key:string>>")
    return F.concat(text, F.when(F.col("ioc_type").isin("ips", "ipv6"), F.coalesce(T.let(T.address_hex(F.col("clean")), each), none)).otherwise(none))


class Stages:
    """How lists are looked through: which regular expressions and substrings the projection tries, and which are joined."""

    def __init__(self, spark: SparkSession, lists: DataFrame):
        self.spark, self.lists, self.meta = spark, lists, metadata(lists)
        self.by_type, self.kinds = relevant(self.meta), {m.type for m in self.meta}
        substrings, chars = self.total("entries", "substring"), self.total("chars", "substring")
        self.few = substrings <= SUBSTRINGS_IN_PLAN and chars <= CHARS_IN_PLAN
        self.many = self.total("entries", "regex") > REGEX_IN_PLAN
        self.table, shown = None, lists
        if self.many:
            self.table = regex_literals(lists)
            shown = self.table.filter("part IS NULL").select("list_id", F.lit("regex").alias("type"), F.array("pattern").alias("list"))
        self.checks = regex_checks(valid_regexes(shown) if "regex" in self.kinds else {}, self.by_type)
        self.checks += substring_checks(few_texts(lists), self.by_type) if self.few and substrings else []

    def total(self, what: str, *names: str) -> int:
        return sum(getattr(m, what) for m in self.meta if m.type in names)

    def every(self, chosen) -> DataFrame:
        return pairs_frame(self.spark, [(t, m) for t, own in self.by_type.items() for m in own if chosen(m, t)])

    def joined(self, values: DataFrame) -> list[DataFrame]:
        """Matches of the substrings and regular expressions that are too many for the projection."""
        out = []
        if not self.few:
            out.append(substring_hits(values, self.lists, self.every(lambda m, t: m.type == "substring" and applicable(m, t)), self.total("chars", "substring") * GRAM <= SENT_PIECES))
        if self.many:
            out.append(indexed_regex_hits(values, self.table, self.every(lambda m, t: m.type == "regex")))
        return out


def matches(iocs: DataFrame, lists: DataFrame) -> DataFrame:
    """(ioc_type, value, warning_list, description, stage) of each distinct value that some list holds.

    Few regular expressions and substrings are columns, many are joined by their pieces;
    strings and networks are one hash join over keys; then the best hit of each value.
    """
    spark, values = iocs.sparkSession, prepared(iocs)
    plan = Stages(spark, lists)
    kinds, every, total, inside = plan.kinds, plan.every, plan.total, plan.checks
    nets, sizes = None, {}
    if "cidr" in kinds:
        nets = networks(lists)
        used = nets.select("family", "len").distinct().collect()  # at most 33 + 129 prefix lengths
        sizes = {f: sorted(r.len for r in used if r.family == f) for f in "46"}
    rows = values.select("*", best_of(inside).alias("rx"))
    keyed = rows.select("ioc_type", "value", "kind", "rx", F.explode(probe_keys(sizes)).alias("k")).select("ioc_type", "value", "kind", "rx", "k.which", "k.key")
    keys = key_index(lists, every(lambda m, t: m.type in ("string", "cidr")), nets)
    small = total("entries", "string", "cidr") * len(plan.by_type) <= SENT_KEYS
    joined = keyed.join(F.broadcast(keys) if small else keys.groupBy("kind", "key").agg(F.min("m").alias("m")), ["kind", "key"], "left")
    equal = F.when(F.col("m").isNotNull(), F.struct("m.stage", "which", "m.list_rank", "m.warning_list", "m.description"))
    hits = joined.select("ioc_type", "value", F.array_min(F.array("rx", equal.cast(HIT_TYPE))).alias("h")).filter("h IS NOT NULL")
    for joined in plan.joined(values):
        hits = hits.union(joined.select("ioc_type", "value", hit_of(F.col("stage"), *map(F.col, HIT[3:])).cast(HIT_TYPE).alias("h")))
    best = hits.groupBy("ioc_type", "value").agg(F.min("h").alias("b"))
    return best.select("ioc_type", "value", "b.warning_list", "b.description", "b.stage")


def warnings_only(iocs: DataFrame, lists: DataFrame) -> DataFrame:
    """Rows of iocs that some list holds, with the list; no rule for e-mail domains."""
    return iocs.join(matches(iocs, lists).drop("stage"), ["ioc_type", "value"])


def email_domain() -> Column:
    return F.trim(F.substring_index(T.refang(F.col("value")), "@", -1))


def mail_domains(iocs: DataFrame) -> DataFrame:
    """(value, domain) of the distinct e-mails that have one."""
    mails = iocs.filter("ioc_type = 'emails'").select("value").distinct().filter(F.contains(T.refang(F.col("value")), F.lit("@")))
    return mails.withColumn("domain", email_domain()).filter("domain <> ''")


def dropped_emails(iocs: DataFrame, lists: DataFrame) -> DataFrame:
    """Distinct e-mail values whose domain is on a list: they appear in no output."""
    mails = mail_domains(iocs)
    listed = matches(mails.select(F.lit("domains").alias("ioc_type"), F.col("domain").alias("value")), lists)
    return mails.join(listed.select(F.col("value").alias("domain")), "domain", "left_semi").select(F.lit("emails").alias("ioc_type"), "value")


def classify(iocs: DataFrame, lists: DataFrame) -> DataFrame:
    """iocs with is_warning, warning_list and description; e-mails of listed domains are dropped.

    Each distinct value is checked as itself and, for an e-mail, by its domain; all checks
    go through the lists together.
    """
    values = iocs.select("ioc_type", "value").filter("value IS NOT NULL").distinct()
    clean_mail = (F.col("ioc_type") == "emails") & F.contains(T.refang(F.col("value")), F.lit("@"))
    own = F.struct(F.col("ioc_type").alias("t"), F.col("value").alias("v"), F.lit(False).alias("mail"))
    domain = F.when(clean_mail & (email_domain() != ""), F.struct(F.lit("domains").alias("t"), email_domain().alias("v"), F.lit(True).alias("mail")))
    checks = values.select("ioc_type", "value", F.explode(F.array_compact(F.array(own, domain))).alias("c")).select("ioc_type", "value", "c.t", "c.v", "c.mail")
    found = matches(checks.select(F.col("t").alias("ioc_type"), F.col("v").alias("value")), lists)
    hits = checks.join(found.select(F.col("ioc_type").alias("t"), F.col("value").alias("v"), "warning_list", "description"), ["t", "v"])
    verdict = hits.groupBy("ioc_type", "value").agg(F.max("mail").alias("__drop"), F.min(F.when(~F.col("mail"), F.struct("warning_list", "description"))).alias("__w"))
    out = iocs.join(verdict, ["ioc_type", "value"], "left").filter("NOT coalesce(__drop, false)")
    return out.select(*[c for c in iocs.columns], F.col("__w.warning_list").alias("warning_list"), F.col("__w.description").alias("description"), F.col("__w").isNotNull().alias("is_warning"))


def explain(iocs: DataFrame, lists: DataFrame) -> DataFrame:
    """(ioc_type, value, stage, list_id, warning_list, n_values, sample, wins, is_warning): why each distinct value is a warning or none.

    A row for every list that holds the value, at any stage, with the list's size and first
    three entries; the one that ``matches`` names wins.  A value that no list holds has one
    row without a list.  The rule that drops e-mails of listed domains is dropped_emails'.
    """
    spark, values = iocs.sparkSession, prepared(iocs)
    plan = Stages(spark, lists)
    every = plan.every(lambda m, t: True)
    hits = [string_hits(values, lists, every)]
    if plan.checks:
        hits.append(values.select("ioc_type", "value", F.inline(F.array_compact(F.array(*plan.checks)))).select(*HIT))
    if "cidr" in plan.kinds:
        hits.append(cidr_hits(values, networks(lists), every))
    found = reduce(DataFrame.union, [*hits, *plan.joined(values)]).groupBy("ioc_type", "value", "stage", "list_rank").agg(F.min("which").alias("which"))
    first = found.groupBy("ioc_type", "value").agg(F.min(F.struct("stage", "which", "list_rank")).alias("first"))
    ranks = spark.createDataFrame([(m.rank, m.list_id, m.name) for m in plan.meta], "list_rank int, list_id string, warning_list string")
    shown = lists.select("list_id", F.coalesce(F.size("list"), F.lit(0)).cast("long").alias("n_values"), F.slice("list", 1, 3).alias("sample"))
    named = found.join(first, ["ioc_type", "value"]).withColumn("wins", F.struct("stage", "which", "list_rank") == F.col("first"))
    stage = F.element_at(F.array(*map(F.lit, ("string", "regex", "cidr", "substring"))), F.col("stage") + 1)
    named = named.join(F.broadcast(ranks), "list_rank").join(shown, "list_id").select("ioc_type", "value", stage.alias("stage"), "list_id", "warning_list", "n_values", "sample", "wins")
    every_value = values.select("ioc_type", "value").join(named, ["ioc_type", "value"], "left")
    return every_value.withColumns({"wins": F.coalesce("wins", F.lit(False)), "is_warning": F.col("list_id").isNotNull()})


def diagnose(value: str, ioc_type: str, lists: DataFrame, expected: list[str] | None = None) -> DataFrame:
    """Per list worth a look: (list_id, name, type, n_values, matched, sample of three)."""
    words = L.TYPE_KEYWORDS.get(ioc_type, []) + [e.lower() for e in expected or []]
    shown = F.lower(F.concat_ws("\n", F.coalesce("name", F.lit("")), F.coalesce("description", F.lit(""))))
    worth = lists.filter(T.any_of(shown, words)) if words else lists.limit(0)
    clean = T.refang(F.lit(value))
    kind = F.coalesce("type", F.lit("string"))
    low = F.lower(clean)
    values = F.filter(F.coalesce("list", F.array().cast("array<string>")), lambda v: v.isNotNull())
    plain = F.when(kind == "string", F.exists(values, lambda v: F.lower(v) == low)).when(
        kind == "substring", F.exists(values, lambda v: F.contains(low, F.lower(v)) | F.contains(F.lower(v), low))
    ).otherwise(F.lit(False))
    patterns = valid_regexes(worth)
    regex = F.lit(False)
    for list_id, own in patterns.items():
        regex = regex | ((F.col("list_id") == list_id) & holds_any(clean, own))
    probe = lists.sparkSession.range(1).select(T.address_hex(clean).alias("h")).select(F.substr("h", F.lit(1), F.lit(1)).alias("family"), bits(F.col("h")).alias("b"))
    held = networks(worth, exact=True).join(probe, "family").filter(F.col("b").startswith(F.col("prefix"))).select("list_id").distinct().withColumn("in_net", F.lit(True))
    report = worth.join(held, "list_id", "left")
    matched = plain | ((kind == "regex") & regex) | ((kind == "cidr") & F.coalesce("in_net", F.lit(False)))
    return report.select("list_id", F.coalesce("name", "list_id").alias("name"), kind.alias("type"), F.size(values).cast("long").alias("n_values"), matched.alias("matched"), F.slice("list", 1, 3).alias("sample"))


def categories(lists: DataFrame) -> DataFrame:
    """Lists counted by the first word of their name, lower case; other without a name."""
    first = F.coalesce(F.lower(F.substring_index("name", " ", 1)), F.lit("other"))
    return lists.groupBy(first.alias("category")).agg(F.count("*").alias("n")).orderBy("category")
