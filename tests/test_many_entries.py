"""Long warning lists: pieces of substrings, literals of regular expressions, types of one's own."""

import random
import re

import pytest
from pyspark.sql import functions as F

from indicant.functions.extractors import EXTRACTORS, register
from indicant.functions.literals import FOLDED, required
from indicant.functions.patterns import Pattern
from indicant.operators import warninglists as W
from indicant.operators.containment import Pieces

IOCS = "ioc_type string, value string"
ATOMS = ["a", "b", "ab", "abc", r"\.", "[ab]", "c+", "(?:ab|bc)", "(ab|c)?", "(?:abc){1,2}", "(?:bca){0,1}", "^", "$", "k", "S", ".", "(?i:Ab)", r"\d", "(?=ab)", "(?!cc)"]


def many(spark, kind, entries, attributes=("domain",)):
    return spark.createDataFrame([("m", "Many", "", kind, list(attributes), list(entries))], W.SCHEMA)


def test_every_match_holds_a_text_of_every_set():
    rng, fold = random.Random(2), str.maketrans(*FOLDED)
    tried = 0
    for _ in range(3000):
        pattern = "".join(rng.choices(ATOMS, k=rng.randint(1, 5)))
        value = "".join(rng.choices(["a", "b", "c", "ab", "abc", ".", "7", "K", "ſ", "K", "AB"], k=rng.randint(0, 8)))
        m = re.search(pattern, value, re.IGNORECASE)
        if m:
            tried += 1
            for texts in required(pattern, 1):
                assert any(t in value.translate(fold).lower() for t in texts), (pattern, value)
    assert tried > 500
    assert required("(bad", 1) is None and required("[a-z]+", 1) == []
    assert ["shop12x"] in required(r"(?:^|[.])shop12x[0-9]*[.]example[.](?:com|org)$", 3)


def test_texts_and_entries_that_contain_each_other(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abé.") for _ in range(rng.randint(0, n)))
    entries, texts = {word(9) for _ in range(150)} | {"", "a" * 30}, sorted({word(14) for _ in range(200)} | {""})
    for sent in (True, False):
        sides = spark.createDataFrame([(k, v) for k, v in enumerate(texts)], "k int, v string")
        index = Pieces(spark.createDataFrame([(e,) for e in entries], "e string"), sides, sent=sent)
        assert {(r.k, r.e) for r in index.in_texts().collect()} == {(k, e) for k, v in enumerate(texts) for e in entries if e in v}
        assert {(r.k, r.e) for r in index.around_texts().collect()} == {(k, e) for k, v in enumerate(texts) for e in entries if v in e}


def test_entries_that_end_alike_have_keys_of_their_own(spark):
    entries = spark.range(10_000).selectExpr("'cdn' || CAST(id AS STRING) || '.cloudfront.net' AS e")
    sides = spark.range(500).selectExpr("'a' || CAST(id * 7 AS STRING) || '.cloudfront.net' AS v")
    index = Pieces(entries, sides)
    assert index.keys.count() == 10_000 and index.keys.groupBy("g").count().agg(F.max("count")).first()[0] <= 100
    met = index.of_sides.join(index.keys.select("g").distinct(), "g", "left_semi").count()
    assert met < 3 * 500


def test_few_and_many_substrings_agree(spark, monkeypatch):
    rows = spark.createDataFrame([("domains", v) for v in ("a.virus.com", "VIRUS", "vir", "", "x\\Ey", "none.org")] + [("urls", "http://h.virus.com/q"), ("cves", "virus")], IOCS)
    lists = many(spark, "substring", ["Virus.com", "x\\Ey", "kasper"], ("domain", "url"))
    few = sorted(map(tuple, W.matches(rows, lists).collect()))
    monkeypatch.setattr(W, "SUBSTRINGS_IN_PLAN", 0)
    assert sorted(map(tuple, W.matches(rows, lists).collect())) == few and len(few) == 6


def test_few_and_many_regexes_agree(spark, monkeypatch):
    patterns = [r"^dyn[0-9]+\.", r"(?:foo|bar)baz", r"^(..)\1\.", "(bad", r"(?P<a>pq)(?P=a)x", r"^[xyz]{3}$", r"shopK"]
    values = ["dyn12.org", "DYN7.net", "dyn.org", "a.barbaz.com", "abab.org", "pqpqx", "xyz", "xyzx", "shopK.de", "shopk.de"]
    rows = spark.createDataFrame([("domains", v) for v in values] + [("urls", "http://dyn5.org/x"), ("ips", "xyz")], IOCS)
    lists = many(spark, "regex", patterns, ("domain", "url"))
    few = sorted(map(tuple, W.matches(rows, lists).collect()))
    monkeypatch.setattr(W, "REGEX_IN_PLAN", 0)
    assert sorted(map(tuple, W.matches(rows, lists).collect())) == few
    assert {r[1] for r in few} >= {"dyn12.org", "DYN7.net", "a.barbaz.com", "abab.org", "pqpqx", "xyz", "http://dyn5.org/x"}


def test_the_plan_does_not_grow_with_the_patterns(spark):
    rows = spark.createDataFrame([("domains", "shop7x.org")], IOCS)
    sizes = []
    for n in (1100, 5000):
        found = W.matches(rows, many(spark, "regex", [rf"shop{k}x\.(?:com|org)" for k in range(n)]))
        sizes.append(len(found._jdf.queryExecution().optimizedPlan().toString().replace(str(n), "n").split("LocalRelation")[0]))
        assert [r.value for r in found.collect()] == ["shop7x.org"]
    assert abs(sizes[0] - sizes[1]) < 0.05 * sizes[0]


@pytest.mark.parametrize("kind", ["string", "regex", "substring"])
def test_types_that_are_registered_or_unknown_are_on_lists(spark, kind):
    rows = spark.createDataFrame([("ticket", "TCK-1"), ("never-heard-of", "TCK-1"), ("asn", "TCK-1"), ("domains", "TCK-1")], IOCS)
    lists = many(spark, kind, ["TCK-1"], ("other",))
    named = many(spark, "string", ["x.org"], ("domain",)).withColumn("list_id", F.lit("d"))
    register("ticket", Pattern(r"\b(TCK-[0-9]+)\b", (1,), "TCK-"))
    try:
        got = {r.ioc_type for r in W.warnings_only(rows, lists.union(named)).collect()}
    finally:
        del EXTRACTORS["ticket"]
    assert got == {"ticket", "never-heard-of", "asn"}


def test_explain_names_losing_lists_and_values_without_any(spark):
    lists = many(spark, "string", ["a.org"]).union(spark.createDataFrame([
        ("r", "Rex", "", "regex", ["domain"], [r"^a\."]), ("s", "Sub", "", "substring", ["domain"], [".org", None]), ("t", "Other", "", "string", ["domain"], ["A.org", "b.org", "c", "d"]),
    ], W.SCHEMA))
    rows = spark.createDataFrame([("domains", "a.org"), ("domains", "a.org"), ("domains", "z.com"), ("domains", "b.org"), ("domains", None)], IOCS)
    got = {(r.value, r.stage, r.list_id, r.n_values, tuple(r.sample or ()), r.wins, r.is_warning) for r in W.explain(rows, lists).collect()}
    assert got == {
        ("a.org", "string", "m", 1, ("a.org",), True, True), ("a.org", "string", "t", 4, ("A.org", "b.org", "c"), False, True), ("a.org", "regex", "r", 1, (r"^a\.",), False, True),
        ("a.org", "substring", "s", 2, (".org", None), False, True), ("b.org", "string", "t", 4, ("A.org", "b.org", "c"), True, True),
        ("b.org", "substring", "s", 2, (".org", None), False, True), ("z.com", None, None, None, (), False, False),
    }
