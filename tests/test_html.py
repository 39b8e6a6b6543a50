"""Visible text of pages: references as the standard library reads them, tags as they end."""

import html
import random
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from indicant.sources.text import html_to_text, unescaped


def test_references_against_the_standard_library(spark):
    rng, names = random.Random(1), sorted(html5)
    parts = lambda: rng.choice(["&" + rng.choice(names), "&" + rng.choice(names).rstrip(";"), "x", "7", ";", " ", "&", "amp", "&#233;", "&#x1F600", "&#128;"])
    cases = ["".join(parts() for _ in range(rng.randint(1, 8))) for _ in range(1500)]
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", unescaped(F.col("t")).alias("t"))
    assert [r.t for r in rows.orderBy("i").collect()] == [html.unescape(c) for c in cases]


@pytest.mark.parametrize(("page", "text"), [
    ('<a title="x>y http://leak.example.org">c</a> d', "c d"), ("<a b = '>' c=\">\">x</a>", "x"), ("<p don't>it's</p>", "it's"), ('<i alt="open>e', "e"),
    ("a<!-- <script> -->b", "a b"), ('<script data-x=">">x = "<!--"</script>c', "c"), ("<style>p > a {}</style>t<STYLE>never closed", "t"),
    ("<head><script>'</head>'</script><title>no</title></head>yes", "yes"), ("1 < 2 &amp;&lt 3", "1 < 2 &< 3"), ("x" * 50_000 + "<b " + "y=1 " * 20_000 + ">z", "x" * 50_000 + " z"),
])
def test_tags(spark, page, text):
    assert spark.createDataFrame([(page,)], "h string").select(html_to_text(F.col("h"))).first()[0] == text
