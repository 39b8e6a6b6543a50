"""The SQL of queries on values that the small tables lack: both sides state one rule."""

import duckdb
import pytest

import __spark_entry__

ODD_HTML = [
    "<p>a &amp b &copy2024 &notit; &notin; &eacutex&</p>", "&#39;&#x27;&#150;&#x80;&#129;&#0;&#xD800;&#99999999999;&#x1F600;&fjlig;&nosuch;&ampamp;",
    '<a title="x>y" b = \'>\'>c</a> d<br alt="never closed>e', "a<!-- <script> -->b<script data-x=\">\">x</script>c<style>never", " <head><title>t</title></head> x y&nbsp; z ",
    " https://a.example/x?a=1&amp;b=2\n", None, "", "<b>'", "&&&amp&&&%%% &", "<SCRIPT>a</SCRIPT >b<noscript>c</noscript>d<!-- e",
]


def sides(spark, tmp_path, query, **tables):
    for name, df in tables.items():
        df.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = __spark_entry__.queries()[query](spark, str(tmp_path))
    own = duckdb.connect()
    for name in tables:
        own.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = own.sql(f"SELECT {', '.join(got.columns)} FROM ({__spark_entry__.oracle_sql()[query]})").fetchall()
    rows = lambda r: sorted(map(tuple, r), key=repr)
    return rows(got.collect()), rows(want)


def test_hash_validity_of_digests_that_look_like_files(spark, tmp_path):
    keys = (2531806, 2444926, 3072822, 1, 2, 3, 4, 5)  # SHA-256 of the first three starts with 4d5a, 504b and 377a
    got, want = sides(spark, tmp_path, "hash_validity", orders=spark.createDataFrame([(k,) for k in keys], "o_orderkey long"))
    assert got == want and [valid for k, _, valid in got if k > 9] == [False] * 3


@pytest.mark.parametrize("query", ["html_to_text", "extract_page_texts"])
def test_text_of_odd_pages(spark, tmp_path, query):
    pages = [(k, "u", h) for k, h in enumerate(ODD_HTML)] + [(99, "u", "<p>x&#64;y a.b@mail1.example.com&amp 10.2.3.4</p>")]
    got, want = sides(spark, tmp_path, query, pages=spark.createDataFrame(pages, "page_id long, url string, html string"))
    assert got == want and got


ODD_DOCUMENTS = [
    "THE.26@MAIL6.EXAMPLE.COM!! WORD.ASIA!! An.name le.\nAioion.info x.bfed ed.cab", "ént.26@mail6.example.com menté.cab é.cab aó.info info.é a.comé b.org.comé _a@b.com a_b@c.net²",
    "google.com bad.google.com x.google.com react.vue.com s.exe a.b.zip " + "l" * 64 + ".com and.org via[.]net p(.)q{.}com svchost.exe a.sh", "1.2.3.4.5 01.2.3.4 1[.]2[.]3.9 x1.2.3.4 é1.2.3.4 1.2.3.4é 256.1.1.1",
    "SHA1: 9233A8ECF7C5B09FE5949719B6B82BC439E9329Bff é9233a8ecf7c5b09fe5949719b6b82bc439e9329b \"2aeb8253858bf047bc9bb976166a40ef87db38b0\"!!", "", None, "a@b.com@c.com a.-b@c.com-d@e.org", "x.é.com mail.é1.org a_b.com c-.com -d.com e..net .f.io",
]


@pytest.mark.parametrize("query", ["extract_all_counts", "extract_documents"])
def test_indicators_of_odd_documents(spark, tmp_path, query):
    got, want = sides(spark, tmp_path, query, documents=spark.createDataFrame(list(enumerate(ODD_DOCUMENTS)), "doc_id long, text string"))
    assert got == want and got


def test_a_store_where_runs_of_a_source_share_iocs(spark, tmp_path):
    keys = [(k, c) for c, every in ((1, 1), (2, 90000 * 77), (3, 25 * 77 * 90000), (6, 3), (9, 1), (10, 7)) for k in range(c, c + 5 * every, every)]
    got, want = sides(spark, tmp_path, "store_replaced_and_concurrent", orders=spark.createDataFrame(keys, "o_orderkey long, o_custkey long"))
    assert got == want and any(r[2] > 1 and r[4] < r[3] for r in got[:-1])
