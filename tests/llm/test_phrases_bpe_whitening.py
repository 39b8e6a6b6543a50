"""Phrase collocations, byte-level BPE and whitening against brute force and the library."""

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from indicant.llm import byte_bpe, collocations
from indicant.llm.oracles import oracle_sql
from indicant.llm.queries import tokenizer
from indicant.llm.whitening import whiten

from .test_text_operators import HARD, hard_rows

RANKS = "byte_bpe_multi_50k.tiktoken"


def brute_collocations(rows, least, first):
    counts, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            ws = re.findall("[^ \t]+", piece)
            n[lang] += len(ws)
            for k in range(1, 6):
                for i in range(len(ws) - k + 1):
                    key = lang, tuple(ws[i : i + k])
                    counts[key] = counts.get(key, 0) + 1
    good = {key: a for key, a in counts.items() if a >= least}
    inside = {}
    for (lang, p), a in good.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                inside[lang, p[i : i + k]] = max(inside.get((lang, p[i : i + k]), 0), a)
    out = {}
    for (lang, p), a in good.items():
        if len(p) > 1 and inside.get((lang, p), 0) < a:
            cuts = [(int(Fraction(1000 * a * n[lang], good[lang, p[:k]] * good[lang, p[k:]])), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), good[lang, p[:k]], good[lang, p[k:]]))
    return {(lang, j + 1, p.decode(), -a, l, r, n[lang], -s) for lang, own in out.items() for j, (s, a, p, l, r) in enumerate(sorted(own)[:first])}


def test_collocations_against_brute_force(spark):
    rnd = random.Random(3)
    vocabulary = ["A", "b", "Ü", "ü", "cc", "don't", "e f", "x\u0000", "名"]
    rows = [(rnd.choice(["en", "de", None, "und"]), "".join(rnd.choice(vocabulary) + rnd.choice([" ", " ", "  ", "\t", ". ", "\n", ",", "\u000b"]) for _ in range(rnd.randint(0, 60)))) for _ in range(120)]
    rows += [("en", "same old phrase again here and there")] * 40 + [(None, None), ("en", ""), ("de", " . , \n")]
    docs = spark.createDataFrame([(None, t, lang, None, None, 0.0, 1, "", 0, "", "") for lang, t in rows], HARD)
    for least, first in ((5, 2000), (3, 7)):
        got = {tuple(r) for r in collocations.collocations(docs, least, 5, first).collect()}
        assert got == brute_collocations(rows, least, first)


def test_collocations_of_hard_and_empty_tables(spark):
    hard = hard_rows()
    got = {tuple(r) for r in collocations.collocations(spark.createDataFrame(hard, HARD), 3).collect()}
    assert got == brute_collocations([(r[2], r[1]) for r in hard], 3, 2000)
    assert collocations.collocations(spark.createDataFrame([], HARD)).count() == 0
    assert collocations.collocations(spark.createDataFrame(hard, HARD), 10**9).count() == 0


def test_collocations_sent_or_shuffled_groups_are_the_same(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sent = sorted(map(tuple, collocations.collocations(docs, 20).collect()))
    monkeypatch.setattr(collocations, "SENT_ROWS", 3)
    assert sorted(map(tuple, collocations.collocations(docs, 20).collect())) == sent and sent


def test_occurrences_are_joined_where_they_are(spark, tmp_path):
    """Both sides of the merge join are read from their buckets: no exchange; the session's setting comes back."""
    before = spark.conf.get(collocations.co_located.KEY)
    rows = spark.range(1000).select((F.col("id") % 50).alias("doc"), (F.col("id") / 50).cast("int").alias("pos"), (F.col("id") % 7).alias("id"))
    relation = collocations.Relation(rows, f"file://{tmp_path}", "r", 4)
    try:
        with collocations.co_located(spark):
            pairs = relation.next_to_itself()
            plan = pairs._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan
            assert pairs.count() == 950
    finally:
        relation.drop()
    assert spark.conf.get(collocations.co_located.KEY) == before


def test_collocations_against_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.001/documents.parquet')")
    want = sorted(con.execute(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({oracle_sql()['op11_collocations']})").fetchall())
    assert sorted(map(tuple, collocations.collocations(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect())) == want


@pytest.fixture(scope="module")
def library():
    ranks = byte_bpe.read_ranks(tokenizer(RANKS))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.Encoder(tokenizer(RANKS))


PARTS = ["a", "the", " ", "  ", "\n", "'", "'s", "'re", "r", "e", "1", "23", "!", "…", "é", "한", "\u0085", "\x1c", "​", "\U0001f600", "　", "ω", "x" * 40, " " * 70, "²", "ⅷ", "\U00012345", "٠", "ing", "Ünï", "<|endoftext|>"]


def test_encoding_appends_and_edits_as_the_library_encodes_the_whole(encoder, library):
    rnd = random.Random(5)
    for _ in range(800):
        text, more = ("".join(rnd.choices(PARTS, k=rnd.randint(0, n))) for n in (12, 4))
        ids, settled, tail = encoder.encode(text)
        assert list(ids) == library.encode_ordinary(text) and encoder.decode(ids) == text.encode()
        assert list(ids[:settled]) + list(encoder.encode(tail + more)[0]) == library.encode_ordinary(text + more)
        whole = byte_bpe.Encoded(encoder, text)
        whole.append(more)
        assert list(whole.ids()) == library.encode_ordinary(text + more)
        start = rnd.randint(0, len(text))
        end = rnd.randint(start, min(len(text), start + 5))
        edited = byte_bpe.Encoded(encoder, text)
        edited.replace(start, end, more)
        assert list(edited.ids()) == library.encode_ordinary(text[:start] + more + text[end:])


def test_last_tokens_of_prefixes_after_appends_and_edits(encoder):
    rnd = random.Random(6)
    for _ in range(400):
        data, more = ("".join(rnd.choices(PARTS, k=rnd.randint(0, n))).encode() for n in (10, 3))
        start = rnd.randint(0, len(data))
        end = rnd.randint(start, min(len(data), start + 6))
        edited = byte_bpe.Prefixes(encoder.vocabulary, data)
        edited.replace(start, end, more)
        assert edited.last == byte_bpe.Prefixes(encoder.vocabulary, data[:start] + more + data[end:]).last
        longer = byte_bpe.Prefixes(encoder.vocabulary, data)
        longer.append(more)
        assert longer.last == byte_bpe.Prefixes(encoder.vocabulary, data + more).last


def test_edits_look_only_near_them(encoder):
    text = "hello world and so on " * 3000
    assert byte_bpe.Encoded(encoder, text).replace(20000, 20003, "q!") < 10
    assert byte_bpe.Prefixes(encoder.vocabulary, text.encode()).replace(20000, 20003, b"xyz") < 5 * encoder.vocabulary.longest


def test_round_trip_of_documents_and_hard_rows(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(hard_rows(), HARD).select("doc_id", "text"))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for r in docs.collect():
        ids = library.encode_ordinary(r.text or "")
        want[r.doc_id, len(ids), sha(",".join(map(str, ids)).encode()), sha((r.text or "").encode())] += 1
    assert Counter(map(tuple, byte_bpe.round_trip(docs, tokenizer(RANKS)).collect())) == want
    assert byte_bpe.round_trip(spark.createDataFrame([], HARD), tokenizer(RANKS)).count() == 0


def test_appended_rows_are_those_of_the_whole_text(spark):
    path = tokenizer(RANKS)
    docs = spark.createDataFrame(hard_rows(), HARD).filter("doc_id IS NOT NULL")
    more = byte_bpe.encode_texts(docs, path, ["doc_id"]).withColumn("more", F.when(F.col("doc_id") % 2 == 0, "'re  more"))
    got = byte_bpe.append_texts(more, path)
    whole = byte_bpe.encode_texts(docs.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 2 == 0, "'re  more").otherwise(""))), path, ["doc_id"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))


def brute_whitening(rows, components=4):
    good = [(i, [float(c) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = [[int(np.floor(256 * c)) for c in v] for _, v in good]
    fit = np.array(sorted(set(map(tuple, x))), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = ((n * fit - sums) / n).astype(float)
    cov = centred.T @ centred / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    v = v[:, e > 1e-9 * e[0]]
    e = e[e > 1e-9 * e[0]]
    out = []
    for (i, _), row in zip(good, x):
        num = n * np.array(row, dtype=object) - sums
        for j in range(len(e)):
            out.append((i, j + 1, n, int((num**2).sum()), abs(float((num / n).astype(float) @ v[:, j])) / np.sqrt(e[j]), e[j] / np.trace(cov)))
    return out


@pytest.mark.parametrize("rank", [7, 2])
def test_whitening_against_numpy(spark, rank):
    rnd = np.random.default_rng(rank)
    base = np.round(rnd.normal(size=(300, rank)) * 64) @ np.round(rnd.normal(size=(rank, 7)) * np.arange(1, 8) * 4) / 256
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(base)] + [(7, [0.25] * 7)] * 40 + [(None, [0.25] * 7), (1000, None), (1001, [1.0, None] + [0.0] * 5), (1002, [float("nan")] * 7), (1003, [float("-inf")] + [0.0] * 6), (1004, [-0.0] * 7)]
    vectors = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, n int, component string")
    got = whiten(vectors).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3], r[4])
    mine = sorted(((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in got), key=key)
    want = sorted(brute_whitening(rows), key=key)
    assert [r[:4] for r in mine] == [r[:4] for r in want]
    assert np.allclose([r[4:] for r in mine], [r[4:] for r in want], rtol=1e-9, atol=1e-9)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_whitening_of_tables_without_components(spark):
    schema = "vec_id long, embedding array<float>"
    assert whiten(spark.createDataFrame([], schema)).count() == 0
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    assert whiten(spark.createDataFrame([(1, []), (2, None)], schema)).count() == 0
    with pytest.raises(ValueError):
        whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], schema))


def test_whitening_over_many_blocks(spark, monkeypatch):
    from indicant.llm import whitening

    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    plain = {(r.vec_id, r.component): r.whitened for r in whiten(vectors).collect()}
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 16)
    monkeypatch.setattr(whitening, "BLOCK_COLUMNS", 10)
    monkeypatch.setattr(whitening, "BLOCKS_A_TASK", 1)
    small = {(r.vec_id, r.component): r.whitened for r in whiten(vectors).collect()}
    assert plain.keys() == small.keys() and max(abs(plain[k] - small[k]) for k in plain) < 1e-9
