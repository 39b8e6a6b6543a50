"""Near duplicates, nearest neighbours, WARC archives and the pipeline, against brute force."""

import gzip
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from indicant.llm import near_dedup, warc
from indicant.llm.ann import nearest_neighbours
from indicant.llm.common import shared_dir


def shingle_set(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(docs, percent=75):
    sets = {k: shingle_set(t) for k, t in docs}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in keys}


def copies(seed=5, groups=12, most=90):
    """Texts in groups: stars of near copies around a base, chains of copies of copies, exact copies, strangers with a shared line."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    shared = " ".join(word() for _ in range(12))
    docs = []
    for g in range(groups):
        base = [word() for _ in range(rng.randint(6, 120))]
        last = base
        for _ in range(rng.choice([1, 2, 5, most])):
            source = base if g % 2 else last
            w = list(source)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = word()
            last = w
            docs.append(" ".join(w))
    docs += [f"{shared} {' '.join(word() for _ in range(rng.randint(2, 40)))}" for _ in range(150)]
    rng.shuffle(docs)
    return [(3 * k, t) for k, t in enumerate(docs)]


@pytest.mark.parametrize("seed", [5, 6])
def test_near_duplicates_equal_brute_force(spark, seed):
    docs = copies(seed)
    rows = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    expected = brute_components(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def template(n=1000, pairs=100):
    """Fillings of one template: cubic polynomials over GF(11) give words to replace, so two of them share three at most and resemble each
    other by 0.69 to 0.747; then partners of some of them at 0.767."""
    base = [f"w{k}" for k in range(389)]
    docs, planted = [], []
    for d in range(n):
        w = [*base, f"end{d}"]
        for x in range(7):
            w[5 * (11 * x + (d + d // 11 * x + d // 121 * x**2 + d // 1331 * x**3) % 11) + 4] = f"v{d}x{x}"
        docs.append(w)
    for d in range(0, n, n // pairs):
        w = docs[d][:-1] + [f"end{len(docs)}"]
        for k in random.Random(d).sample([k for k in range(4, 385, 5) if w[k] == base[k]], 10):
            w[k] = f"u{d}k{k}"
        planted.append((d, len(docs)))
        docs.append(w)
    return [(k, " ".join(w)) for k, w in enumerate(docs)], planted


def test_links_in_a_large_region_are_found(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "TREES", 2)  # no other trees make up for a link missed in a region
    docs, planted = template()
    sets = [shingle_set(t) for _, t in docs]
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert all(0.75 < like(a, b) < 0.8 for a, b in planted) and max(like(a, b) for a in range(0, 1000, 97) for b in range(1000) if a != b) < 0.75
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    label = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(table).collect()}
    found = [(a, b) for a, b in planted if label[b] == a]
    sig = [near_dedup.signature(near_dedup.shingles(t)) for _, t in docs]
    shared = [(a, b) for a, b in planted if any((sig[a][t : t + 2] == sig[b][t : t + 2]).all() for t in (0, 64))]
    assert len(shared) > 50 and set(shared) <= set(found)
    assert label == {k: k for k, _ in docs} | {b: a for a, b in found}


def headed(n=20_000, pairs=5_000, seed=11):
    """Texts with a common head of 60 words and a tail of their own of 15, of which some have a partner at a similarity of 0.753."""
    rng = random.Random(seed)
    head = [f"head{k}" for k in range(60)]
    tail = lambda d: [f"t{d}x{k}" for k in range(15)]
    docs = [head + tail(d) for d in range(n - pairs)]
    partners = {}
    for d in range(pairs):
        w = tail(d)
        partners[len(docs)] = d
        docs.append(head + w[:5] + [f"p{d}x{k}" for k in range(10)])
    order = list(range(n))
    rng.shuffle(order)
    return [(k, " ".join(docs[k])) for k in order], partners


def test_no_link_is_lost_under_a_common_head(spark):
    docs, partners = headed()
    text = dict(docs)
    sets = {k: shingle_set(text[k]) for k in (0, 1, 15_000, 15_001)}
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert 0.75 <= like(0, 15_000) < 0.76 and like(0, 1) < 0.75 and like(1, 15_000) < 0.75
    rows = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(8)).collect()
    assert {r.doc_id: r.component_id for r in rows} == {k: partners.get(k, k) for k, _ in docs}


@pytest.mark.parametrize("seed", [5, 6])
def test_regions_dealt_to_several_tasks(spark, monkeypatch, seed):
    """With a lower mark for regions that are dealt out, the result stays that of brute force."""
    monkeypatch.setattr(near_dedup, "HOT", 60)
    monkeypatch.setattr(near_dedup, "SAMPLED", 1)
    monkeypatch.setattr(near_dedup, "REGION", 8)
    docs = copies(seed, groups=6, most=200)
    classes = near_dedup.fingerprints(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text").select("id", "sig")
    assert near_dedup.hot_regions(classes).count() > 0
    rows = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(docs)


def test_intersections_of_blocks():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.choice(rng.choice([50, 3000]), 60).astype(np.uint64)) for _ in range(90)]
    exact = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    assert np.array_equal(near_dedup.common(sets[:40], sets[40:]), exact[:40, 40:])
    assert np.array_equal(np.triu(near_dedup.common(sets, None), 1), np.triu(exact, 1))


def test_shingles_of_long_texts_are_cut_without_loss(monkeypatch):
    text = " ".join(f"W{k % 700}" for k in range(3000))
    whole = near_dedup.shingles(text)
    monkeypatch.setattr(near_dedup, "BLOCK_WORDS", 97)
    assert np.array_equal(whole, near_dedup.shingles(text)) and len(whole) == len(shingle_set(text))


def test_components_of_a_long_chain(spark):
    n = 200
    edges = spark.createDataFrame([(k, k + 1) for k in range(n)], "a long, b long")
    rows = near_dedup.components(edges, shared_dir(spark), "chain").collect()
    assert len(rows) == n + 1 and {r.label for r in rows} == {0}


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(20, 16))
    x = (centres[rng.integers(0, 20, 3000)] + 0.4 * rng.normal(size=(3000, 16))).astype(np.float32)
    x[100:400] = x[100]
    rows = [(k, v.tolist(), 0, "x") for k, v in enumerate(x)]
    bad = [(5000, None, 0, ""), (5050, [0.0] * 16, 0, ""), (5100, [math.nan] + [1.0] * 15, 0, ""), (5150, [None] + [1.0] * 15, 0, ""), (5200, [1.0] * 3, 0, ""), (None, [1.0] * 16, 0, ""), (5250, [math.inf] + [1.0] * 15, 0, ""), (5300, [], 0, "")]
    got = {}
    for r in nearest_neighbours(spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, rank int, id string")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 3000, 50):
        score = unit @ unit[q]
        score[q] = -np.inf
        best = np.lexsort((np.arange(3000), -np.round(score, 12)))[:5]
        own = sorted(got[q])
        assert [r[0] for r in own] == [1, 2, 3, 4, 5] and q not in [r[1] for r in own]
        hits += len({r[1] for r in own} & set(best.tolist()))
    assert set(got) == set(range(0, 3000, 50)) and hits / 300 >= 0.95
    assert [r[1] for r in sorted(got[150])] == [100, 101, 102, 103, 104]


def test_nearest_neighbours_of_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (50, [1.0, 1.0])], "vec_id long, embedding array<float>")
    rows = nearest_neighbours(few).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in rows] == [(0, 1, 50), (0, 2, 1), (50, 1, 0), (50, 2, 1)]
    assert nearest_neighbours(few.limit(0)).count() == 0 and nearest_neighbours(few.filter("vec_id = 1")).count() == 0


def pages(spark):
    big = "<p>ü" * 400
    rows = [(1, "http://a/", big), (2, "http://b/", big), (7, None, big), (3, "http://c/", "short"), (4, "http://d/", "short"), (5, "http://e/", None), (6, "http://f\r\nX: y/", ""), (8, "u", "z" * 999), (9, "u", "z" * 999), (None, "n", "q" * 2000), (10, "v", "q" * 2000), (10, "v", "q" * 2000), (11, "long", "lörem " * 300000)]
    return rows, spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, payload string, size int")


def test_warc_round_trip(spark):
    rows, df = pages(spark)
    keep = {}
    for k, _, h in rows:
        if k is not None and len((h or "").encode()) >= 1000:
            keep[h] = max(keep.get(h, -1), k)
    expected = sorted((k or 0, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), keep.get(h, k) if keep.get(h, k) != k else None) for k, _, h in rows)
    got = warc.round_trip(df).collect()
    assert sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.refers_to) for r in got) == expected
    assert all((r.record_type == "revisit") == (r.refers_to is not None) for r in got)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_filters_payloads_and_other_readers(spark):
    rows, df = pages(spark)
    where = shared_dir(spark)
    manifest = warc.write_warc(df, where)
    read = warc.read_warc(spark, where)
    assert manifest.agg(F.sum("n_records")).first()[0] == len(rows)
    one = read.filter((F.col("record_type") == "response") & (F.col("page_id") == 6)).collect()
    assert len(one) == 1 and bytes(one[0].payload) == b"" and one[0].target_uri == "http://f%0D%0AX: y/"
    assert read.filter("page_id >= 3 AND page_id <= 5").count() == 3 and read.filter("record_type IN ('revisit')").filter("payload IS NOT NULL").count() == 0
    assert warc.read_warc(spark, where, payload=False).filter("payload IS NOT NULL").count() == 0
    raw = b"".join(gzip.open(r.path, "rb").read() for r in manifest.collect())
    assert raw.count(b"WARC/1.1\r\n") == len(rows)


def foreign(tmp_path, http):
    """Records as other tools write them, in a plain file, a gzip member a record, and one gzip member for all."""
    def rec(kind, uri, body, wrapped=True):
        head = f"WARC/1.0\r\nwarc-type: {kind}\r\nWARC-Target-URI: {uri}\r\nWARC-Record-ID: <urn:uuid:{uri}>\r\nX-Long: a\r\n b\r\nContent-Type: {'application/http; msgtype=response' if wrapped else 'text/plain'}\r\n"
        block = (http if wrapped else b"") + body
        return f"{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    rng = random.Random(4)
    bodies = [b"", b"x", b"\r\n\r\nWARC/1.0\r\n", rng.randbytes(300_000), b"a" * 5_000_000, "ü".encode() * 700]
    records = [rec("warcinfo", "info", b"software: other", False)] + [rec("response", f"http://{k}/", b) for k, b in enumerate(bodies)] + [rec("conversion", "c", b"plain text", False), rec("revisit", "r", b"")]
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "sub" / "c.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    (tmp_path / "ignored.txt").write_text("no archive")
    return bodies


def test_warc_reads_the_archives_of_other_tools(spark, tmp_path):
    bodies = foreign(tmp_path, b"HTTP/1.1 200 OK\r\nServer: s\r\n\r\n")
    read = warc.read_warc(spark, str(tmp_path), verify=True)
    rows = read.collect()
    assert len(rows) == 3 * (len(bodies) + 3)
    for k, body in enumerate(bodies):
        own = [r for r in rows if r.target_uri == f"http://{k}/"]
        assert len(own) == 3 and all(bytes(r.payload) == body and r.payload_digest == hashlib.sha1(body).hexdigest() and r.headers["x-long"] == "a b" for r in own)
    assert [bytes(r.payload) for r in read.filter("record_type = 'conversion'").collect()] == [b"plain text"] * 3
    assert read.filter("record_type = 'revisit' AND payload IS NULL AND page_id IS NULL").count() == 3
    skipped = warc.read_warc(spark, str(tmp_path), payload=False)
    assert skipped.filter("target_uri = 'r'").count() == 3 and skipped.filter("payload IS NOT NULL").count() == 0
    assert warc.read_warc(spark, str(tmp_path / "a.warc")).count() == len(bodies) + 3


def test_warc_faults_are_not_read_as_empty(spark, tmp_path):
    with pytest.raises(Exception, match="no .warc"):
        warc.read_warc(spark, str(tmp_path)).collect()
    (tmp_path / "cut.warc.gz").write_bytes(gzip.compress(b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" * 500)[:-30])
    with pytest.raises(Exception, match="gzip member"):
        warc.read_warc(spark, str(tmp_path)).collect()


def test_warc_splits_of_large_files(spark, monkeypatch, tmp_path):
    rows = [(k, f"http://{k}/", str(random.Random(k).randbytes(3000))) for k in range(60)]
    monkeypatch.setattr(warc, "SPLIT_BYTES", 20_000)
    where = shared_dir(spark)
    batches = spark.createDataFrame([(*r, "d", len(r[2]), None) for r in rows], "page_id long, url string, html string, digest string, size long, refers_to long").coalesce(1)
    warc.write_warc(batches, where)
    parts = warc.archives(*warc.filesystem(where))
    assert len(parts) >= len({p.path for p in parts})
    got = warc.read_warc(spark, where).select("page_id", F.col("payload").cast("string").alias("p")).collect()
    assert sorted((r.page_id, r.p) for r in got) == sorted((k, h) for k, _, h in rows)


def test_warc_filters_are_settled_by_the_reader():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    reader = warc.WarcReader({"path": "x"})
    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), In(("page_id",), (1, 2)), GreaterThan(("payload_bytes",), 5), EqualTo(("headers", "x"), "y")]))
    assert len(left) == 2 and reader.wanted.fits({"record_type": "response", "page_id": 2}) and not reader.wanted.fits({"record_type": "revisit", "page_id": 2})


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage drops what it should of a small corpus, and nothing else."""
    rng = random.Random(8)
    plain = [f"wort{k}" for k in range(300)]
    text = lambda n: " ".join(rng.choice(plain) for _ in range(n)) + "."
    docs, marks = [], []
    for k in range(400):
        toxic, junk = k % 10 == 3, k % 10 == 7
        t = text(rng.randint(30, 60))
        if toxic:
            t = " ".join(w if rng.random() > 0.15 else rng.choice(["fool", "scum"]) for w in t.split())
        if junk:
            t = " | ".join(w + "###" for w in t.split())
        docs.append((k, t, "en", "junk" if junk else f"s{k % 5}", len(t), k * 1.0))
        marks.append((k, int(not junk), int(toxic)))
    bench = [(1, text(25)), (2, None)]
    clean = [d for d in docs if d[0] % 10 not in (3, 7)]
    docs += [(1000 + k, clean[k][1], "en", "s1", None, None) for k in range(5)] + [(2000, f"{text(20)} {bench[0][1]} {text(20)}", "en", "s2", 10, None)]
    frames = {"documents": (docs, "doc_id long, text string, lang string, source string, n_chars long, score double"), "labels": (marks, "doc_id long, quality int, toxic int"), "benchmark": (bench, "item_id long, text string")}
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {d[0] for d in clean} and all(r.lossless and r.n_pieces > 0 and len(r.ids) == 2 * r.n_pieces for r in got)
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "score"]
        assert stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0), str(tmp_path)).count() == 0


#: Extra columns whose names clash with what the stages return or use inside.
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, id string, __copy string, contaminated string, ids string, kept boolean"


def test_pipeline_stages_on_hard_rows(spark, tmp_path):
    """Null columns and ids, empty and very long texts, repeated rows and clashing names pass through every stage with a defined result."""
    rng = random.Random(12)
    plain = [f"wort{k}" for k in range(300)]
    text = lambda n: " ".join(rng.choice(plain) for _ in range(n)) + "."
    some, again, lone = text(40), text(40), text(40)
    rows = [(1, None), (2, ""), (3, "  \n "), (4, some), (4, some), (5, some), (6, again), (6, again), (7, "ünï " * 30_000), (None, lone), (None, lone), (None, None), (8, text(40)), (9, text(25)), (9, text(30))]
    docs = spark.createDataFrame([(k, t, *[None] * 10) for k, t in rows], CLASHING)
    marks = [(k, k % 2, k % 2) for k in range(100, 160)]
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for labels, where in ((empty, tmp_path / "none"), (spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), tmp_path / "other")):
        docs.write.parquet(f"{where}/documents.parquet")
        labels.write.parquet(f"{where}/labels.parquet")
        spark.createDataFrame([(1, text(25)), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
        source = spark.read.parquet(f"{where}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, source, str(where))
            left = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out.collect())
            assert out.columns == source.columns
            if name == "near_dedup":  # one row of each repeated document, one of equal texts, both null and empty texts
                expected = {(k is None, k or 0, t or "") for k, t in rows} - {(False, 5, some)}
                assert left == sorted(expected)
            else:
                assert left == sorted((k is None, k or 0, t or "") for k, t in rows)
        final = corpus_pipeline.run(spark, str(where)).collect()
        assert len(final) == len(rows) - 4 and all(r.lossless and len(r.ids) == 2 * r.n_pieces for r in final)
