"""Byte ranges of large files, state that ends with its source, observed progress."""

import json
import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from indicant.operators.extract import extract_all
from indicant.sources import ranges
from indicant.streaming import by_source, progress, stream

PIECES = [b"ab", b" ", b"\n", "é".encode(), "한".encode(), "\U0001f600".encode(), b"\xff", b"\xe2\x82", b"\x80", b"word"]


def chunks_of(path, length, size, overlap, span):
    reader = ranges.RangeReader({"files": json.dumps([[path, length]]), "size": size, "overlap": overlap, "span": span})
    return sorted(row for part in reader.partitions() for row in reader.read(part))


@pytest.mark.parametrize(("size", "overlap", "span"), [(1, 0, 1), (3, 5, 40), (10, 0, 10), (16, 8, 64), (50, 200, 1000)])
def test_chunks_are_the_file_each_byte_once(tmp_path, size, overlap, span):
    rng = random.Random(size)
    for k in range(15):
        data = b"".join(rng.choice(PIECES) for _ in range(rng.randint(0, 300)))
        path = str(tmp_path / f"{k}.txt")
        (tmp_path / f"{k}.txt").write_bytes(data)
        rows, at = chunks_of(path, len(data), size, overlap, span), 0
        for _, _, start, n, text in rows:
            own = data[start : start + n].decode("utf-8", "ignore")
            assert start == at and text.startswith(own) and len(text.encode()) <= n + overlap
            at += n
        assert at == len(data)
        assert "".join(data[r[2] : r[2] + r[3]].decode("utf-8", "ignore") for r in rows) == data.decode("utf-8", "ignore")


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    lines = [f"line {k} 10.{k % 200}.{k % 7}.1 test{k}.evil.org " + "x" * (k % 90) for k in range(3000)]
    (tmp_path / "large.txt").write_text("\n".join(lines))
    (tmp_path / "empty.txt").write_text("")
    whole = set(map(tuple, extract_all(spark.createDataFrame([("\n".join(lines),)], "text string"), types=["ips", "domains"]).collect()))
    for size, overlap in ((1000, 130), (7000, 40), (1 << 20, 1 << 10)):
        chunks = ranges.read_ranges(spark, f"file://{tmp_path}", size, overlap, span=4 * size)
        assert size == 1 << 20 or chunks.rdd.getNumPartitions() > 5
        found = ranges.extract_ranges(chunks, types=["ips", "domains"])
        assert {(r.ioc_type, r.value) for r in found.collect()} == whole
    with pytest.raises(FileNotFoundError):
        ranges.read_ranges(spark, str(tmp_path / "nothing"))
    with pytest.raises(Exception, match="size must be positive"):
        ranges.read_ranges(spark, str(tmp_path), size=0).collect()


def test_state_is_gone_when_its_source_has_ended(spark, tmp_path):
    src = str(tmp_path / "in")
    put = lambda *r: spark.createDataFrame(list(r), "source string, text string, last boolean").coalesce(1).write.mode("append").parquet(src)
    put(("a", "1.2.3.4 5.6.7.8", False), ("b", "1.2.3.4", None), ("c", None, False))
    put(("a", "5.6.7.8 9.9.9.9", False), ("a", "9.9.9.9", False))
    put(("a", "1.2.3.4 4.4.4.4", True), ("b", "1.2.3.4", True))
    put(("a", "1.2.3.4", False))
    read = spark.readStream.schema("source string, text string, last boolean").option("maxFilesPerTrigger", 1).parquet(src)
    before = spark.conf.get(by_source.PROVIDER)
    query = by_source.run_by_source(by_source.extract_by_source(read, "source", types=["ips"], defang=False), str(tmp_path / "out"), str(tmp_path / "check"))
    assert spark.conf.get(by_source.PROVIDER) == before
    got = sorted((r.source, r.value) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", "1.2.3.4"), ("a", "1.2.3.4"), ("a", "4.4.4.4"), ("a", "5.6.7.8"), ("a", "9.9.9.9"), ("b", "1.2.3.4")]
    held = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.numInputRows]
    assert held[0] > 0 and held[2] == 0 and held[3] == 1


def test_observed_figures(spark, tmp_path):
    docs = spark.createDataFrame([(1, "1.2.3.4 a@b.org"), (2, None), (3, "é 5.6.7.8 1.2.3.4")], "doc_id long, text string")
    seen = Observation("some")
    assert progress.extract_observed(docs, seen, types=["ips", "emails"]).count() == 4
    want = {"rows": 3, "bytes": 15 + 18, "ips": 3, "emails": 1}
    assert {r.metric: r.n for r in progress.totals(spark, seen).collect()} == want
    src = str(tmp_path / "in")
    docs.repartition(3).write.parquet(src)
    log = progress.ProgressLog("told")
    spark.streams.addListener(log)
    read = stream.stream_parquet(spark, src, "doc_id long, text string", files_per_trigger=1)
    stream.run_available(progress.extract_observed(read, "told", types=["ips", "emails"]), str(tmp_path / "out"), str(tmp_path / "check"))
    told = log.table(spark)
    spark.streams.removeListener(log)
    assert {r.metric: r.n for r in told.groupBy("metric").agg(F.sum("n").alias("n")).collect()} == want
