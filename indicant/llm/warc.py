"""WARC archives: a distributed writer and a PySpark Python data source.

The reader takes any folder of .warc and .warc.gz files.  Headers are parsed first; payloads
that are not wanted are skipped: in plain files by a seek, in gzip files by inflating on
without keeping.  The writer puts one gzip member a record, whose extra field "sl" gives its
compressed size, so that its payloads are skipped by a seek as well; other tools read its
files as ordinary .warc.gz.  Its manifest lists the files that count and places to split them.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThanOrEqual

from .common import prepare, shared_dir, stored

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROTATE_BYTES, SPLIT_BYTES = 256 << 20, 64 << 20
BATCH_BYTES = 4 << 20
SALTS = 16
HEADER = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "content_type": "Content-Type", "page_id": "X-Page-ID", "payload_bytes": "X-Payload-Length"}
FIELDS = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("content_type", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])


def filesystem(path: str):
    """(Arrow file system, path in it) of a URI; every store that Arrow knows, the cluster's shared folder included."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def clean(value: object) -> str:
    """A header value on one line."""
    return "".join(f"%{ord(c):02X}" if c in "\r\n" else c for c in str(value))


def record(headers: dict[str, object], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {clean(v)}" for k, v in headers.items() if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    """A gzip member whose extra field "sl" holds its own size."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    size = 10 + 2 + 4 + 8 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H2sHQ", 12, b"sl", 8, size)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def plan_records(pages: DataFrame, min_dedup: int, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """Pages with payload, digest, size and, for all but the largest id of equal payloads, the id they refer to.

    The join is salted: a payload that a third of all pages share is spread over SALTS tasks.
    """
    base = pages.select(pages[id_col].cast("long").alias("id"), pages[url_col].alias("url"), F.coalesce(pages[payload_col], F.lit("")).alias("payload")).withColumns(
        {"digest": F.sha1(F.col("payload").cast("binary")), "size": F.octet_length("payload").cast("long")}
    )
    first = base.filter(F.col("size") >= min_dedup).groupBy("digest").agg(F.max("id").alias("keeper"), F.count("*").alias("n")).filter("n > 1").drop("n")
    salted = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("digest", "d").withColumnRenamed("salt", "s")
    keyed = base.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    return keyed.join(salted, (keyed.digest == salted.d) & (keyed.salt == salted.s), "left").select(
        "id", "url", "payload", "digest", "size", F.when(~F.col("keeper").eqNullSafe(F.col("id")), F.col("keeper")).alias("refers_to")
    )


def write_warc(pages: DataFrame, where: str, min_dedup: int = 1000, level: int = 1, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write one record per page into archives in the folder ``where``; returns the stored manifest (path, n_records, splits).

    Of records with equal payloads of at least ``min_dedup`` bytes, that with the largest id
    is a response and the others revisit it; smaller ones are all responses.  Null payloads
    are empty; a null URL or id is left out of the headers; rows with the keeper's id and
    payload are responses too; extra columns are ignored; an empty table writes no record.
    A task that is run again writes new files: only files in the manifest count, so
    lost executors and repeated attempts leave no double records.
    """
    spark = prepare(pages.sparkSession)

    def run(batches):
        fs, folder = filesystem(where)
        fs.create_dir(folder, recursive=True)
        out, name, n, size, splits, done = None, "", 0, 0, [], []
        for b in batches:
            for r in b.to_pylist():
                if out is None:
                    name, n, size, splits = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0, [0]
                    out = fs.open_output_stream(name, compression=None)
                revisit = r["refers_to"] is not None
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
                headers = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": date, "WARC-Target-URI": r["url"], "WARC-Payload-Digest": f"sha1:{r['digest']}", "WARC-Profile": PROFILE if revisit else None, "WARC-Refers-To": f"<urn:page:{r['refers_to']}>" if revisit else None, "Content-Type": "application/http; msgtype=response", "X-Page-ID": r["id"], "X-Payload-Length": r["size"]}
                data = member(record(headers, http if revisit else http + r["payload"].encode()), level)
                if size >= splits[-1] + SPLIT_BYTES:
                    splits.append(size)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= ROTATE_BYTES:
                    out.close()
                    done.append((name, n, splits))
                    out = None
        if out is not None:
            out.close()
            done.append((name, n, splits))
        if done:
            schema = pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("splits", pa.list_(pa.int64()))])
            yield pa.RecordBatch.from_pylist([{"path": p, "n_records": k, "splits": at} for p, k, at in done], schema=schema)

    return stored(plan_records(pages, min_dedup, id_col, url_col, payload_col).mapInArrow(run, "path string, n_records long, splits array<long>"), where, "manifest.parquet")


@dataclass
class ArchivePartition(InputPartition):
    """Records that start in [start, end) of a file; end None: to its end."""

    path: str
    start: int = 0
    end: int | None = None


@dataclass
class Wanted:
    """Predicates that are settled on header values: column -> allowed values, inclusive bounds, columns that must be set."""

    allowed: dict[str, set] = field(default_factory=dict)
    least: dict[str, object] = field(default_factory=dict)
    most: dict[str, object] = field(default_factory=dict)
    present: set[str] = field(default_factory=set)

    def take(self, f: Filter) -> bool:
        name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
        if name not in HEADER:
            return False
        if isinstance(f, (EqualTo, In)):
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.allowed[name] = self.allowed.get(name, values) & values
        elif isinstance(f, GreaterThanOrEqual):
            self.least[name] = max(self.least.get(name, f.value), f.value)
        elif isinstance(f, LessThanOrEqual):
            self.most[name] = min(self.most.get(name, f.value), f.value)
        elif isinstance(f, IsNotNull):
            self.present.add(name)
        else:
            return False
        return True

    def fits(self, row: dict) -> bool:
        get = row.get
        return (
            all(get(k) in v for k, v in self.allowed.items()) and all(get(k) is not None for k in self.present)
            and all(get(k) is not None and get(k) >= v for k, v in self.least.items()) and all(get(k) is not None and get(k) <= v for k, v in self.most.items())
        )


def parse_headers(block: bytes) -> dict[str, str]:
    """Headers by lower-case name; a line that starts with white space goes on with the one before."""
    lines = re.sub(r"\r\n[ \t]+", " ", block.decode("utf-8", "replace")).split("\r\n")
    return dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:]) if k)


def columns(headers: dict[str, str]) -> dict:
    row: dict = {c: headers.get(h.lower()) for c, h in HEADER.items()}
    for c in ("page_id", "payload_bytes"):
        row[c] = int(row[c]) if row[c] is not None and re.fullmatch("-?[0-9]+", row[c]) else None
    if row["payload_digest"]:
        row["payload_digest"] = row["payload_digest"].rpartition(":")[2].lower()
    return row


class Plain:
    """An uncompressed archive: reads, and skips by a seek."""

    def __init__(self, f):
        self.f = f

    def read(self, n: int) -> bytes:
        return self.f.read(n)

    def skip(self, n: int) -> None:
        self.f.seek(n, io.SEEK_CUR)


class Inflated:
    """A gzip archive of any number of members as one stream; what is skipped is inflated in bounded pieces."""

    def __init__(self, f):
        self.f, self.z, self.fed, self.out = f, None, b"", b""

    def more(self) -> bool:
        """Inflate some more; False at the end of the file."""
        while True:
            if not self.fed:
                self.fed = self.f.read(1 << 16)
                if not self.fed:
                    if self.z is not None:
                        raise EOFError("the archive ends inside a gzip member")
                    return False
            if self.z is None:
                self.fed = self.fed.lstrip(b"\0")  # padding between members
                if not self.fed:
                    continue
                self.z = zlib.decompressobj(31)
            got = self.z.decompress(self.fed, 1 << 18)
            if self.z.eof:
                self.fed, self.z = self.z.unused_data, None
            else:
                self.fed = self.z.unconsumed_tail
            if got:
                self.out += got
                return True

    def read(self, n: int) -> bytes:
        parts, left = [], n
        while left > 0 and (self.out or self.more()):
            parts.append(self.out[:left])
            left -= len(parts[-1])
            self.out = self.out[len(parts[-1]) :]
        return b"".join(parts)

    def skip(self, n: int) -> None:
        while n > 0 and (self.out or self.more()):
            cut = min(n, len(self.out))
            self.out, n = self.out[cut:], n - cut


class Sized:
    """One member of write_warc, whose size is known: skipping inflates nothing."""

    def __init__(self, f, left: int):
        self.f, self.left, self.z, self.fed = f, left, zlib.decompressobj(-15), b""

    def read(self, n: int) -> bytes:
        parts, missing = [], n
        while missing > 0 and not self.z.eof:
            if not self.fed:
                self.fed = self.f.read(min(1 << 12 if n < 1 << 12 else 1 << 16, self.left))
                self.left -= len(self.fed)
                if not self.fed:
                    raise EOFError("the archive ends inside a gzip member")
            parts.append(self.z.decompress(self.fed, missing))
            missing -= len(parts[-1])
            self.fed = self.z.unconsumed_tail
        return b"".join(parts)

    def skip(self, n: int) -> None:
        pass


MAX_HEADER = 16 << 20


def read_headers(source) -> tuple[dict[str, str] | None, bytes]:
    """The next record's headers, None at the end, and what was read of its block."""
    got = b""
    while True:
        part = source.read(2048)
        got = got + part if got else part.lstrip(b"\r\n")
        end = got.find(b"\r\n\r\n")
        if end >= 0:
            if not got.startswith(b"WARC/"):
                raise ValueError(f"no WARC record where one should start: {got[:40]!r}")
            return parse_headers(got[:end]), got[end + 4 :]
        if not part:
            if got:
                raise ValueError(f"a record without an end of headers: {got[:40]!r}")
            return None, b""
        if len(got) > MAX_HEADER:
            raise ValueError(f"record headers over {MAX_HEADER} bytes")


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """The block without the HTTP headers of a captured message."""
    http = headers.get("content-type", "").lower().startswith("application/http")
    return block.partition(b"\r\n\r\n")[2] if http else block


def settled(source, headers: dict[str, str], rest: bytes, wanted: Wanted, payload: bool, verify: bool) -> dict | None:
    """The record's row if it fits; its block has been read or skipped afterwards."""
    row, size = columns(headers), int(headers.get("content-length", "0"))
    if not wanted.fits(row):
        source.skip(size - len(rest))
        return None
    row |= {"headers": list(headers.items()), "payload": None}
    if (payload or verify) and row["record_type"] != "revisit":
        body = payload_of(headers, (rest + source.read(size - len(rest)))[:size])
        if verify:
            row["payload_digest"], row["payload_bytes"] = hashlib.sha1(body).hexdigest(), len(body)
        row["payload"] = body if payload else None
    else:
        source.skip(size - len(rest))
    return row


class Pushed:
    """A source with bytes put back before it: what was read beyond a record."""

    def __init__(self, source):
        self.source, self.front = source, b""

    def read(self, n: int) -> bytes:
        out, self.front = self.front[:n], self.front[n:]
        return out + self.source.read(n - len(out)) if len(out) < n else out

    def skip(self, n: int) -> None:
        cut = min(n, len(self.front))
        self.front = self.front[cut:]
        if n > cut:
            self.source.skip(n - cut)


def read_archive(f, wanted: Wanted, payload: bool, verify: bool, start: int = 0, end: int | None = None) -> Iterator[dict]:
    """Records that fit and start in [start, end), headers first."""
    f.seek(start)
    head = f.read(24)
    f.seek(start)
    if head[:2] != b"\x1f\x8b":
        yield from read_stream(Pushed(Plain(f)), wanted, payload, verify)
        return
    at = start
    while end is None or at < end:
        head = f.read(24)
        if not head:
            return
        if not (len(head) == 24 and head[:2] == b"\x1f\x8b" and head[3] == 4 and head[12:14] == b"sl"):
            f.seek(at)  # from here on members do not say their size
            yield from read_stream(Pushed(Inflated(f)), wanted, payload, verify)
            return
        size = struct.unpack("<Q", head[16:24])[0]
        source = Sized(f, size - 24 - 8)
        headers, rest = read_headers(source)
        row = settled(source, headers, rest, wanted, payload, verify) if headers is not None else None
        if row is not None:
            yield row
        at += size
        f.seek(at)


def read_stream(source: Pushed, wanted: Wanted, payload: bool, verify: bool) -> Iterator[dict]:
    while True:
        headers, rest = read_headers(source)
        if headers is None:
            return
        size = int(headers.get("content-length", "0"))
        source.front = rest[size:] + source.front
        row = settled(source, headers, rest[:size], wanted, payload, verify)
        if row is not None:
            yield row


def archives(fs, folder: str) -> list[ArchivePartition]:
    """Partitions of a folder: the files and splits of its manifest or, without one, every archive below it."""
    import pyarrow.dataset as ds
    from pyarrow.fs import FileSelector

    if fs.get_file_info(f"{folder}/manifest.parquet").type.name == "Directory":
        rows = ds.dataset(f"{folder}/manifest.parquet", filesystem=fs, format="parquet").to_table(columns=["path", "splits"]).to_pylist()
        return [ArchivePartition(r["path"], a, b) for r in sorted(rows, key=lambda r: r["path"]) for a, b in zip(r["splits"], [*r["splits"][1:], None])]
    if fs.get_file_info(folder).type.name == "File":
        return [ArchivePartition(folder)]
    names = sorted(f.path for f in fs.get_file_info(FileSelector(folder, recursive=True)) if f.type.name == "File" and f.path.lower().endswith((".warc", ".warc.gz")))
    if not names:
        raise FileNotFoundError(f"no .warc or .warc.gz file in {folder}")
    return [ArchivePartition(p) for p in names]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.verify = str(options.get("verify", "false")).lower() == "true"
        self.wanted = Wanted()

    def pushFilters(self, filters: list[Filter]):
        """Filters on header values are settled here; the rest go back to Spark."""
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def partitions(self):
        """A partition for each file, or each split of a file that the writer noted, planned from metadata alone."""
        return archives(*filesystem(self.folder)) or [ArchivePartition("")]

    def read(self, partition):
        if not partition.path:
            return
        fs, _ = filesystem(self.folder)
        rows, held = [], 0
        with fs.open_input_file(partition.path) as raw:
            for row in read_archive(io.BufferedReader(raw, 1 << 18), self.wanted, self.payload, self.verify, partition.start, partition.end):
                rows.append(row)
                held += len(row["payload"] or b"") + 500
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=FIELDS)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=FIELDS)


class WarcSource(DataSource):
    """spark.read.format("warc").option("payload", "false").load(folder)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, content_type string, page_id long, payload_bytes long, headers map<string,string>, payload binary"

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


def read_warc(spark: SparkSession, where: str, payload: bool = True, verify: bool = False) -> DataFrame:
    """The records of the archives in ``where`` (a folder or one file), of every type.

    verify recomputes digests and sizes from the payloads.  The payload is the block, without
    the HTTP headers of a captured message; revisits have none.  Headers that a record lacks
    are null, so are page_id and payload_bytes that are no numbers.  A folder without archives
    raises, one whose manifest names no file gives no rows; a damaged archive raises.
    """
    prepare(spark)
    if "spark.sql.python.filterPushdown.enabled" not in spark.conf.getAll:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("verify", str(verify).lower()).load(where)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write every page to archives in the shared folder and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    where = shared_dir(spark)
    write_warc(pages, where)
    back = read_warc(spark, where, payload=False, verify=True).filter(F.col("record_type").isin("response", "revisit"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", F.regexp_extract("refers_to", "(-?[0-9]+)>$", 1).try_cast("long").alias("refers_to"))
