"""WARC as a Python data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Reading plans partitions from the list of files (small ones share a partition) and takes over
filters on the columns that come from headers, record type among them. Per record the header is
parsed first; a record that the filters reject is skipped, its payload never decoded: a plain one by
its length, a compressed one by the length that the writer notes in the gzip extra field "sl" (without
that note it is inflated and dropped piece by piece). The option ``payload`` says what to do with
wanted payloads: ``full`` returns them, ``digest`` only measures and hashes them, ``none`` leaves them alone.

Writing compresses every record as a gzip member of its own and starts a new file after
``filebytes``. A task writes under a name of its own; the commit on the driver lists the files of the
successful attempts in a manifest, which readers go by, so what a lost or repeated task left behind
is never read.

Both sides open files through pyarrow's file systems, from the folder named by the caller, which
executors and driver must share.

Defined results: a null payload counts as empty; control characters and spaces in an address are
percent-encoded, a null address has no header; an empty table writes no record; a damaged record
raises an error that names its file and offset.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, In, InputPartition, IsNotNull, IsNull, Not,
    StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage)

from paddock.llm.common import scratch, table

READ_SCHEMA = ("record_id string, record_type string, target_uri string, refers_to string, date string, content_type string, "
               "content_length bigint, payload_bytes bigint, payload_digest string, payload binary, headers map<string,string>")
READ_ARROW = pa.schema([(c, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}.get(t, pa.map_(pa.string(), pa.string())))
                        for c, t in (x.split() for x in READ_SCHEMA.split(", "))])
WRITE_SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload binary"
# The header behind each column that filters may use.
COLUMN_HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri",
                  "refers_to": "warc-refers-to", "date": "warc-date", "content_type": "content-type"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"  # the tables hold no time of capture
FILE_BYTES, PARTITION_BYTES, BATCH_BYTES = 64 << 20, 32 << 20, 8 << 20
_LENGTH_HEADER = "x-payload-length"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _open(path: str) -> tuple[fs.FileSystem, str]:
    path = re.sub(r"^file:/*", "/", path)
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


# --- records -------------------------------------------------------------------------------------

def record(kind: str, record_id: str, uri: str | None, refers_to: str | None, payload: bytes) -> bytes:
    """One uncompressed record. A revisit carries the HTTP header alone."""
    block = HTTP + payload if kind == "response" else HTTP if kind == "revisit" else payload
    lines = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), f"WARC-Record-ID: <{record_id}>".encode(), b"WARC-Date: " + DATE.encode()]
    if uri is not None:
        safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri)
        lines.append(f"WARC-Target-URI: {safe}".encode("utf-8", "replace"))
    if kind in ("response", "revisit"):
        lines += [b"WARC-Payload-Digest: sha1:" + digest(payload).encode(), f"X-Payload-Length: {len(payload)}".encode(),
                  b"Content-Type: application/http; msgtype=response"]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <{refers_to}>".encode(), b"WARC-Profile: " + PROFILE.encode()]
    lines.append(b"Content-Length: %d" % len(block))
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 3) -> bytes:
    """A gzip member with its compressed and plain lengths in the extra field "sl"."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    packed = z.compress(data) + z.flush()
    extra = b"sl" + struct.pack("<HII", 8, len(packed), len(data) & 0xFFFFFFFF)
    return (b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + packed
            + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF))


def _parse(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC version line")
    out: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def _unbracketed(value: str | None) -> str | None:
    return value[1:-1] if value and value[0] == "<" and value[-1] == ">" else value


def read_records(f, wanted) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, block) of every record that ``wanted`` accepts by its headers; ``wanted`` returns
    None to skip the record, False for the headers alone, True for the block as well."""
    r = f if isinstance(f, io.BufferedReader) else io.BufferedReader(f, 1 << 20)
    while magic := r.read(2):
        r.seek(-len(magic), io.SEEK_CUR)
        yield from (_packed_record(r, wanted) if magic == b"\x1f\x8b" else _plain_record(r, wanted))


def _plain_record(r: io.BufferedReader, wanted) -> Iterator[tuple[dict[str, str], bytes | None]]:
    head = bytearray()
    while not head.endswith(b"\r\n\r\n"):
        line = r.readline()
        if not line:
            if head.strip():
                raise ValueError("the file ends within a header")
            return
        if head or line.strip():  # empty lines between records
            head += line
    headers = _parse(bytes(head[:-4]))
    size, want = int(headers["content-length"]), wanted(headers)
    if want:
        block = r.read(size)
        if len(block) < size:
            raise ValueError("the file ends within a record")
        yield headers, block
    else:
        r.seek(size, io.SEEK_CUR)
        if want is not None:
            yield headers, None


def _packed_record(r: io.BufferedReader, wanted) -> Iterator[tuple[dict[str, str], bytes | None]]:
    start = r.read(10)
    flags, size = start[3], None
    if flags & 4:
        extra = r.read(struct.unpack("<H", r.read(2))[0])
        while len(extra) >= 4:
            n = struct.unpack("<H", extra[2:4])[0]
            if extra[:2] == b"sl" and n == 8:
                size = struct.unpack("<I", extra[4:8])[0]
            extra = extra[4 + n:]
    for flag in (8, 16):  # name and comment, up to a zero byte
        if flags & flag:
            while r.read(1) not in (b"\0", b""):
                pass
    if flags & 2:
        r.read(2)
    z, out, taken = zlib.decompressobj(-15), bytearray(), 0
    while b"\r\n\r\n" not in out and not z.eof:  # the header first
        chunk = z.unconsumed_tail or r.read(min(2048, size - taken) if size is not None else 2048)
        if not chunk:
            raise ValueError("the file ends within a record")
        taken += 0 if z.unconsumed_tail else len(chunk)
        out += z.decompress(chunk, 4096)
    head, _, block = bytes(out).partition(b"\r\n\r\n")
    headers = _parse(head)
    want = wanted(headers)
    length = int(headers["content-length"])
    if not want and size is not None:
        r.seek(size - taken + 8, io.SEEK_CUR)  # with the check sums
    else:
        parts, have, check = [block], len(block), zlib.crc32(out)
        while not z.eof:
            chunk = z.unconsumed_tail or r.read(min(1 << 16, size - taken) if size is not None else 1 << 16)
            if not chunk:
                raise ValueError("the file ends within a record")
            taken += 0 if z.unconsumed_tail else len(chunk)
            more = z.decompress(chunk, 1 << 20)
            check = zlib.crc32(more, check)
            if want:
                parts.append(more)
            have += len(more)
        spare = len(z.unused_data)
        if spare:
            r.seek(-spare, io.SEEK_CUR)
        if have < length or struct.unpack("<I", r.read(8)[:4])[0] != check:
            raise ValueError("a record is damaged")
        if want:
            block = b"".join(parts)[:length]
    if want is not None:
        yield headers, block if want else None


# --- data source ---------------------------------------------------------------------------------

@dataclass
class Files(InputPartition):
    names: tuple[str, ...]


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


def _test(f):
    """A filter on header columns as a function of a dictionary of columns, or None."""
    if isinstance(f, Not):
        inner = _test(f.child)
        if inner is None:
            return None
        positive = f.child
        return lambda c: not inner(c) and (isinstance(positive, (IsNull, IsNotNull, EqualNullSafe)) or c[positive.attribute[0]] is not None)
    name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
    if name not in COLUMN_HEADERS:
        return None
    if isinstance(f, (EqualTo, EqualNullSafe)):
        return lambda c: c[name] == f.value and (f.value is not None or isinstance(f, EqualNullSafe))
    if isinstance(f, In):
        return lambda c: c[name] is not None and c[name] in f.value
    if isinstance(f, StringStartsWith):
        return lambda c: c[name] is not None and c[name].startswith(f.value)
    if isinstance(f, StringEndsWith):
        return lambda c: c[name] is not None and c[name].endswith(f.value)
    if isinstance(f, StringContains):
        return lambda c: c[name] is not None and f.value in c[name]
    if isinstance(f, IsNull):
        return lambda c: c[name] is None
    if isinstance(f, IsNotNull):
        return lambda c: c[name] is not None
    return None


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "full")
        self.limit = int(options.get("partitionbytes", PARTITION_BYTES))
        if self.payload not in ("full", "digest", "none"):
            raise ValueError(f"payload must be full, digest or none, not {self.payload!r}")
        self.filters: list = []

    def pushFilters(self, filters):
        for f in filters:
            if _test(f) is None:
                yield f  # left to Spark
            else:
                self.filters.append(f)

    def partitions(self):
        system, root = _open(self.path)
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        lists = [x for x in found if x.base_name.startswith("_manifest-")]
        names: set[str] = set()
        for x in lists:
            with system.open_input_stream(x.path) as f:
                names |= set(f.read().decode().split())
        files = sorted((x for x in found if (x.base_name in names if lists else re.search(r"\.warc(\.gz)?$", x.base_name))),
                       key=lambda x: x.path)
        out, group, size = [], [], 0
        for x in files:
            if group and size + x.size > self.limit:
                out.append(Files(tuple(group)))
                group, size = [], 0
            group.append(x.path)
            size += x.size
        if group or not out:
            out.append(Files(tuple(group)))
        return out

    def read(self, partition):
        system, _ = _open(self.path)
        tests = [_test(f) for f in self.filters]
        rows: list[tuple] = []
        held = 0

        def columns(headers):
            return {c: (_unbracketed(headers.get(h)) if c in ("record_id", "refers_to") else headers.get(h))
                    for c, h in COLUMN_HEADERS.items()}

        def wanted(headers):
            c = columns(headers)
            if not all(t(c) for t in tests):
                return None
            return self.payload != "none" and c["record_type"] != "revisit"

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), READ_ARROW.types, strict=True)], schema=READ_ARROW)

        for name in partition.names:
            with system.open_input_file(name) as raw:
                r = io.BufferedReader(raw, 1 << 20)
                try:
                    for headers, block in read_records(r, wanted):
                        c = columns(headers)
                        size, sha = headers.get(_LENGTH_HEADER), headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
                        size = int(size) if size is not None else None
                        body = block
                        if block is not None:
                            if (c["content_type"] or "").startswith("application/http"):
                                body = block.partition(b"\r\n\r\n")[2]
                            size, sha = len(body), digest(body)
                        full = body if self.payload == "full" else None
                        rows.append((*(c[k] for k in ("record_id", "record_type", "target_uri", "refers_to", "date", "content_type")),
                                     int(headers["content-length"]), size, sha, full, list(headers.items())))
                        held += len(full or b"") + 500
                        if held > BATCH_BYTES:
                            yield batch()
                            rows, held = [], 0
                except (ValueError, KeyError, zlib.error, struct.error) as e:
                    raise ValueError(f"{name}, before byte {r.tell()}: {e}") from e
        if rows:
            yield batch()


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.packed = options.get("compression", "gzip") == "gzip"
        self.limit = int(options.get("filebytes", FILE_BYTES))

    def write(self, iterator):
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        names, out, size, token = [], None, 0, uuid.uuid4().hex
        pack = member if self.packed else bytes
        try:
            for b in iterator:
                fields = [b.column(n).to_pylist() for n in ("record_type", "record_id", "target_uri", "refers_to", "payload")]
                for kind, record_id, uri, refers_to, payload in zip(*fields, strict=True):
                    if out is None:
                        names.append(f"part-{token}-{len(names):05d}.warc" + ".gz" * self.packed)
                        out = system.open_output_stream(f"{root}/{names[-1]}", compression=None)
                        size = out.write(pack(record("warcinfo", f"urn:uuid:{uuid.uuid4()}", None, None, b"software: paddock\r\n")))
                    size += out.write(pack(record(kind, record_id, uri, refers_to, payload or b"")))
                    if size >= self.limit:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages):
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}") as f:
            f.write("\n".join(n for m in messages if m for n in m.names).encode())

    def abort(self, messages):
        """Files of a failed write stay outside every manifest, and so are never read."""


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return READ_SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def write_warc(records: DataFrame, path: str, **options) -> None:
    """Write rows with the columns of ``WRITE_SCHEMA``."""
    records.sparkSession.dataSource.register(WarcSource)
    names = T.StructType.fromDDL(WRITE_SCHEMA).names
    records.select(*names).write.format("warc").mode("append").options(**options).save(path)


def read_warc(spark: SparkSession, path: str, **options) -> DataFrame:
    """The records below ``path``; filters on header columns are applied while reading.

    Spark 4.1 keeps the filters that it has pushed with the relation, so that a second, different
    use of one DataFrame would read by the first one's filters: call this once for each use."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").options(**options).load(path)


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 min_bytes: int = 0) -> DataFrame:
    """Records for pages. Among equal payloads of at least ``min_bytes`` bytes the page with the
    largest id is the response and others revisit it; rows that repeat that id are responses too.
    Digests are grouped first; the join that brings the kept ids back shuffles all rows by digest, payloads included."""
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).cast("string").alias("target_uri"),
                        F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    copies = (rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha")
              .agg(F.max("page").alias("kept"), F.count("*").alias("n")).where("n > 1").select("sha", "kept"))
    own = F.col("kept").isNull() | F.col("page").eqNullSafe(F.col("kept"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return rows.join(copies, "sha", "left").select(
        urn("page").alias("record_id"), F.when(own, "response").otherwise("revisit").alias("record_type"), "target_uri",
        F.when(~own, urn("kept")).alias("refers_to"), "payload")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_warc(page_records(table(spark, sf_dir, "pages")), path)
    back = read_warc(spark, path, payload="digest").where(F.col("record_type").isin("response", "revisit"))
    page = lambda c: F.expr(f"try_cast(substring({c}, {len('urn:page:') + 1}) AS BIGINT)")
    return back.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                       page("refers_to").alias("refers_to"))


# The payload's digest in base32 has no SQL function; the twin maps the digest's bits five at a time.
OP9_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS x FROM p),
d AS (SELECT page_id, n, x, list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + CAST(((CAST(('0x' || substr(x || '0000', 1 + (5 * i) // 4, 3)) AS INTEGER) >> (7 - (5 * i) % 4)) & 31) AS INTEGER), 1)),
  lambda a, c: a || c) AS digest FROM h),
g AS (SELECT x, max(page_id) AS kept FROM d GROUP BY x)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = kept THEN NULL ELSE kept END AS refers_to FROM d JOIN g USING (x)"""
