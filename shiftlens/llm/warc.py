"""WARC archives: a writer, and a PySpark Python data source that reads them.

Pages are grouped by their payload's hash, so one payload of each kind is shuffled
however many pages share it; of equal payloads of at least ``least`` bytes the page
with the largest page_id is the response and the others are revisits without payload.
Each record is a gzip member of its own, whose skip-lengths field (``sl``, of the WARC
standard's annex on compression) says how far the next one is. A task writes hidden
files, which are renamed once the whole job has succeeded and deleted where it failed.

Reading: the source plans partitions of whole files up to a size, takes predicates on
the record type and on header fields, inflates and parses a record's headers first, and
skips by seeking the rest of records that a predicate rejects, and payloads not asked
for. Archives that aren't compressed are read as well. Paths may be local or of any
store that pyarrow reaches (HDFS, S3, GCS).

Defined results: null html is an empty payload; a null page_id is kept as null and is
the smallest; of rows that repeat the largest page_id one is the response and the rest
revisit it; a null url has no target; control characters in a url are percent-encoded;
an empty table gives an archive without records and an empty result.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from .common import new_path

END = "\r\n"
SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_length long, payload binary"
#: Header fields by column.
HEADERS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes read, before inflating, for a record's headers, and then at a time.
HEAD, MORE = 1 << 10, 1 << 16
FILE_BYTES = 256 << 20


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 (RFC 4648) of the SHA-1, from the hex digits five at a time."""
    digest = F.sha1(data)
    fives = [F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*fives), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def clean_uri(url: Column) -> Column:
    for k in [*range(33), 127]:
        url = F.replace(url, F.lit(chr(k)), F.lit(f"%{k:02X}"))
    return url


def records_of(pages: DataFrame, least: int = 0) -> DataFrame:
    """The text of each record, a row per page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("bytes", F.octet_length("html")).withColumn("key", F.sha2(F.col("html").cast("binary"), 256))
    alone = F.when(F.col("bytes") < least, F.monotonically_increasing_id())
    rows = rows.withColumn("alone", alone if least > 0 else F.lit(None).cast("long"))
    group = ["key", "alone"]

    # one payload a group; null ids sort first, so the largest id wins over none
    best = F.struct(F.col("page_id").isNotNull().alias("some"), "page_id", "url")
    firsts = rows.groupBy(*group).agg(F.max(best).alias("best"), F.max("html").alias("html"), F.max("bytes").alias("bytes"))
    digest = base32_sha1(F.col("html").cast("binary"))
    responses = firsts.select(F.col("best.page_id").alias("page_id"), F.col("best.url").alias("url"), "html", "bytes", digest.alias("digest"))

    narrow = rows.select(*group, "page_id", "url", "bytes", base32_sha1(F.col("html").cast("binary")).alias("digest"))
    targets = firsts.select(F.col("key").alias("_key"), F.col("alone").alias("_alone"), F.col("best.page_id").alias("target"), F.col("best.url").alias("target_url"))
    counted = narrow.groupBy(*group, "page_id", "url").agg(F.count(F.lit(1)).alias("n"), F.max("bytes").alias("bytes"), F.max("digest").alias("digest"))
    joined = counted.join(targets, (F.col("key") == F.col("_key")) & F.col("alone").eqNullSafe(F.col("_alone")))
    is_first = F.col("page_id").eqNullSafe(F.col("target")) & F.col("url").eqNullSafe(F.col("target_url"))
    joined = joined.withColumn("n", F.col("n") - F.when(is_first, 1).otherwise(0)).where("n > 0")
    revisits = joined.select("page_id", "url", "bytes", "digest", "target", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))

    one = responses.select(record("response", "page_id", "url", "bytes", "digest", F.col("html"), F.lit(0)).alias("value"))
    two = revisits.select(record("revisit", "page_id", "url", "bytes", "digest", F.lit(""), F.col("copy"), F.col("target")).alias("value"))
    return one.unionByName(two)


def urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def record(kind: str, page_id: str, url: str, size: str, digest: str, payload: Column, copy: Column, target: Column | None = None) -> Column:
    """One WARC/1.1 record, without the two line ends that close it."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col(size).cast("string"), F.lit(END + END))
    block = F.concat(http, payload)
    lines = [
        F.lit("WARC/1.1"),
        F.lit(f"WARC-Type: {kind}"),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col(page_id).cast("string"), F.lit("")), F.when(copy > 0, F.concat(F.lit("#"), copy.cast("string"))).otherwise(F.lit("")), F.lit(">")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Target-URI: "), clean_uri(F.col(url))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col(digest)),
        *([] if target is None else [F.lit(f"WARC-Profile: {PROFILE}"), F.concat(F.lit("WARC-Refers-To: "), urn(target))]),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws(END, *lines), F.lit(END + END), block)


def write_archives(pages: DataFrame, path: str, least: int = 0) -> None:
    """Write one record per page into compressed WARC files in the folder."""
    pages.sparkSession.dataSource.register(WarcSource)
    records_of(pages, least).write.format("warc").option("path", path).mode("append").save()


def member(data: bytes) -> bytes:
    """A gzip member with its skip lengths: its own size and that of the data (0: too large to say)."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    total = 24 + len(body) + 8
    lengths = (total, len(data)) if max(total, len(data)) < 1 << 32 else (0, 0)
    return b"\x1f\x8b\x08\x04" + b"\0" * 5 + b"\xff" + struct.pack("<H2sHII", 12, b"sl", 8, *lengths) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    files: tuple[str, ...]


class WarcWriter(DataSourceArrowWriter):
    """Writes rows of one column, the records' texts."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = store(self.path)
        system.create_dir(root, recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            for cell in batch.column(0):
                if out is None or size >= FILE_BYTES:
                    if out:
                        out.close()
                    files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = system.open_output_stream(f"{root}/_{files[-1]}", compression=None), 0
                data = member(cell.as_py().encode("utf-8", "surrogatepass") + (END + END).encode())
                out.write(data)
                size += len(data)
        if out:
            out.close()
        return Written(tuple(files))

    def commit(self, messages: list[Written | None]) -> None:
        system, root = store(self.path)
        system.create_dir(root, recursive=True)
        for m in messages:
            for name in m.files if m else ():
                system.move(f"{root}/_{name}", f"{root}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        system, root = store(self.path)
        for m in messages:
            for name in m.files if m else ():
                system.delete_file(f"{root}/_{name}")


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


def store(uri: str):
    """The file system and path of a URI or an absolute path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class WarcSource(DataSource):
    """Options: path (a file or folder), payload ("false" leaves payloads unread), split_bytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.split = int(options.get("split_bytes", 32 << 20))
        self.tests: list[tuple[str, str, object]] = []  # header field, how, value

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            field = HEADERS.get(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
            if field and isinstance(f, EqualTo):
                self.tests.append((field, "in", frozenset([f.value])))
            elif field and isinstance(f, In):
                self.tests.append((field, "in", frozenset(f.value)))
            elif field and isinstance(f, StringStartsWith):
                self.tests.append((field, "starts", f.value))
            elif field and isinstance(f, IsNotNull):
                self.tests.append((field, "some", None))
            else:
                yield f

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, root = store(self.path)
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else ("file:" if self.path.startswith("file:") else "")
        authority = self.path.split("://")[1].split("/")[0] if "://" in self.path and not self.path.startswith("file") and scheme in ("hdfs://", "viewfs://") else ""
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.size and f.base_name[0] not in "._")
        out, held, size = [], [], 0
        for path, n in files:
            if held and size + n > self.split:
                out.append(Files(tuple(held)))
                held, size = [], 0
            held.append(f"{scheme}{authority}{path}")
            size += n
        return [*out, Files(tuple(held))] if held or not out else out

    def wanted(self, head: dict[str, str]) -> bool:
        for field, how, value in self.tests:
            have = header(head, field)
            if have is None or how == "in" and have not in value or how == "starts" and not have.startswith(value):
                return False
        return True

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for path in partition.paths:
            system, name = store(path)
            with system.open_input_file(name) as raw:
                for row in self.records(raw):
                    rows.append(row)
                    size += len(row[-1] or b"") + 500
                    if size > 1 << 23:
                        yield pack(rows)
                        rows, size = [], 0
        yield pack(rows)

    def records(self, raw) -> Iterator[tuple]:
        """Headers first; the rest is read, and inflated, only if the record and its payload are wanted."""
        at, end = 0, raw.size()
        while at < end:
            data = Bytes(raw, at, end)
            head, body = data.head(0)
            length = int(head["content-length"])
            at = data.stop if data.packed else at + body + length + 4
            if not self.wanted(head):
                continue
            http, start = data.head(body) if head.get("content-type", "").startswith("application/http") else ({}, body)
            n = int(http.get("content-length", body + length - start))
            payload = None
            if self.payload and head["warc-type"] != "revisit":
                payload = data.slice(start, body + length)
                if len(payload) != n:
                    raise ValueError(f"record {head.get('warc-record-id')}: {len(payload)} bytes of payload, not {n}")
            yield (*(header(head, field) for field in HEADERS.values()), n, payload)


class Bytes:
    """A record's bytes, read and inflated only as far as they are asked for."""

    def __init__(self, raw, at: int, end: int):
        raw.seek(at)
        lead = raw.read(min(24, end - at))
        self.raw, self.at, self.stop, self.data = raw, at, end, bytearray()
        self.packed = lead[:4] == b"\x1f\x8b\x08\x04" and lead[12:14] == b"sl"
        if lead[:2] == b"\x1f\x8b":
            total = struct.unpack("<I", lead[16:20])[0] if self.packed else 0
            if not total:
                raise ValueError(f"the gzip member at byte {at} doesn't say its length")
            self.at, self.stop = at + 24, at + total
        self.inflate = zlib.decompressobj(-15) if self.packed else None

    def grow(self, n: int) -> bool:
        self.raw.seek(self.at)
        block = self.raw.read(min(n, self.stop - self.at))
        self.at += len(block)
        self.data += self.inflate.decompress(block) if self.inflate else block
        return bool(block)

    def head(self, start: int) -> tuple[dict[str, str], int]:
        """The fields (names in lower case) of the head at an offset, and where its body begins."""
        while (stop := self.data.find(b"\r\n\r\n", start)) < 0:
            if not self.grow(HEAD):
                raise ValueError("a record's headers don't end")
        lines = self.data[start:stop].decode("utf-8").split("\r\n")
        fields = lines if start else lines[1:]
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in fields)}, stop + 4

    def slice(self, start: int, stop: int) -> bytes:
        while len(self.data) < stop and self.grow(MORE):
            pass
        return bytes(self.data[start:stop])


def header(head: dict[str, str], field: str) -> str | None:
    """A header's value as the columns show it: digests without the algorithm's name."""
    value = head.get(field)
    return value.removeprefix("sha1:") if value is not None and field == "warc-payload-digest" else value


def pack(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()]
    names = [*HEADERS, "payload_length", "payload"]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records under a path. Predicates on header columns are pushed into the source.

    That needs the engine's option for it, which is set for the session, and stays set, as plans are made later.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).load()


def page_of(record_id: Column) -> Column:
    return F.nullif(F.regexp_extract(record_id, r"^<urn:page:(-?[0-9]*)", 1), F.lit("")).cast("long")


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write the pages, read them back: page_id, payload_bytes, payload_digest, record_type and refers_to.

    Payloads of responses are read and hashed again; a digest that differs raises.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path, least)
    full = read_archives(spark, path).where("record_type = 'response'")
    digest = base32_sha1(F.col("payload"))
    full = full.withColumn("payload_digest", F.when(digest == F.col("payload_digest"), digest).otherwise(F.raise_error(F.concat(F.lit("digest differs: "), F.col("record_id")))))
    full = full.withColumn("payload_length", F.octet_length("payload").cast("long"))
    rest = read_archives(spark, path, payload=False).where("record_type = 'revisit'")
    both = full.drop("payload").unionByName(rest.drop("payload"))
    return both.select(
        page_of(F.col("record_id")).alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", page_of(F.col("refers_to")).alias("refers_to")
    )


ORACLE = r"""
with p as (
  select page_id, coalesce(html, '') as h from pages
), d as (
  select page_id, octet_length(encode(h)) as payload_bytes, sha1(h) as x, max(page_id) over (partition by h) as first from p
)
select page_id, cast(payload_bytes as bigint) as payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(
         (cast('0x' || substr(x, 1 + 5 * cast(i // 4 as bigint), 5) as bigint) >> cast(15 - 5 * (i % 4) as bigint)) & 31 as bigint), 1)), 'string_agg', '') as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id = first then null else first end as refers_to
from d
"""
