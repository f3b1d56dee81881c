"""WARC archives: records in gzip members, written by Spark's text sink and read back by ranges of bytes.

Writing. One aggregate finds payloads that occur more than once, with the smallest id of each; it is joined to the pages by the
hash of the payload. The page with that id becomes a ``response``, the others ``revisit`` records that refer to it and hold no
payload. A record is one gzip member. Spark's text sink writes members as rows, which gives its commits and its stores: the
last byte of a member is the high byte of a length, nought below 16 MB, so the member goes without it and the sink's separator,
a zero byte, puts it back; a longer member is followed by an empty one, which ends in nought. The files are plain archives.

Reading. Files are listed without their content and cut in ranges of bytes, which Spark deals out. The task of a range looks for the
gzip magic; a place counts as a record's start if a member decodes there whose text is the head of a record with a length; it owns
the records that start inside its range, the last of which it reads past the end. After a record the next start is known; where
nothing decodes there, the search goes on. A record counts when its member is whole: lengths and the member's checksum hold.
So each record is read once, whatever the ranges are. Tasks open files by pyarrow's file systems: local and mounted folders, HDFS, S3, GCS.

Edge cases: a null payload is empty; payloads of fewer than ``least`` bytes are always responses; rows that repeat the smallest id of a
payload are all responses; a null id is written as empty and read as null, counts as larger than others, and a payload with null ids alone has
responses only; a null URL is left out, and line ends in one are escaped; other columns aren't written, whatever their names; an empty
table gives no record. A record takes as much space as its page. Not read: files that aren't gzip, members that hold several records, heads
of more than HEAD_BYTES. A payload that is itself an archive and doesn't shrink shows its own members: if a range starts inside of it, they count as records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, column_type, cut, sliced

VERSION, PROFILE = b"WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC, EMPTY_MEMBER = b"\x1f\x8b\x08", zlib.compressobj(6, zlib.DEFLATED, 31).flush()
ID = "<urn:x-page:{}>"
#: Bytes that are read at a time, and of the longest head of a record.
CHUNK, HEAD_BYTES = 65_536, 1_048_576
#: Payloads of which a copy is sent to all tasks when there are too many to send all: those with the most rows.
HOT_PAYLOADS = 10_000
#: Tasks of a read at most; further ranges queue up in them.
MOST_TASKS = 50_000


# Writing ------------------------------------------------------------------------------------------------------------


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def head(fields: list[tuple[str, str | None]], first: bytes) -> bytes:
    lines = [f"{name}: {value}".encode() for name, value in fields if value is not None]
    return b"\r\n".join([first, *lines, b"", b""])


def member(page_id: str, url: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One record as a gzip member that ends in a zero byte."""
    http = head([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))], b"HTTP/1.1 200 OK")
    block = http if refers_to is not None else http + payload
    uri = None if url is None else re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url)
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", ID.format(page_id)), ("WARC-Date", date), ("WARC-Target-URI", uri)]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", ID.format(refers_to))]
    fields += [("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = packer.compress(head(fields, VERSION) + block + b"\r\n\r\n") + packer.flush()
    return out if out.endswith(b"\0") else out + EMPTY_MEMBER


def with_first(rows: DataFrame, least: int) -> DataFrame:
    """``rows`` (id, url, payload) with ``first``: of a payload that occurs more than once the smallest id, else null."""
    keyed = rows.withColumn("hash", F.sha2("payload", 256))
    several = keyed.where(F.length("payload") >= least).groupBy("hash").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    several = cut(several, "payloads")
    count = several.count()
    if count <= BROADCAST_ROWS:
        return keyed.join(F.broadcast(several.drop("n")), "hash", "left").drop("hash")
    hot = several.orderBy(F.desc("n"), "hash").limit(HOT_PAYLOADS)
    led = keyed.join(F.broadcast(hot.select("hash", F.col("first").alias("hot"))), "hash", "left")  # HOT_PAYLOADS rows
    # rows whose payload is led go to the shuffle under keys of their own, which meet nothing
    led = led.withColumn("hash", F.when(F.col("hot").isNull(), F.col("hash")).otherwise(F.concat(F.lit("-"), F.xxhash64("id", "url").cast("string"))))
    rest = several.join(F.broadcast(hot.select("hash")), "hash", "left_anti").drop("n")
    return led.join(rest, "hash", "left").withColumn("first", F.coalesce("hot", "first")).drop("hash", "hot")


def write_archives(pages: DataFrame, path: str, least: int = 0, date: str = "2024-01-01T00:00:00Z", key: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """One record for each row of ``pages``, in archives below ``path``; a file for each partition."""
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    typed = with_first(rows, least)
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    typed = typed.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), "url", "payload", F.when(revisit, F.col("first").cast("string")).alias("refers_to"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 64):
            fields = [batch.column(c) for c in ("id", "url", "payload", "refers_to")]
            members = [member(*(x.as_py() for x in row), date)[:-1] for row in zip(*fields, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], names=["member"])

    # the sink writes a string's bytes as they are, whether or not they are text
    typed.mapInArrow(run, "member binary").select(F.col("member").cast("string")).write.option("lineSep", "\0").text(path)


# Reading ------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Record:
    offset: int
    end: int
    fields: dict[str, str]
    block: bytes

    def http(self) -> tuple[dict[str, str], bytes]:
        """Fields and payload of the block, if it is an HTTP message."""
        found = self.block.find(b"\r\n\r\n")
        if not self.block.startswith(b"HTTP/") or found < 0:
            return {}, self.block
        return parsed(self.block[:found]), self.block[found + 4 :]


def parsed(lines: bytes) -> dict[str, str]:
    """Fields of a head by lower-case name, without its first line; a line that starts with a space goes on the one before."""
    unfolded = re.sub(rb"\r\n[ \t]+", b" ", lines).split(b"\r\n")[1:]
    pairs = (x.decode("utf-8", "replace").partition(":") for x in unfolded)
    return {name.strip().lower(): value.strip() for name, colon, value in pairs if colon}


def decoded(source: pa.NativeFile, offset: int) -> Record | None:
    """The record whose member starts at ``offset``, or None where no whole one does."""
    source.seek(offset)
    unpacker, text, taken, size, fields, start = zlib.decompressobj(31), bytearray(), 0, None, {}, 0
    while not unpacker.eof:
        data = source.read(CHUNK)
        if not data:
            return None
        taken += len(data)
        try:
            text += unpacker.decompress(data)
        except zlib.error:
            return None
        if size is None:
            if not text.startswith(VERSION[:7][: len(text)]):
                return None
            found = text.find(b"\r\n\r\n")
            if found >= 0:
                fields, start = parsed(bytes(text[:found])), found + 4
                if not fields.get("content-length", "").isdigit():
                    return None
                size = int(fields["content-length"])
            elif len(text) > HEAD_BYTES:
                return None
        if size is not None and len(text) > start + size + 4:
            return None
    if size is None or len(text) != start + size + 4 or not text.endswith(b"\r\n\r\n"):
        return None
    return Record(offset, offset + taken - len(unpacker.unused_data), fields, bytes(text[start : start + size]))


def next_magic(source: pa.NativeFile, start: int, end: int) -> int | None:
    """The first place from ``start`` on and before ``end`` at which the magic stands."""
    source.seek(start)
    data = b""
    while start < end:
        more = source.read(CHUNK)
        data += more
        found = data.find(MAGIC)
        if found >= 0:
            return start + found if start + found < end else None
        if not more:
            return None
        start += max(0, len(data) - len(MAGIC) + 1)
        data = data[-(len(MAGIC) - 1) :]
    return None


def records(source: pa.NativeFile, start: int, end: int) -> Iterator[Record]:
    """Records that start from ``start`` on and before ``end``."""
    place, known = start, False
    while place < end:
        if not known:
            found = next_magic(source, place, end)
            if found is None:
                return
            place = found
        record = decoded(source, place)
        if record is None:
            place, known = (place, False) if known else (place + 1, False)
        else:
            yield record
            place, known = record.end, True


def opened(path: str) -> pa.NativeFile:
    """A file by the path that Spark names it by."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    system, inner = fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))
    return system.open_input_file(inner)


def ranges(spark: SparkSession, path: str, range_bytes: int | None = None) -> DataFrame:
    """(path, start, end) of all files below ``path``, in ranges of ``range_bytes``, by default as Spark cuts files, dealt out to
    tasks of about one range of bytes each."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").where("length > 0")  # their content isn't read
    size = range_bytes or int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))
    total = files.agg(F.sum("length")).first()[0] or 0
    cut_up = files.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))))
    return cut_up.select("path", "start", F.least(F.col("start") + size, "length").alias("end")).repartition(max(1, min(MOST_TASKS, -(-total // size))))


READ = "path string, offset long, record_type string, record_id string, target_uri string, refers_to string, date string, payload_bytes long, payload_digest string, intact boolean"


def read_records(spark: SparkSession, path: str, range_bytes: int | None = None, payloads: bool = True) -> DataFrame:
    """Every record of the archives below ``path``, with its payload if ``payloads``; a revisit has none, and its length and digest are those that
    it states of the full payload. ``intact``: the payload has the digest stated; null where none is stated, or no payload is there."""
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    fields = [pa.field(x.split()[0], kinds[x.split()[1]]) for x in READ.split(", ")]
    schema = pa.schema(fields + [pa.field("payload", pa.binary())] * payloads)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for each in batch.to_pylist():
                with opened(each["path"]) as source:
                    out, held = [], 0
                    for record in records(source, each["start"], each["end"]):
                        out.append(described(record, each["path"], payloads))
                        held += len(record.block) if payloads else 512
                        if held > 64 * CHUNK:
                            yield pa.RecordBatch.from_pylist(out, schema)
                            out, held = [], 0
                    yield pa.RecordBatch.from_pylist(out, schema)

    return ranges(spark, path, range_bytes).mapInArrow(run, READ + ", payload binary" * payloads)


def described(record: Record, path: str, payloads: bool) -> dict:
    fields, (http, payload) = record.fields, record.http()
    revisit = fields.get("warc-type") == "revisit"
    stated = fields.get("warc-payload-digest", "").rpartition(":")[2] or None
    digest = stated if revisit else base32_sha1(payload)
    length = int(http["content-length"]) if revisit and http.get("content-length", "").isdigit() else None if revisit else len(payload)
    return {
        "path": path, "offset": record.offset, "record_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to"),
        "date": fields.get("warc-date"), "payload_bytes": length, "payload_digest": digest, "intact": None if revisit or stated is None else stated.upper() == digest, "payload": None if revisit or not payloads else payload,
    }


def page_of(record_id: str, kind: str = "long"):
    """The id in a record's id, null where it has none of ours."""
    found = F.regexp_extract(F.col(record_id), "^<urn:x-page:(.*)>$", 1)
    return F.when(found != "", found).cast(kind)


def digests(read: DataFrame, pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, payload_bytes, payload_digest, record_type, refers_to) of records read."""
    kind = column_type(pages, key)
    return read.select(page_of("record_id", kind).alias(key), "payload_bytes", "payload_digest", "record_type", page_of("refers_to", kind).alias("refers_to"))
