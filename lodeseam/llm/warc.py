"""Web archives of Zstandard-compressed WARC records: written by tasks, read back frame by frame.

An archive starts with a skippable frame that holds its dictionary, trained on the archive's own first pages; every
record is a Zstandard frame of its own that names its content size. A record has a WARC/1.1 header, a block of
Content-Length bytes and two line ends; the reader checks all of these, the block's length, a response's payload against
its digest, and that nothing is left over. Of pages with equal payloads of ``LEAST_BYTES`` bytes or more the largest
page_id is a response and the others are revisit records that name it; smaller payloads are always responses.

Archives lie in a new folder of the shared checkpoint folder. A task names its archives by itself and lists them in its
result; the list is written once, so that what a lost or repeated attempt left behind is never read.

Nulls: a null html is an empty payload; a null page_id is written and read as such, refers to a largest id like any
other, and is never referred to; a null url is left out. Rows that repeat a page_id with one payload are all responses if
that id is the largest. Empty input gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseam.llm.common import pieces, scratch, settle

LEAST_BYTES = 1000
#: Bytes of payload after which a task begins another archive.
ARCHIVE_BYTES = 64 << 20
DICTIONARY_BYTES = 32 << 10
DICTIONARY_PAGES = 200
# Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
ZSTD_MAGIC = 0xFD2FB528
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"


def open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, which need not be local, and its path there."""
    if "://" not in folder:
        folder = re.sub(r"^file:/*", "/", folder)
        if folder.startswith("/"):
            return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder)


def clean(value: object) -> str:
    """A header's value has no line ends."""
    return re.sub(r"[\r\n]+", " ", str(value))


def urn(page_id: int | None) -> str:
    return "<urn:uuid:%s>" % (uuid.uuid4() if page_id is None else uuid.uuid5(uuid.NAMESPACE_OID, str(page_id)))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record. ``digest`` is the payload's SHA-1 in hexadecimal; a revisit keeps the answer's head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", urn(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        lines.append(("WARC-Target-URI", clean(url)))
    lines.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()))
    if page_id is not None:
        lines.append(("Page-Number", page_id))
    if revisit:
        lines += [("WARC-Profile", PROFILE), ("WARC-Refers-To", urn(refers_to)), ("Refers-To-Page-Number", refers_to)]
    lines += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record's bytes; ValueError if they don't hold together."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not gap or first != VERSION:
        raise ValueError(f"no {VERSION.decode()} record")
    headers: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.decode().partition(":")
        if not colon or not name.strip():
            raise ValueError(f"a header line without a name: {line[:80]!r}")
        headers[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"no {name}")
    if not headers["content-length"].isdigit():
        raise ValueError(f"Content-Length is {headers['content-length']!r}")
    length = int(headers["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length is {length}, the block has {len(rest) - 4} bytes")
    return headers, rest[:length]


def payload_of(headers: dict[str, str], block: bytes) -> tuple[int, str, bytes]:
    """Length, SHA-1 and bytes of a record's payload; a revisit has no bytes."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    stated = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", head)
    digest = re.fullmatch(r"sha1:([A-Z2-7]{32})", headers.get("warc-payload-digest", ""))
    if not gap or not stated or not digest:
        raise ValueError("no length or digest of the payload")
    length, digest_hex = int(stated[1]), base64.b32decode(digest[1]).hex()
    if headers["warc-type"] == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest_hex):
        raise ValueError("the payload doesn't have its length or digest")
    if headers["warc-type"] == "revisit" and payload:
        raise ValueError("a revisit with a payload")
    return length, digest_hex, payload


def train(samples: list[bytes]) -> bytes:
    """A dictionary, or none where the samples are too few or too small."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=3).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def write_archive(sink, records: Iterator[bytes]) -> int:
    """Write records to an open file, dictionary first; their number."""
    ahead, held = [], 0
    for data in records:
        ahead.append(data)
        held += len(data)
        if len(ahead) >= DICTIONARY_PAGES or held >= 4 << 20:
            break
    words = train(ahead)
    options = {"dict_data": zstandard.ZstdCompressionDict(words)} if words else {}
    if words:
        sink.write(struct.pack("<II", SKIPPABLE, len(words)) + words)
    press = zstandard.ZstdCompressor(level=3, write_content_size=True, write_checksum=True, **options)
    n = 0
    for part in (ahead, records):
        for data in part:
            sink.write(press.compress(data))
            n += 1
    return n


def read_frames(source, chunk: int = 1 << 20) -> Iterator[bytes]:
    """Decoded frames of an open archive, one at a time."""
    data = source.read(8)
    options = {}
    if len(data) == 8 and struct.unpack("<II", data)[0] == SKIPPABLE:
        size = struct.unpack("<II", data)[1]
        words = source.read(size)
        if len(words) != size:
            raise ValueError("the dictionary is cut off")
        if struct.unpack("<I", words[:4])[0] == ZSTD_MAGIC:  # it may be compressed itself
            words = zstandard.ZstdDecompressor().decompress(words)
        options["dict_data"] = zstandard.ZstdCompressionDict(words)
        data = b""
    unpress = zstandard.ZstdDecompressor(**options)
    while True:
        data = data or source.read(chunk)
        if not data:
            return
        frame, parts = unpress.decompressobj(), []
        while not frame.eof:
            if not data:
                data = source.read(chunk)
                if not data:
                    raise ValueError("the last frame is cut off")
            parts.append(frame.decompress(data))
            data = frame.unused_data if frame.eof else b""
        yield b"".join(parts)


def decide(pages: DataFrame) -> DataFrame:
    """``(page_id, url, payload, digest, refers_to, revisit)``."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= LEAST_BYTES
    chosen = rows.where(large).groupBy("digest").agg(F.max("page_id").alias("first")).where("first is not null")
    joined = rows.join(chosen, "digest", "left").withColumn("revisit", large & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
    return joined.select("page_id", "url", "payload", "digest", F.when(F.col("revisit"), F.col("first")).alias("refers_to"), "revisit")


def write(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages(page_id, url, html)`` to archives in ``folder``; ``(path, records)`` of those that count."""
    rows = decide(pages)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_folder(folder)
        store.create_dir(path, recursive=True)
        queue = ((r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"], r["revisit"]) for b in pieces(batches, "payload", 4 << 20) for r in b.to_pylist())
        ahead = next(queue, None)
        while ahead is not None:
            name = f"{path}/{uuid.uuid4().hex}.warc.zst"

            def records() -> Iterator[bytes]:
                nonlocal ahead
                held = 0
                while ahead is not None and held < archive_bytes:
                    held += len(ahead[2]) + 512
                    data = record(*ahead)
                    ahead = next(queue, None)
                    yield data

            with store.open_output_stream(name) as sink:
                n = write_archive(sink, records())
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["path", "records"])

    return settle(rows.mapInArrow(work, "path string, records long"))


def read(manifest: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """``(page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload])`` of the archives that
    ``manifest(path, records)`` lists."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_folder(folder)
        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, n, held = [], 0, 0
                with store.open_input_stream(path) as source:
                    for data in read_frames(source):
                        headers, block = parse(data)
                        length, digest, payload = payload_of(headers, block)
                        number = lambda name: int(headers[name]) if name in headers else None
                        rows.append((number("page-number"), headers.get("warc-target-uri"), length, digest, headers["warc-type"], number("refers-to-page-number"), payload if payloads else None))
                        n, held = n + 1, held + (len(payload) if payloads else 0)
                        if len(rows) >= 5000 or held >= 8 << 20:
                            yield pack(rows)
                            rows, held = [], 0
                if n != expected:
                    raise ValueError(f"{path} has {n} records, not {expected}")
                if rows:
                    yield pack(rows)

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
    parts = max(1, min(manifest.count(), int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    found = manifest.repartition(parts, "path").mapInArrow(work, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
    return found if payloads else found.drop("payload")


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages and read them back."""
    folder = folder or scratch(pages.sparkSession, "warc")
    return read(write(pages, folder), folder)


SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
g as (select html, max(page_id) as first from p where octet_length(encode(html)) >= 1000 group by html)
select page_id, octet_length(encode(p.html)) as payload_bytes, sha1(p.html) as payload_digest,
  case when first is not null and page_id is distinct from first then 'revisit' else 'response' end as record_type,
  case when page_id is distinct from first then first end as refers_to
from p left join g using (html)
"""
