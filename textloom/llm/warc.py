"""WARC archives compressed record by record with a dictionary of their own.

Each archive is one ``.warc.zst`` file: a leading skippable frame holds a Zstandard
dictionary built from the archive's records, then every record is a frame of its own that
needs that dictionary. A page whose payload equals that of another page is written as a
revisit that refers to it.

Tasks write the files themselves, through the file system of the folder's URI (``pyarrow.fs``:
local, hdfs, s3, gs, abfs), under a name that no other attempt has, and move each to its final name when it is whole. What
makes an archive part of the result is its row in the list of archives, which Spark's commit
protocol writes: a lost executor's archives are written again, and files that no row names, left by
attempts that failed, are never read.

The dictionary is trained on records spread evenly over the archive, ``sample_bytes`` of them in all, each up to an eighth of that;
an archive of fewer than 16 records, on which training fails, takes the beginnings of its records as raw content. Records
are compressed whole whatever the dictionary.

Defined cases: null html is the empty payload; null urls have no target header; white space
and control characters in urls are percent-encoded; payloads under ``least_bytes`` are
never revisits; a null page_id is written as ``null`` and never is the page that others
refer to; rows of one page_id and payload are of the same type; a record over
``archive_bytes`` makes an archive of its own; an empty table makes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import new_path, table

#: Of a skippable frame with a dictionary, in the .warc.zst format.
DICTIONARY_MAGIC = 0x184D2A5D
#: Uncompressed bytes of records in an archive, of the dictionary, and of the records that it is built from.
ARCHIVE_BYTES, DICTIONARY_BYTES, SAMPLE_BYTES = 8 << 20, 32 << 10, 1 << 20
LEAST_BYTES = 1000
ARCHIVE_SCHEMA = "archive string, records int, bytes long"
LEVEL = 6


def record(kind: str, record_id: str, block: bytes, url: str | None = None, digest_hex: str | None = None, refers_to: str | None = None, date: str = "1970-01-01T00:00:00Z", content_type: str = "application/http; msgtype=response") -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if digest_hex is not None:
        head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest_hex)).decode())
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"Content-Type: {content_type}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block; raises ValueError where the record isn't whole."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("a WARC record of the wrong length")
    return headers, rest[:n]


def build_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES, sample_bytes: int = SAMPLE_BYTES) -> bytes:
    """A trained dictionary, or raw content where the records are too few to train on."""
    step = max(1, sum(map(len, records)) // sample_bytes)
    sample = [r[: sample_bytes // 8] for r in records[::step]]
    if len(sample) >= 16:
        try:
            return zstandard.train_dictionary(size, sample, k=256, d=8).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(sample)[:size] or b"WARC/1.1\r\n"


def _dictionary(content: bytes) -> zstandard.ZstdCompressionDict:
    trained = content[:4] == struct.pack("<I", 0xEC30A437)
    return zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)


def pack_archive(records: list[bytes], level: int = LEVEL) -> bytes:
    content = build_dictionary(records)
    tool = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(content), write_checksum=True)
    parts = [struct.pack("<II", DICTIONARY_MAGIC, len(content)), content]
    parts += [tool.compress(r) for r in records]
    return b"".join(parts)


def unpack_archive(content: bytes) -> Iterator[bytes]:
    """The records of an archive; raises ValueError where the file is damaged."""
    magic, size = struct.unpack_from("<II", content)
    if magic != DICTIONARY_MAGIC or len(content) < 8 + size:
        raise ValueError("no leading dictionary frame")
    tool = zstandard.ZstdDecompressor(dict_data=_dictionary(content[8 : 8 + size]))
    at, view = 8 + size, memoryview(content)
    while at < len(content):
        frame, parts = tool.decompressobj(), []
        while not frame.eof:
            chunk = view[at : at + 16384]
            if not len(chunk):
                raise ValueError("an archive that ends within a record")
            parts.append(frame.decompress(chunk))
            at += len(chunk)
        at -= len(frame.unused_data)
        yield b"".join(parts)


def with_revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload, sha1 and refers_to (null for a response).

    Payloads are equal by their SHA-256 and length. Groups are made from digests alone, combined before
    the shuffle; only pages of groups of two or more meet their group again, in a join that Spark can split.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    full = pages.select("page_id", "url", payload.alias("payload")).withColumns({"n_bytes": F.octet_length("payload"), "sha1": F.sha1("payload"), "sha256": F.sha2("payload", 256)})
    groups = (
        full.where(F.col("n_bytes") >= least_bytes).groupBy("sha256", "n_bytes").agg(F.max("page_id").alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1").select("sha256", "n_bytes", "__first")
    )
    joined = full.join(groups, ["sha256", "n_bytes"], "left")
    refers = F.when(F.col("__first").isNotNull() & ~F.col("__first").eqNullSafe(F.col("page_id")), F.col("__first"))
    return joined.select("page_id", "url", "payload", "sha1", refers.alias("refers_to"))


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, and the folder's path there."""
    found, path = fs.FileSystem.from_uri(uri if ":" in uri else f"file://{os.path.abspath(uri)}")
    return found, path.rstrip("/")


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, date: str = "1970-01-01T00:00:00Z", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write the archives of pages (page_id, url, html) into a folder; their list (archive, records, bytes), stored beside them in ``archives``."""

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        target, where = file_system(folder)
        target.create_dir(where, recursive=True)
        held: list[bytes] = []
        size = 0

        def flush():
            nonlocal made, size
            name = f"part-{part:06d}-{made:05d}-{uuid.uuid4().hex}.warc.zst"
            info = record("warcinfo", f"urn:archive:{name}", b"software: textloom\r\nformat: WARC File Format 1.1\r\n", date=date, content_type="application/warc-fields")
            content = pack_archive([info, *held])
            with target.open_output_stream(f"{where}/.{name}", compression=None) as out:
                out.write(content)
            target.move(f"{where}/.{name}", f"{where}/{name}")
            row = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held) + 1], pa.int32()), pa.array([len(content)], pa.int64())], ["archive", "records", "bytes"])
            made, size = made + 1, 0
            held.clear()
            return row

        for b in batches:
            for page, url, payload, sha1, refers in zip(*(b.column(c) for c in ("page_id", "url", "payload", "sha1", "refers_to")), strict=True):
                body, page, refers = payload.as_py(), page.as_py(), refers.as_py()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                block = head if refers is not None else head + body
                r = record(
                    "response" if refers is None else "revisit", f"urn:page:{'null' if page is None else page}", block,
                    url.as_py(), sha1.as_py(), None if refers is None else f"urn:page:{refers}", date,
                )
                if held and size + len(r) > archive_bytes:
                    yield flush()
                held.append(r)
                size += len(r)
        if held:
            yield flush()

    written = with_revisits(pages, least_bytes).mapInArrow(run, ARCHIVE_SCHEMA)
    written.write.parquet(f"{folder.rstrip('/')}/archives")
    return pages.sparkSession.read.schema(written.schema).parquet(f"{folder.rstrip('/')}/archives")


def read_archives(archives: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """A row for each page record of the listed archives of a folder: page_id, url, payload_bytes, payload_digest, record_type, refers_to and, of responses, the payload."""

    def number(urn: str | None) -> int | None:
        text = None if urn is None else urn.strip("<>").removeprefix("urn:page:")
        return None if text in (None, "null") else int(text)

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: 6 + with_payload]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 6 + with_payload]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches):
        source, where = file_system(folder)
        for b in batches:
            for name in b.column("archive").to_pylist():
                with source.open_input_file(f"{where}/{name}") as file:
                    content = file.read()
                rows, size = [], 0
                for raw in unpack_archive(content):
                    head, block = parse_record(raw)
                    if head["warc-type"] == "warcinfo":
                        continue
                    http, _, body = block.partition(b"\r\n\r\n")
                    stated = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                    length = int(http.rsplit(b"Content-Length: ", 1)[1])
                    if head["warc-type"] == "response" and (hashlib.sha1(body).hexdigest() != stated or len(body) != length):
                        raise ValueError(f"damaged payload in {head['warc-record-id']}")
                    row = (number(head["warc-record-id"]), head.get("warc-target-uri"), length, stated, head["warc-type"], number(head.get("warc-refers-to")), body if head["warc-type"] == "response" else None)
                    rows.append(row[: 6 + with_payload])
                    size += len(body) * with_payload
                    if len(rows) >= 4096 or size > 8 << 20:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    return archives.select("archive").mapInArrow(run, schema)


def op9_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    archives = write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return read_archives(archives, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT *, strlen(html) AS n, max(page_id) OVER (PARTITION BY html) AS first_id FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> first_id THEN first_id END AS refers_to
FROM g
"""
