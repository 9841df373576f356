"""Zstandard WARC archives: a dictionary in the leading skippable frame, then one frame per record.

Equal payloads are kept once: of records with the same payload of at least ``min_bytes`` bytes the one with the smallest
page_id is a ``response``, the others are ``revisit`` records that refer to it and hold no payload. The dictionary is
trained on the ``samples`` pages with the smallest hash of their id (at most ``SAMPLE_CHARS`` characters of each).
Reading checks the frame's declared size, version, headers, both lengths, the record's end and the payload digest.

Null html: empty payload. Null url: empty. Null page_id: after all others; equal payloads without any id are responses.
Repeated rows with the smallest page_id are all responses. Empty table: no archive. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.storage import folder, kept, opened, publish

DICT_MAGIC = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
SAMPLE_CHARS = 16384
READ = 1 << 14
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """A WARC/1.1 record of a page."""
    urn = lambda x: f"<urn:x-page:{'' if x is None else x}>"
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {urn(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields of a record; raises where it breaks its own headers."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or lines[0] != "WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    kind, n = fields["WARC-Type"], int(fields["Content-Length"])
    if kind not in ("response", "revisit") or not {"WARC-Record-ID", "WARC-Date", "WARC-Target-URI"} <= fields.keys():
        raise ValueError("a record lacks a header")
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, sep, payload = rest[:n].partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    if not sep or len(payload) != (size if kind == "response" else 0):
        raise ValueError("a payload's length is wrong")
    sha1 = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and digest(payload) != sha1:
        raise ValueError("a payload's digest is wrong")
    number = lambda urn: int(x) if (x := re.fullmatch(r"<urn:x-page:(-?\d*)>", urn)[1]) else None
    refers = number(fields["WARC-Refers-To"]) if kind == "revisit" else None
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload_bytes": size, "payload_digest": sha1, "record_type": kind, "refers_to": refers, "payload": payload if kind == "response" else None}


def train(samples: list[bytes], size: int = 1 << 16) -> bytes:
    """A dictionary; the header's text alone where there is too little to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return record(0, "", b"", 0)


def records(f) -> Iterator[bytes]:
    """The decoded frames of an archive."""
    magic, n = struct.unpack("<II", f.read(8))
    if magic != DICT_MAGIC:
        raise ValueError("the archive does not start with a dictionary")
    words = f.read(n)
    if words[:4] == FRAME:
        words = zstandard.ZstdDecompressor().decompress(words)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words))
    held = b""
    while held := held or f.read(READ):
        while len(held) < 18 and (more := f.read(READ)):
            held += more
        if held[:4] != FRAME:
            raise ValueError("a frame does not start where it should")
        declared = zstandard.get_frame_parameters(held).content_size
        frame = reader.decompressobj()
        parts = [frame.decompress(held)]
        while not frame.eof:
            more = f.read(READ)
            if not more:
                raise ValueError("the archive ends within a frame")
            parts.append(frame.decompress(more))
        held = frame.unused_data
        data = b"".join(parts)
        if len(data) != declared:
            raise ValueError("a frame's size is wrong")
        yield data


def write_archives(pages: DataFrame, min_bytes: int = 0, samples: int = 512, archive_bytes: int = 1 << 24, level: int = 3) -> DataFrame:
    """Archives of ``page_id, url, html``; returns their list: path, n_records, n_bytes."""
    spark = pages.sparkSession
    html = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"))
    # first the hashes, then the texts: tasks send hashes, and only the texts that are picked
    hashed = pages.select(F.xxhash64("page_id").alias("h"), "page_id", F.substring("html", 1, SAMPLE_CHARS).alias("html"))
    last = hashed.select("h").orderBy("h").limit(samples).agg(F.max("h")).first()[0]
    picked = hashed.filter(F.col("h") <= F.lit(last)).orderBy("h", "page_id").limit(samples) if last is not None else hashed.limit(0)
    words = train([r.html.encode() for r in picked.collect()])
    base = folder(spark, "warc")

    keyed = pages.withColumn("sha", F.sha1("html"))
    ids = keyed.filter(F.octet_length("html") >= min_bytes).select("page_id", "sha")
    firsts = ids.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1 and refers_to is not null").drop("n")
    again = ids.join(firsts, "sha").filter("page_id is null or page_id > refers_to").distinct()
    again = again.withColumnsRenamed({"page_id": "p", "sha": "s"})
    rows = keyed.join(again, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("sha") == F.col("s")), "left").select("page_id", "url", "html", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = zstandard.ZstdCompressor(level=19).compress(words)
        head = struct.pack("<II", DICT_MAGIC, len(packed)) + packed
        comp = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(words), write_content_size=True, write_checksum=True)
        parts, held, n = [head], len(head), 0

        def flush() -> pa.RecordBatch:
            nonlocal parts, held, n
            row = publish(base, ".warc.zst", parts), n, held
            parts, held, n = [head], len(head), 0
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["path", "n_records", "n_bytes"])

        for batch in batches:
            for page_id, url, text, first in zip(*(c.to_pylist() for c in (batch.column(0), batch.column(1), pc.cast(batch.column(2), pa.binary()), batch.column(3)))):
                parts.append(comp.compress(record(page_id, url, text, first)))
                held, n = held + len(parts[-1]), n + 1
                if held >= archive_bytes:
                    yield flush()
        if n:
            yield flush()

    return kept(rows.mapInArrow(write, "path string, n_records long, n_bytes long"), "warc-files")


def read_archives(files: DataFrame, with_payload: bool = False) -> DataFrame:
    """Records of listed archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to and, if asked
    for, payload."""
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    schema = pa.schema(fields + [("payload", pa.binary())] * with_payload)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                out: list[dict] = []
                with opened(path) as f:
                    for data in records(f):
                        out.append(parse(data))
                        if not with_payload:
                            del out[-1]["payload"]
                        if len(out) == 1000:
                            yield pa.RecordBatch.from_pylist(out, schema)
                            out = []
                yield pa.RecordBatch.from_pylist(out, schema)

    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ddl = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return files.select("path").repartition(n, "path").mapInArrow(read, ddl + ", payload binary" * with_payload)
