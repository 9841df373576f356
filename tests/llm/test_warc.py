from __future__ import annotations

import base64
import hashlib
import io
import struct

import pytest
import zstandard
from compare import compare, connect

from codeloom.llm import warc
from codeloom.llm.queries import ORACLES, QUERIES

SCHEMA = "page_id long, url string, html string, sha string, refers_to long, p int"


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(rows):
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    out = []
    for i, _, html in rows:
        f = first.get(html or "")
        again = f is not None and (i is None or i > f)
        out.append((i, len((html or "").encode()), sha(html), "revisit" if again else "response", f if again else None))
    return sorted(out, key=str)


def read(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_query_matches_brute_force(spark, sf):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert read(QUERIES["op3_warc"](spark, sf)) == expected(pages)


def test_query_matches_sql(spark, sf):
    same, note = compare(spark, connect(sf), QUERIES["op3_warc"], ORACLES["op3_warc"], sf)
    assert same, note


ROWS = [
    (5, "http://a/é b\r\n", "same é"),
    (3, "http://b", "same é"),
    (9, None, "same é"),
    (9, None, "same é"),
    (3, "http://b", "same é"),
    (7, "http://c", None),
    (8, "http://d", ""),
    (None, "http://e", "same é"),
    (None, "http://f", "alone"),
    (1, "http://g", "x" * 3_000_000),
    (2, "http://h", "WARC/1.1\r\n\r\n\r\n\r\nbody\r\n\r\n"),
]


def test_odd_rows_round_trip(spark):
    pages = spark.createDataFrame([(*r, "x", 1, 2) for r in ROWS], SCHEMA)
    files = warc.write_archives(pages, archive_bytes=1000)
    assert files.count() > 1
    got = warc.read_archives(files, with_payload=True)
    assert read(got) == expected(ROWS)
    by_id = {r.page_id: r.payload for r in got.collect() if r.record_type == "response" and r.page_id is not None}
    assert by_id[1] == b"x" * 3_000_000 and by_id[2] == ROWS[-1][2].encode()


def test_smaller_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(*r, "x", 1, 2) for r in ROWS], SCHEMA)
    got = {(r.page_id, r.record_type) for r in warc.read_archives(warc.write_archives(pages, min_bytes=100)).collect()}
    assert {kind for _, kind in got} == {"response"}


def test_empty_table(spark):
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], SCHEMA))).count() == 0


def archive(parts, words=b""):
    comp = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(words), write_content_size=True, write_checksum=True)
    return struct.pack("<II", warc.DICT_MAGIC, len(words)) + words + b"".join(comp.compress(p) for p in parts)


def test_raw_dictionary_and_one_frame_per_record():
    words = b"some shared words " * 20
    parts = [warc.record(k, "u", b"some shared words " * k, None) for k in range(40)]
    assert list(warc.records(io.BytesIO(archive(parts, words)))) == parts


def test_damaged_archives_are_refused():
    good = warc.record(1, "u", b"payload", None)
    for bad in (good.replace(b"WARC/1.1", b"WARC/0.9"), good.replace(b"payload", b"payl0ad"), good[:-1], good + b"x", good.replace(b"response", b"resource", 1), good.replace(b"Content-Length: 7", b"Content-Length: 6")):
        with pytest.raises((ValueError, KeyError)):
            warc.parse(bad)
    data = archive([good, good])
    for cut in (data[:-5], data[3:], b"\x00" * 8 + data):
        with pytest.raises((ValueError, zstandard.ZstdError, struct.error)):
            list(warc.records(io.BytesIO(cut)))
