from __future__ import annotations

import hashlib

from helpers import SMALL
from tillroll.llm import warc

PAGES = "page_id long, url string, html string, digest string, refers_to long"


def expected(rows: list) -> list[tuple]:
    payloads = [(r.page_id, (r.html or "").encode()) for r in rows]
    first = {}
    for page, data in payloads:
        if len(data) >= 100 and page is not None:
            first[data] = min(page, first.get(data, page))
    found = []
    for page, data in payloads:
        to = first.get(data) if len(data) >= 100 else None
        to = None if to == page else to
        found.append((page, len(data), hashlib.sha256(data).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(found, key=str)


def read(df) -> list[tuple]:
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_all_pages_come_back(spark):
    assert read(warc.op6_warc(spark, SMALL)) == expected(spark.read.parquet(f"{SMALL}/pages.parquet").collect())


def test_odd_pages_in_small_files(spark, tmp_path):
    same, other = "<p>" + "x" * 120, "<p>é\r\n\r\n" + "y" * 300
    rows = [(4, "http://a/1", same), (2, None, same), (2, None, same), (9, "http://a/\r\nX: 1", same), (None, None, same), (1, "", None),
            (3, "http://b", ""), (5, "http://c", "short"), (6, "http://c", "short"), (7, "http://d", other), (8, "http://e", other)]
    pages = spark.createDataFrame([(*r, "of the input", 77) for r in rows], PAGES)
    folder = f"{tmp_path}/archive"
    manifest = warc.write_archives(pages, folder, file_bytes=500)
    got = warc.read_archives(manifest, folder)
    assert read(got) == expected(pages.collect())
    payloads = {(r.page_id, bytes(r.payload)) for r in got.collect() if r.record_type == "response"}
    assert {(2, same.encode()), (7, other.encode()), (1, b"")} <= payloads
    files = manifest.collect()
    assert len(files) > 1 and sum(f.records for f in files) == len(rows)
    for f in files:
        with open(f"{folder}/{f.name}", "rb") as stream:
            data = stream.read()
        assert (len(data), hashlib.sha256(data).hexdigest()) == (f.bytes, f.sha256)


def test_no_pages(spark, tmp_path):
    folder = f"{tmp_path}/archive"
    manifest = warc.write_archives(spark.createDataFrame([], PAGES), folder)
    assert warc.read_archives(manifest, folder).count() == 0
