"""WARC archives of pages: range-sorted, rolled by compressed size, committed through temporary names and a manifest.

1. Pages with equal payloads of ``REVISIT_BYTES`` or more: the smallest page_id is written in full (response), the others point to it
   (revisit). The smallest is found by an aggregation that combines on the map side; the join back can be split where a payload is hot.
2. The records are range-sorted by (page_id, digest, url), so no key has to fit into a task. A task writes its records, gzip member by
   member, to files under temporary names and starts a new file once one has ``FILE_BYTES``. It keeps one record in memory.
3. What a task returns about its files (names, records, bytes, digest) becomes the manifest, a table. Only files of
   attempts that Spark accepted are in it. A second job gives them their final names; doing that twice changes nothing, so a lost
   executor costs a rerun. Readers go by the manifest alone.

Headers are made anew from the page: record ids are name-based, the date is a parameter, so equal input gives equal bytes.
Archives go to a folder that all executors reach, by a URI that ``pyarrow.fs`` can open.

Edge cases: a null html is an empty payload; a null url is named after the page; line breaks in urls are percent-encoded; a page
without page_id can't be pointed to; repeated rows are repeated records of the same type; an empty table gives an empty manifest;
other columns are left out.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.ngram_join import groups_for
from tillroll.operators.lineage import ensure_checkpoint_dir

REVISIT_BYTES = 100
FILE_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def record_id(kind: str, page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{kind}|{page_id}|{digest}')}>"


def record(kind: str, headers: list[tuple[str, str]], block: bytes, date: str) -> bytes:
    """One gzip member, the same for the same record."""
    lines = [("WARC-Type", kind), ("WARC-Date", date), *headers,
             ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    uri = quote(url, safe=":/?#[]@!$&'()*+,;=%~-._") if url else f"urn:page:{page_id}"
    kind = "response" if refers_to is None else "revisit"
    headers = [("WARC-Record-ID", record_id(kind, page_id, digest)), ("WARC-Target-URI", uri),
               ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}"),
               ("X-Payload-Length", str(len(payload)))]
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        return record(kind, headers, http + payload, date)
    headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id("response", refers_to, digest)), ("X-Refers-To-Page-ID", str(refers_to))]
    return record(kind, headers, http, date)


def planned(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): each page with its payload and, where it is a revisit, one row more for its
    (page_id, digest, url) that has no payload and says what to refer to. So payloads take part in no join."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    large = rows.filter(F.octet_length("payload") >= REVISIT_BYTES)
    first = large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1 and refers_to is not null")
    revisits = large.select("page_id", "url", "digest").distinct().join(first.drop("n"), "digest").filter(
        ~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return rows.withColumn("refers_to", F.lit(None).cast("long")).unionByName(
        revisits.select("page_id", "url", F.lit(None).cast("binary").alias("payload"), "digest", "refers_to"))


MANIFEST = "shard int, file int, temporary string, name string, records long, bytes long, sha256 string"


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES, date: str = DATE) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) under ``folder`` and returns the committed manifest."""
    spark = pages.sparkSession
    n = groups_for(pages)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        system, path = opened(folder)
        out, digest, rows, current = None, None, [], []
        named, target = None, None

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                rows.append((*current[:4], current[4], current[5], digest.hexdigest()))
                out = None

        def put(data: bytes, counts: int) -> None:
            out.write(data)
            digest.update(data)
            current[4] += counts
            current[5] += len(data)

        for batch in batches:
            for page_id, url, payload, sha, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if payload is None:
                    named, target = (page_id, sha, url), refers_to
                    continue
                if out is None:
                    number = len(rows)
                    name = f"pages-{shard:05d}-{number:05d}.warc.gz"
                    current = [shard, number, f"_temporary/{attempt}-{name}", f"archives/{name}", 0, 0]
                    system.create_dir(f"{path}/_temporary")
                    out, digest = system.open_output_stream(f"{path}/{current[2]}", compression=None), hashlib.sha256()
                    put(record("warcinfo", [("WARC-Record-ID", record_id("warcinfo", number, name)), ("WARC-Filename", name),
                                            ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", date), 0)
                put(page_record(page_id, url, payload, sha, target if named == (page_id, sha, url) else None, date), 1)
                if current[5] >= file_bytes:
                    close()
        close()
        if rows:
            yield pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], ["shard", "file", "temporary", "name", "records", "bytes", "sha256"])

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(folder)
        for batch in batches:
            system.create_dir(f"{path}/archives")
            for temporary, name, size in zip(*(batch.column(c).to_pylist() for c in ("temporary", "name", "bytes")), strict=True):
                if system.get_file_info(f"{path}/{temporary}").type == fs.FileType.File:
                    system.move(f"{path}/{temporary}", f"{path}/{name}")
                elif system.get_file_info(f"{path}/{name}").size != size:
                    raise FileNotFoundError(f"{path}/{name}")
            yield batch

    # equal keys stay together and nulls come first, so a page follows the row that says what it refers to
    spread = planned(pages).repartitionByRange(n, "page_id", "digest", "url").sortWithinPartitions(
        "page_id", "digest", "url", F.col("payload").isNotNull())
    long = "shard long, file long, temporary string, name string, records long, bytes long, sha256 string"
    spread.mapInArrow(write, long).write.parquet(f"{folder}/written")
    spark.read.parquet(f"{folder}/written").mapInArrow(commit, long).write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def records_of(stream: io.RawIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a compressed archive."""
    with gzip.GzipFile(fileobj=stream) as file:
        while line := file.readline():
            if line != b"WARC/1.1\r\n":
                raise ValueError("not at the start of a record")
            headers = {}
            while (line := file.readline()) != b"\r\n":
                k, _, v = line.decode().rstrip("\r\n").partition(": ")
                headers[k] = v
            block = file.read(int(headers["Content-Length"]))
            if file.read(4) != b"\r\n\r\n":
                raise ValueError("a record is cut")
            yield headers, block


PAGES = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_archives(manifest: DataFrame, folder: str, keep_payload: bool = True) -> DataFrame:
    """The records of the committed files; digests are made from what is read and held against the headers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(folder)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows, size = [], 0
                with system.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for headers, block in records_of(stream):
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        if headers["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
                            raise ValueError(f"{name}: a block doesn't fit its digest")
                        payload, digest = block.partition(b"\r\n\r\n")[2], headers["WARC-Payload-Digest"].removeprefix("sha256:")
                        length = int(headers["X-Payload-Length"])
                        if headers["WARC-Type"] == "response":
                            length = len(payload)
                            if hashlib.sha256(payload).hexdigest() != digest:
                                raise ValueError(f"{name}: a payload doesn't fit its digest")
                        page, to = headers.get("X-Page-ID"), headers.get("X-Refers-To-Page-ID")
                        rows.append((page and int(page), headers["WARC-Target-URI"], length, digest, headers["WARC-Type"], to and int(to),
                                     payload if keep_payload else None))
                        size += len(payload)
                        if len(rows) >= 1000 or size > 8 << 20:
                            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, size = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return manifest.select("name").repartition(groups_for(manifest)).mapInArrow(read, PAGES)


def op6_warc(spark, sf_dir: str) -> DataFrame:
    """Every page as it is read back from the archives."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4()}"
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(manifest, folder, keep_payload=False).drop("payload", "url")
