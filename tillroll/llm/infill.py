"""Fill-in-middle transformation over seekable compressed frames.

A text is stored as independent zstandard frames of ``FRAME`` code points with cumulative unit counts (``ends``), so any place can be
reached by decompressing one frame:

1. ``stored`` cuts texts into frames. That table may be kept; what follows reads nothing else.
2. ``transformed`` draws the form and the two cuts from a hash of seed and id, finds the frames of the cuts by binary search in
   ``ends``, decompresses these alone, and puts the output together: frames that no cut touches move over as they are.
3. ``digests`` streams the frames of an output in order. The exact text is rebuilt from output and form: the marks are searched in the
   stream, then the parts are streamed in their old order. Only a frame at a time is held as text.

Everything is per document, in one scan without a shuffle, whatever the copies or sources look like.

Edge cases: a null or empty text is plain and has no frames; a text that holds a mark of its own is plain; a null id counts as an empty
one in the hash; rows with one id are transformed alike, one by one; an empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.hashing import chunks, texts

FRAME = 4096
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
#: Marks of a form, in the order in which they stand in its output.
ORDER = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
SEED, RATE, SPM_RATE = 1, 90, 20

STORED_DDL = "doc_id long, n long, marked boolean, frames array<binary>, ends array<long>"
STORED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("marked", pa.bool_()), ("frames", pa.list_(pa.binary())),
                    ("ends", pa.list_(pa.int64()))])
OUTPUT_DDL = "doc_id long, n long, form string, prefix_chars long, middle_chars long, frames array<binary>, ends array<long>"
OUTPUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                    ("middle_chars", pa.int64()), ("frames", pa.list_(pa.binary())), ("ends", pa.list_(pa.int64()))])
DIGESTS_DDL = (
    "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string, n_frames long"
)
DIGESTS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                     ("middle_chars", pa.int64()), ("output_sha256", pa.string()), ("restored_sha256", pa.string()),
                     ("n_frames", pa.int64())])
#: Rows of an output batch hold about as many bytes of frames.
BATCH_BYTES = 4 << 20


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def stored(docs: DataFrame, key: str = "doc_id", frame: int = FRAME) -> DataFrame:
    """The texts as frames, with their code points counted up to the end of each frame."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for head, last, data, offsets in chunks(*texts(batch.column("text"))):
                raw = data.tobytes()
                units = np.flatnonzero((data & 0xC0) != 0x80)  # first bytes of the code points
                place = np.searchsorted(units, offsets)
                rows = []
                for i in range(last - head):
                    a, b = int(place[i]), int(place[i + 1])
                    end = int(offsets[i + 1])
                    borders = [*units[a:b:frame].tolist(), end]
                    text = raw[int(offsets[i]) : end]
                    rows.append((ids[head + i], b - a, any(m in text for m in MARKS),
                                 [compress(raw[x:y]) for x, y in zip(borders, borders[1:], strict=False)],
                                 [*range(frame, b - a, frame), b - a] if b > a else []))
                yield batch_of(rows, STORED)

    return docs.select(F.col(key).cast("long").alias("doc_id"), "text").mapInArrow(cut, STORED_DDL)


def place_of(unit: int, text: bytes) -> int:
    """Byte at which a code point of a frame starts."""
    return len(text.decode()[:unit].encode()) if unit else 0


class Cutter:
    """Selects ranges of code points from frames; each frame at a cut is decompressed once."""

    def __init__(self, frames: list[bytes], ends: list[int]):
        self.frames, self.ends = frames, ends
        self.compress = zstandard.ZstdCompressor(level=1).compress
        self.expand = zstandard.ZstdDecompressor().decompress
        self.open: dict[int, bytes] = {}

    def opened(self, k: int) -> bytes:
        if k not in self.open:
            self.open[k] = self.expand(self.frames[k])
        return self.open[k]

    def select(self, a: int, b: int) -> Iterator[tuple[bytes, int]]:
        """Frames and their units that make up the code points from a to b."""
        k = bisect_right(self.ends, a)
        while a < b:
            first, last = self.ends[k - 1] if k else 0, self.ends[k]
            until = min(b, last)
            if a == first and until == last:
                yield self.frames[k], last - first
            else:
                text = self.opened(k)
                part = text[place_of(a - first, text) : len(text) if until == last else place_of(until - first, text)]
                yield self.compress(part), until - a
            a, k = until, k + 1


def draw(seed: int, doc_id: int | None) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def transformed(store: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """Outputs as frames, with the form and the lengths of prefix and middle (null for plain texts)."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=1).compress
        mark_frames = {m: (compress(m), len(m)) for m in MARKS}
        for batch in batches:
            rows, size = [], 0
            for doc_id, n, marked, frames, ends in zip(*(batch.column(c).to_pylist() for c in STORED.names), strict=True):
                h1, h2, h3, h4 = draw(seed, doc_id)
                if not n or marked or h3 % 100 >= rate:
                    rows.append((doc_id, n, "plain", None, None, frames, ends))
                else:
                    form = "spm" if h4 % 100 < spm_rate else "psm"
                    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
                    ranges = {PREFIX: (0, a), MIDDLE: (a, b), SUFFIX: (b, n)}
                    cutter = Cutter(frames, ends)
                    out = [x for m in ORDER[form] for x in (mark_frames[m], *cutter.select(*ranges[m]))]
                    rows.append((doc_id, n, form, a, b - a, [f for f, _ in out], np.cumsum([u for _, u in out]).tolist()))
                size += sum(map(len, rows[-1][5]))
                if size > BATCH_BYTES:
                    yield batch_of(rows, OUTPUT)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows, OUTPUT)

    return store.select(*STORED.names).mapInArrow(fill, OUTPUT_DDL)


def read_back(form: str, frames: list[bytes]) -> tuple[str, str]:
    """Digests of the output and of the text rebuilt from it, streamed frame by frame."""
    expand = zstandard.ZstdDecompressor().decompress
    output = hashlib.sha256()
    need, at, sizes, total, tail = list(ORDER.get(form, ())), [], [], 0, b""
    for frame in frames:
        text = expand(frame)
        output.update(text)
        seen, base, since = tail + text, total - len(tail), 0
        while need and (i := seen.find(need[0], since)) >= 0:
            at.append(base + i)
            since = i + len(need.pop(0))
        # a mark may begin in the last two bytes
        tail = seen[max(since, len(seen) - 2) :]
        sizes.append(len(text))
        total += len(text)
    if form == "plain":
        return output.hexdigest(), output.hexdigest()
    starts = np.cumsum([0, *sizes]).tolist()
    ends = [*at[1:], total]
    parts = {m: (a + len(m), b) for m, a, b in zip(ORDER[form], at, ends, strict=True)}
    restored = hashlib.sha256()
    for m in (PREFIX, MIDDLE, SUFFIX):
        a, b = parts[m]
        k = bisect_right(starts, a) - 1
        while a < b:
            if sizes[k]:
                restored.update(expand(frames[k])[a - starts[k] : b - starts[k]])
            a, k = starts[k + 1], k + 1
    return output.hexdigest(), restored.hexdigest()


def digests(outputs: DataFrame) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for *kept, frames, _ in zip(*(batch.column(c).to_pylist() for c in OUTPUT.names), strict=True):
                rows.append((*kept, *read_back(kept[2], frames), len(frames)))
            yield batch_of(rows, DIGESTS)

    return outputs.mapInArrow(read, DIGESTS_DDL)


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """Form, cuts and digests of every document, read back from the compressed outputs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(transformed(stored(docs))).drop("n_frames")


ORACLE_SQL = """
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n,
    sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents
),
drawn AS (
  SELECT doc_id, text, n,
    least(CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1), CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1)) AS a,
    greatest(CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1), CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
        OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
      WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM hashed
),
parts AS (
  SELECT *, substring(text, 1, a) AS prefix, substring(text, a + 1, b - a) AS middle, substring(text, b + 1) AS suffix FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
