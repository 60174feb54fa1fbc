"""Best-two-fit packing of tokenized documents into sequences of a fixed number of tokens.

1. Each task tokenizes its documents, cuts the ones that are too long, and numbers its pieces within each length.
2. Lengths are whole numbers up to the capacity, so the counts per length (at most 1024 numbers, whatever the data) are all that
   packing needs to know. The driver packs *patterns* (lists of lengths) with the number of bins that get each: a bin is
   filled greedily with the longest piece that fits; then its smallest piece is replaced by two unpacked ones that fill the gap
   it leaves more tightly, as long as that helps. A pattern is repeated until one of its lengths runs short.
3. A piece's rank within its length (its task's offset plus its number there) gives bin and place. No rows are sorted or
   gathered for that: the plan has at most about two patterns for each length, so its size is bounded by the capacity alone.

Edge cases: a null or empty text is one piece with the end mark alone; rows with the same doc_id, or none, are packed one by one; an
empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.hashing import SMALL_CHUNK_BYTES, chunks, texts
from tillroll.llm.tokenize import Encoder
from tillroll.llm.workers import lean
from tillroll.operators.lineage import written

CAPACITY = 1024
END = 2

_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process, so that later tasks find the pieces of earlier ones."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, task int, nth long, ids binary"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()),
                    ("ids_crc32", pa.int64()), ("task", pa.int32()), ("nth", pa.int64()), ("ids", pa.binary())])


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = True) -> DataFrame:
    """Pieces of every document; ``ids`` holds little-endian 32-bit ids, or null where only their checksum is wanted."""

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).encode
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for first, last, data, offsets in chunks(*texts(batch.column("text")), SMALL_CHUNK_BYTES):
                ids, before = encode(data.tobytes(), offsets)
                rows = {name: [] for name in SCHEMA.names}
                for i in range(last - first):
                    every = np.append(ids[before[i] : before[i + 1]], np.uint32(end)).astype("<u4")
                    a, piece = 0, 0
                    b = (len(every) - 1) % capacity + 1
                    while a < len(every):
                        part = every[a:b]
                        rows["doc_id"].append(doc_ids[first + i])
                        rows["piece"].append(piece)
                        rows["start"].append(a)
                        rows["length"].append(b - a)
                        rows["ids_crc32"].append(zlib.crc32(part))
                        rows["task"].append(task)
                        rows["nth"].append(int(seen[b - a]))
                        rows["ids"].append(part.tobytes() if keep_ids else None)
                        seen[b - a] += 1
                        a, b, piece = b, b + capacity, piece + 1
                yield pa.record_batch(rows, schema=SCHEMA)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths of the pieces in a bin, number of such bins), so that all pieces are used."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n

    def longest() -> np.ndarray:
        """For each room the longest unpacked piece that fits, or 0."""
        return np.maximum.accumulate(np.where(left > 0, np.arange(capacity + 1), 0))

    plan = []
    while left.any():
        bin_, gap = [], capacity
        best = longest()
        while gap and best[gap]:
            bin_.append(int(best[gap]))
            gap -= bin_[-1]
            left[bin_[-1]] -= 1
            if not left[bin_[-1]]:
                best = longest()
        while gap:
            small = min(bin_)
            room = gap + small
            left[small] += 1
            best = longest()
            first = np.flatnonzero(left[: room + 1] > 0)
            second = best[room - first]
            # Two of the same length need two pieces of it: else the next shorter one is the second.
            twin = (second == first) & (left[first] < 2)
            second[twin] = best[first[twin] - 1]
            total = np.where(second > 0, first + second, 0)
            pick = int(total.argmax()) if len(total) else 0
            if not len(total) or total[pick] <= small:
                left[small] -= 1
                break
            bin_.remove(small)
            for x in (int(first[pick]), int(second[pick])):
                bin_.append(x)
                left[x] -= 1
            gap = room - int(total[pick])
        need = Counter(bin_)
        more = min(int(left[x]) // n for x, n in need.items())
        for x, n in need.items():
            left[x] -= n * more
        plan.append((sorted(bin_, reverse=True), more + 1))
    return plan


def slots(plan: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length, for ascending runs of ranks: first rank, pieces of that length in a bin, first sequence, place of offsets; offsets."""
    runs: dict[int, list] = {}
    used: Counter = Counter()
    sequence = 0
    for lengths, bins in plan:
        offset, at = 0, {}
        for x in lengths:
            at.setdefault(x, []).append(offset)
            offset += x
        for x, offsets in at.items():
            runs.setdefault(x, []).append((used[x], offsets, sequence))
            used[x] += len(offsets) * bins
        sequence += bins
    out = {}
    for x, found in runs.items():
        each = np.array([len(o) for _, o, _ in found])
        out[x] = (np.array([r for r, _, _ in found]), each, np.array([s for _, _, s in found]), np.cumsum(each) - each,
                  np.array([v for _, o, _ in found for v in o]))
    return out


def packed(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = True) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset`` there."""
    pieces = written(pieces_of(docs, tokenizer_path, capacity, end, keep_ids))
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = by_task.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).select("task", "length", "first")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    where = slots(patterns(counts, capacity))
    ranked = pieces.join(firsts, ["task", "length"]).withColumn("rank", F.col("first") + F.col("nth"))
    ranked = ranked.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "ids", "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length).tolist():
                rows = np.flatnonzero(length == x)
                first, each, bins, at, offsets = where[x]
                run = np.searchsorted(first, rank[rows], "right") - 1
                inside = rank[rows] - first[run]
                sequence[rows] = bins[run] + inside // each[run]
                offset[rows] = offsets[at[run] + inside % each[run]]
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.record_batch([*kept, pa.array(sequence), pa.array(offset), batch.column("ids")], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"]
    return ranked.mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, ids binary"
    )


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return packed(docs, public_tokenizer(), keep_ids=False).drop("ids")
