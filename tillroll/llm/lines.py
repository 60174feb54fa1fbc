"""Line dedup: a line that stands in many documents goes from all of them.

A line's key is the line without white space at both ends, A-Z as a-z; it is known by a 128-bit BLAKE2 hash. Documents are dealt to
groups, and groups to batches. *Levelled sorted runs* of hashes keep what has been seen:

1. One scan gives for each group its distinct hashes with the number of documents that have them, sorted and packed, cut at the
   borders of the buckets (ranges of the hash). A line of a third of all documents is one entry for each group.
2. A batch comes in sorted. A merge drops the hashes that the runs already know to be *common* (an anti-join: these need no more
   counting), adds up the rest, and writes it as a run of level 0. Hashes that reach ``least`` documents go to the common runs.
3. When a level has ``FANOUT`` runs, they are compacted into one of the next level, which again moves what reached ``least``. The last
   compaction takes all levels, so that every count is whole.
4. Every group asks the common runs, bucket by bucket, for its own hashes, and cuts these lines from its documents. Texts are
   shuffled once, by a hash of id and text, so copies of one text spread over all groups.

``LineRuns`` may live on: further batches can be added to the same runs.

Edge cases: a null or empty text is one empty line; a key shorter than ``min_chars`` is never dropped; rows are documents, also those
with one doc_id or none; a line counts once for each document however often it stands there; a text whose lines all go
keeps the empty text; an empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.hashing import chunks, texts
from tillroll.operators.lineage import ensure_checkpoint_dir

LINE_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
LEAST, MIN_CHARS = 10, 1
BATCHES, FANOUT = 8, 4
HASH_BYTES = 16
#: A task hands on what it has gathered when it holds this much.
TASK_BYTES = 64 << 20


def line_key(line: bytes) -> bytes:
    return line.strip(LINE_SPACE).lower()


def line_hash(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=HASH_BYTES).digest()


def hashes_of(text: bytes, min_chars: int) -> set[bytes]:
    """Hashes of the distinct lines that may be dropped."""
    keys = {line_key(line) for line in text.split(b"\n")}
    return {line_hash(k) for k in keys if len(k) >= min_chars and (min_chars <= 1 or len(k.decode()) >= min_chars)}


def unpacked(packed: bytes) -> np.ndarray:
    """A row of two 64-bit numbers for each hash."""
    return np.frombuffer(packed, np.uint64).reshape(-1, 2)


def sorted_run(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes in order, with the sum of their counts."""
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def gathered(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of all rows, as they come."""
    keys = [unpacked(x.as_py()) for x in table.column("keys")]
    counts = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("counts")]
    if not keys:
        return np.zeros((0, 2), np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(counts).astype(np.int64)


def packed_counts(counts: np.ndarray) -> bytes:
    return np.minimum(counts, (1 << 32) - 1).astype(np.uint32).tobytes()


GROUPS_DDL = "s int, keys binary, counts binary"
GROUPS = pa.schema([("s", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
LINES_DDL = "s int, bucket int, keys binary, counts binary"
LINES = pa.schema([("s", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
RUN_DDL = "bucket int, common boolean, keys binary, counts binary"
RUN = pa.schema([("bucket", pa.int32()), ("common", pa.bool_()), ("keys", pa.binary()), ("counts", pa.binary())])


def line_counts(grouped: DataFrame, buckets: int, min_chars: int) -> DataFrame:
    """LINES: for each group ``s`` its distinct hashes with their documents, sorted and cut into buckets."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[bytes]] = defaultdict(list)
        held = 0

        def rows() -> pa.RecordBatch:
            runs = [(s, *sorted_run(k := unpacked(b"".join(own)), np.ones(len(k), np.int64))) for s, own in found.items()]
            return pa.record_batch([pa.array([s for s, _, _ in runs], pa.int32()), pa.array([k.tobytes() for _, k, _ in runs], pa.binary()),
                                    pa.array([packed_counts(c) for _, _, c in runs], pa.binary())], schema=GROUPS)

        for batch in batches:
            groups = batch.column("s").to_pylist()
            for head, last, data, offsets in chunks(*texts(batch.column("text"))):
                raw = data.tobytes()
                for i in range(last - head):
                    if own := hashes_of(raw[offsets[i] : offsets[i + 1]], min_chars):
                        found[groups[head + i]].append(b"".join(own))
                        held += HASH_BYTES * len(own)
                if held > TASK_BYTES:
                    yield rows()
                    found.clear()
                    held = 0
        yield rows()

    def cut(key: tuple, table: pa.Table) -> pa.Table:
        keys, counts = sorted_run(*gathered(table))
        bounds = np.searchsorted(keys[:, 0], np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64))
        parts = [(b, k, c) for b, (k, c) in enumerate(zip(np.split(keys, bounds), np.split(counts, bounds), strict=True)) if len(k)]
        return pa.table([pa.array([key[0].as_py()] * len(parts), pa.int32()), pa.array([b for b, _, _ in parts], pa.int32()),
                         pa.array([k.tobytes() for _, k, _ in parts], pa.binary()),
                         pa.array([packed_counts(c) for _, _, c in parts], pa.binary())], schema=LINES)

    return grouped.select("s", "text").mapInArrow(gather, GROUPS_DDL).groupBy("s").applyInArrow(cut, LINES_DDL)


class LineRuns:
    """Sorted runs of line hashes in levels, as Parquet tables in the shared checkpoint folder."""

    def __init__(self, spark: SparkSession, least: int = LEAST, fanout: int = FANOUT):
        ensure_checkpoint_dir(spark)
        self.spark, self.least, self.fanout = spark, least, fanout
        self.base = f"{spark.sparkContext.getCheckpointDir()}/line-runs-{uuid.uuid4()}"
        self.levels: list[list[str]] = [[]]
        self.common_runs: list[str] = []
        self.written = 0

    def _read(self, paths: list[str], common: bool) -> DataFrame:
        kinds = [self.spark.read.schema(RUN_DDL).parquet(p).filter(F.col("common") == common) for p in paths]
        return reduce(DataFrame.unionAll, kinds) if kinds else self.spark.createDataFrame([], RUN_DDL)

    def common(self) -> DataFrame:
        """Rows of the runs of hashes with ``least`` documents or more."""
        return self._read(self.common_runs, True)

    def _merge(self, runs: DataFrame) -> str:
        """Writes the sum of ``runs`` without the hashes that are common already; the new common ones are marked."""
        least = self.least

        def fold(key: tuple, table: pa.Table) -> pa.Table:
            known = table.column("common")
            fresh, counts = sorted_run(*gathered(table.filter(pc.invert(known))))
            old, _ = gathered(table.filter(known))
            # The merge of both in order: a fresh hash goes when the same one stands in a common run.
            every = np.concatenate([fresh, old])
            order = np.lexsort((np.arange(len(every)) < len(fresh), every[:, 1], every[:, 0]))
            again = np.zeros(len(every), bool)
            again[order[1:]] = (every[order[1:]] == every[order[:-1]]).all(axis=1)
            new = ~again[: len(fresh)]
            fresh, counts = fresh[new], counts[new]
            often = counts >= least
            parts = [(c, fresh[own], counts[own]) for c, own in ((True, often), (False, ~often)) if own.any()]
            return pa.table([pa.array([key[0].as_py()] * len(parts), pa.int32()), pa.array([c for c, _, _ in parts], pa.bool_()),
                             pa.array([k.tobytes() for _, k, _ in parts], pa.binary()),
                             pa.array([packed_counts(n) for _, _, n in parts], pa.binary())], schema=RUN)

        path = f"{self.base}/run-{self.written}"
        self.written += 1
        runs.unionByName(self.common()).groupBy("bucket").applyInArrow(fold, RUN_DDL).write.parquet(path)
        self.common_runs.append(path)
        return path

    def add(self, lines: DataFrame) -> None:
        """One batch of LINES becomes a run of level 0; full levels are compacted."""
        self.levels[0].append(self._merge(lines.select("bucket", F.lit(False).alias("common"), "keys", "counts")))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._merge(self._read(self.levels[level], False)))
            self.levels[level] = []
            level += 1

    def settle(self) -> None:
        """Compacts all levels into one run, after which no count is spread over runs."""
        runs = [p for level in self.levels for p in level]
        if len(runs) > 1:
            self.levels = [[] for _ in self.levels[:-1]] + [[self._merge(self._read(runs, False))]]


ANSWER_DDL = "s int, keys binary"
ANSWER = pa.schema([("s", pa.int32()), ("keys", pa.binary())])


def answers(lines: DataFrame, common: DataFrame) -> DataFrame:
    """(s, keys): the hashes of each group that are common."""

    def meet(table: pa.Table) -> pa.Table:
        asking = table.column("s").is_valid()
        often, _ = gathered(table.filter(pc.invert(asking)))
        found: list[tuple[int, bytes]] = []
        if len(often):
            rows = table.filter(asking)
            keys, _ = gathered(rows)
            size = np.array([len(x.as_py()) // HASH_BYTES for x in rows.column("keys")])
            every = np.concatenate([often, keys])
            order = np.lexsort((np.arange(len(every)) >= len(often), every[:, 1], every[:, 0]))
            sorted_ = every[order]
            run = np.cumsum(np.concatenate([[False], (sorted_[1:] != sorted_[:-1]).any(axis=1)]))
            mine = order < len(often)
            marked = np.zeros(int(run[-1]) + 1, bool)
            marked[run[mine]] = True
            hit = np.zeros(len(every), bool)
            hit[order] = marked[run]
            hit = hit[len(often) :]
            ends = np.cumsum(size)
            for s, a, b in zip(rows.column("s").to_pylist(), (ends - size).tolist(), ends.tolist(), strict=True):
                if (own := keys[a:b][hit[a:b]]).size:
                    found.append((s, own.tobytes()))
        return pa.table([pa.array([s for s, _ in found], pa.int32()), pa.array([k for _, k in found], pa.binary())], schema=ANSWER)

    asked = lines.select("s", "bucket", "keys", "counts").unionByName(
        common.select(F.lit(None).cast("int").alias("s"), "bucket", "keys", "counts"))
    return asked.groupBy("bucket").applyInArrow(meet, ANSWER_DDL)


KEPT_DDL = "doc_id long, n_lines long, n_dropped long, kept string, kept_sha256 string"
KEPT = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept", pa.string()),
                  ("kept_sha256", pa.string())])


def cut_lines(grouped: DataFrame, common: DataFrame, keep_text: bool) -> DataFrame:
    def cut(table: pa.Table, found: pa.Table) -> pa.Table:
        gone = {p[i : i + HASH_BYTES] for x in found.column("keys") for p in [x.as_py()] for i in range(0, len(p), HASH_BYTES)}
        out = []
        for batch in table.to_batches():
            rows: list[tuple] = []
            ids = batch.column("doc_id").to_pylist()
            for head, last, data, offsets in chunks(*texts(batch.column("text"))):
                raw = data.tobytes()
                for i in range(last - head):
                    text = raw[offsets[i] : offsets[i + 1]]
                    lines = text.split(b"\n")
                    kept = [x for x in lines if line_hash(line_key(x)) not in gone] if gone else lines
                    rest = text if len(kept) == len(lines) else b"\n".join(kept)
                    rows.append((ids[head + i], len(lines), len(lines) - len(kept), rest if keep_text else None,
                                 hashlib.sha256(rest).hexdigest()))
            if rows:
                columns = [pa.array(c, pa.binary() if f.name == "kept" else f.type).cast(f.type)
                           for c, f in zip(zip(*rows, strict=True), KEPT, strict=True)]
                out.append(pa.record_batch(columns, schema=KEPT))
        return pa.Table.from_batches(out, KEPT)

    return grouped.groupBy("s").cogroup(common.groupBy("s")).applyInArrow(cut, KEPT_DDL)


def without_common_lines(
    docs: DataFrame, least: int = LEAST, min_chars: int = MIN_CHARS, keep_text: bool = True, batches: int = BATCHES
) -> DataFrame:
    """For every row doc_id, n_lines, n_dropped, ``kept`` (the text that stays, null unless wanted) and its digest."""
    spark = docs.sparkSession
    groups = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    filled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = filled.select(F.pmod(F.xxhash64("doc_id", "text", F.lit(13)), F.lit(groups)).cast("int").alias("s"), "doc_id", "text")
    runs = LineRuns(spark, least)
    path = f"{runs.base}/lines"
    line_counts(grouped, groups, min_chars).withColumn("batch", F.pmod("s", F.lit(batches))).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(f"{LINES_DDL}, batch int").parquet(path)
    for k in range(batches):
        runs.add(lines.filter(F.col("batch") == k))
    runs.settle()
    return cut_lines(grouped, answers(lines, runs.common()), keep_text)


def op13_line_dedup(spark, sf_dir: str) -> DataFrame:
    """What stays of every document when the lines of ten documents or more are gone."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return without_common_lines(docs, keep_text=False).drop("kept")


ORACLE_SQL = r"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
),
line AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS nth FROM split
),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line
),
common AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(common.key) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (WHERE common.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common ON keyed.key = common.key GROUP BY doc_id
"""
