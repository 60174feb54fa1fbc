"""Ranked lexical search the other way round: the items are indexed, the documents are streamed.

1. The items' terms make an inverted index (term to items and counts), which is broadcast. It is bounded by ``SLICE_BYTES`` of items;
   a larger set of items is searched in slices, two scans for each.
2. The first scan counts documents, terms and in how many documents each term of the index stands; sums on the map side.
3. The second scan streams each document's term counts through the index, adds up the scores of all items, and keeps the best
   ``TOP`` documents of each item in a bounded heap. Heaps of tasks are merged in two steps, so no task sees those of all others.

Terms are compared by hash and then byte by byte. All arithmetic after the weights is on 64-bit integers.

Edge cases: a document without terms is not counted and never found; a null or empty item finds nothing; equal items are ranked each for
itself; rows with one doc_id are ranked one by one, a row without one after all others of its score; an empty table on either side
gives an empty result; other columns are left out.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.hashing import LOWER, U, chunks, mix, prefix_hash, range_hash, texts, words

TOP = 20
SLICE_BYTES = 8 << 20
#: Most places of the table of scores, and most postings, that are worked on at once (unless one document has more).
BLOCK = 1 << 19
MERGERS = 32
LAST = (1 << 63) - 1
#: Bytes between terms: ASCII that is neither letter nor digit.
GAPS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes; starts, ends and hashes of the terms; the place of each text's first term."""
    low = LOWER[data]
    begin, end, place = words(low, offsets, GAPS)
    return low, begin, end, mix(range_hash(prefix_hash(low), begin, end) + (end - begin).astype(U)), place


def places_in(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [start, start + size), one range after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


@dataclass
class Index:
    """Terms in the order of their hashes, each with its bytes, and its items with the counts there."""

    hashes: np.ndarray
    data: np.ndarray
    start: np.ndarray
    first: np.ndarray
    item: np.ndarray
    count: np.ndarray
    item_ids: list

    def found(self, low: np.ndarray, begin: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and numbers of the terms that the index has."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        size = np.diff(self.start)
        place = np.flatnonzero((self.hashes[at] == hashes) & (size[at] == end - begin))
        term = at[place]
        same = low[places_in(begin[place], size[term])] == self.data[places_in(self.start[term], size[term])]
        sure = np.logical_and.reduceat(same, np.cumsum(size[term]) - size[term]) if len(term) else np.zeros(0, bool)
        return place[sure], term[sure]


def index_of(rows: list) -> Index:
    """Of items (item_id, text)."""
    data, offsets = texts(pa.array([r["text"] or "" for r in rows], pa.string()))
    low, begin, end, hashes, place = terms_of(data, offsets)
    raw = low.tobytes()
    spelled = [raw[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
    hash_of = dict(zip(spelled, hashes.tolist(), strict=True))
    order = sorted(hash_of, key=hash_of.get)
    if len(set(hash_of.values())) < len(order):
        raise ValueError("two terms of the items have one hash")
    number = {w: k for k, w in enumerate(order)}
    owner = np.repeat(np.arange(len(rows)), np.diff(place)).tolist()
    postings = sorted((number[w], i, n) for (w, i), n in Counter(zip(spelled, owner, strict=True)).items())
    term, item, count = (np.array(x, np.int64) for x in (zip(*postings, strict=True) if postings else ([], [], [])))
    start = np.cumsum([0, *map(len, order)])
    return Index(np.array([hash_of[w] for w in order], U), np.frombuffer(b"".join(order), np.uint8), start,
                 np.searchsorted(term, np.arange(len(order) + 1)), item, count, [r["item_id"] for r in rows])


def statistics(docs: DataFrame, index: Index) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the documents of each term of the index."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        some, every, df = 0, 0, np.zeros(len(index.hashes), np.int64)
        for batch in batches:
            for _, _, data, offsets in chunks(*texts(batch.column("text"))):
                low, begin, end, hashes, place = terms_of(data, offsets)
                length = np.diff(place)
                some += int(np.count_nonzero(length))
                every += int(length.sum())
                at, term = index.found(low, begin, end, hashes)
                doc = np.searchsorted(place, at, "right") - 1
                df += np.bincount(np.unique(doc * max(len(df), 1) + term) % max(len(df), 1), minlength=len(df))[: len(df)]
        there = np.flatnonzero(df)
        yield pa.record_batch([pa.array([-1, -2, *there.tolist()], pa.int32()), pa.array([some, every, *df[there].tolist()], pa.int64())],
                              ["term", "n"])

    sums = docs.select("text").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    total = {r["term"]: r["n"] for r in sums.collect()}  # no more rows than the index has terms, and two
    df = np.array([total.get(k, 0) for k in range(len(index.hashes))], np.int64)
    return total.get(-1, 0), total.get(-2, 0), df


class Heaps:
    """The best documents of each item so far, and the score and id that a further one must beat."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in range(items)]
        self.score = np.zeros(items, np.int64)
        self.order = np.full(items, -LAST - 1, np.int64)

    def update(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` has a row for each document."""
        better = (scores > self.score) | ((scores == self.score) & (ids[:, None] < self.order) & (scores > 0))
        for d, i in zip(*(x.tolist() for x in np.nonzero(better)), strict=True):
            heap, entry = self.heaps[i], (int(scores[d, i]), ~int(ids[d]))
            if len(heap) < self.top:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.top:
                self.score[i], self.order[i] = heap[0][0], ~heap[0][1]


SCORES_DDL = "item int, task int, doc long, score long"
SCORES = pa.schema([("item", pa.int32()), ("task", pa.int32()), ("doc", pa.int64()), ("score", pa.int64())])


def best(docs: DataFrame, index: Index, top: int = TOP) -> DataFrame:
    """(item, rank, doc_id, score) of the items of an index."""
    n_docs, n_terms, df = statistics(docs, index)
    if not n_terms:
        return docs.sparkSession.createDataFrame([], "item int, rank int, doc_id long, score long")
    weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((index, weights))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, weights = shared.value
        size, items = max(len(weights), 1), len(index.item_ids)
        heaps = Heaps(items, top)
        postings = np.diff(index.first)
        for batch in batches:
            ids = batch.column("doc").to_numpy()
            for head, _, data, offsets in chunks(*texts(batch.column("text"))):
                low, begin, end, hashes, place = terms_of(data, offsets)
                at, term = index.found(low, begin, end, hashes)
                pair, tf = np.unique((np.searchsorted(place, at, "right") - 1) * size + term, return_counts=True)
                doc, term = pair // size, pair % size
                m = 75 + (25 * np.diff(place) * n_docs) // n_terms
                value = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
                # Blocks of whole documents, bounded in scores and in postings.
                heads = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
                ends = np.append(heads[1:], len(doc))
                cost = np.cumsum(postings[term])
                a = 0
                while a < len(heads):
                    before = cost[heads[a] - 1] if heads[a] else 0
                    b = max(a + 1, min(a + max(1, BLOCK // max(items, 1)), int(np.searchsorted(cost[ends - 1], before + BLOCK, "right"))))
                    own = slice(heads[a], ends[b - 1])
                    each = postings[term[own]]
                    posting = places_in(index.first[term[own]], each)
                    scores = np.zeros((b - a) * items, np.int64)
                    row = np.repeat(np.arange(b - a), ends[a:b] - heads[a:b])
                    np.add.at(scores, np.repeat(row * items, each) + index.item[posting], np.repeat(value[own], each) * index.count[posting])
                    heaps.update(scores.reshape(b - a, items), ids[head + doc[heads[a:b]]])
                    a = b
        task = TaskContext.get().partitionId()
        rows = [(i, task, ~key, score) for i, heap in enumerate(heaps.heaps) for score, key in heap]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, SCORES, strict=True)], schema=SCORES)

    found = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "text").mapInArrow(stream, SCORES_DDL)
    order = [F.col("score").desc(), F.col("doc")]
    some = Window.partitionBy("item", "merger").orderBy(*order)
    merged = found.withColumn("merger", F.pmod("task", F.lit(MERGERS))).withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= top)
    ranked = merged.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select("item", "rank", F.when(F.col("doc") < LAST, F.col("doc")).alias("doc_id"), "score")


FOUND_DDL = "item_id long, rank int, doc_id long, score long"


def search(docs: DataFrame, items: DataFrame, top: int = TOP, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the best documents of every item."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = -(-size // slice_bytes) or 1
    out = None
    for k in range(slices):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k).collect()  # about slice_bytes
        if not rows:
            continue
        numbers = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], "item int, item_id long")
        found = best(docs, index_of(rows), top).join(numbers, "item").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], FOUND_DDL) if out is None else out


def op12_ranked_lexical_search(spark, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE_SQL = r"""
WITH term AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents
),
item AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark
),
doc AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM term GROUP BY doc_id),
total AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM doc),
tf AS (SELECT doc_id, t, CAST(count(*) AS BIGINT) AS tf FROM term WHERE t IN (SELECT t FROM item) GROUP BY doc_id, t),
weight AS (
  SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY t, n_docs
),
part AS (
  SELECT doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))) AS value
  FROM tf JOIN weight USING (t) JOIN doc USING (doc_id), total
),
scored AS (
  SELECT item_id, doc_id, CAST(sum(value) AS BIGINT) AS score FROM item JOIN part USING (t) GROUP BY item_id, doc_id
),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
