"""Jaccard self-join of documents on their sets of 5-word shingles (similarity 0.8 or more), and its components.

Rare-first prefix filtering with length, positional and suffix filters:

1. Texts that are equal byte for byte become one class, whatever their number; a task drops its own copies before the shuffle.
2. Every class is in one of the *groups* (a hash of the text). A group sends each of its distinct shingles once with a count
   (pre-aggregated, packed in arrays), so a shingle of a third of all documents costs one entry for each group. The sum is the
   document frequency; shingles of two documents or more go back to the groups that have them.
3. A document orders its shingles by (frequency, hash). Shingles that no other document has come first and can't join, so
   a document whose prefix consists of them has no partner. The rest of the prefixes is the inverted index.
4. First each document is verified against one *leader*, the most central document of the buckets that it shares most often.
   That links the large groups of near copies in linear time. Then all pairs of the index that lie in different components
   are verified, each once, after the length, positional and suffix filters. A pair inside a component can't change it.

No bucket, partner or candidate is capped. Shingles are compared by 64-bit hashes (52 bits in pairs that passed the filters).

Edge cases: a text without words has an empty set and no links; a null text is empty; rows with one doc_id count as one document
with several texts; a row without doc_id gets its ``n_shingles`` and a null ``component_id``; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.components import components
from tillroll.llm.hashing import SMALL_CHUNK_BYTES, U, chunks, shingle_sets, texts, word_hashes
from tillroll.llm.workers import lean, lean_cogroup, lean_group
from tillroll.operators.lineage import written

PERCENT = 80
HASH_BITS = 52
HASH_MASK = U((1 << HASH_BITS) - 1)
#: Frequencies from here on are ordered by hash alone. The top bit stays clear, so that keys have one order, signed or not.
TOP_FREQUENCY = (1 << (63 - HASH_BITS)) - 1


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text, F.lit("x")).alias("h2")]


def groups_for(df: DataFrame) -> int:
    """Groups of texts: two for each shuffle partition (which the user sizes to the data), so that a Python worker holds half of one."""
    return 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


@lean
def local_copies_dropped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        keys = zip(batch.column("h1").to_pylist(), batch.column("h2").to_pylist(), strict=True)
        new = []
        for k in keys:
            new.append(k not in seen)
            seen.add(k)
        yield batch.filter(pa.array(new, pa.bool_()))


def grouped_texts(docs: DataFrame, groups: int) -> DataFrame:
    """(s, h1, h2, text): the texts in their groups, most copies gone."""
    keyed = docs.select(F.coalesce("text", F.lit("")).alias("text")).select(
        F.pmod(F.xxhash64("text", F.lit(3)), F.lit(groups)).cast("int").alias("s"), *text_key(F.col("text")), "text"
    )
    return keyed.mapInArrow(local_copies_dropped, keyed.schema).repartition(groups, "s")


def distinct_rows(table: pa.Table) -> pa.Table:
    keys = np.rec.fromarrays([table.column("h1").to_numpy(), table.column("h2").to_numpy()])
    return table.take(pa.array(np.sort(np.unique(keys, return_index=True)[1])))


def sets_of(table: pa.Table) -> Iterator[np.ndarray]:
    for batch in table.combine_chunks().to_batches():
        for _, _, data, offsets in chunks(*texts(batch.column("text")), SMALL_CHUNK_BYTES):
            yield from shingle_sets(*word_hashes(data, offsets))


def pack(sorted_values: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as differences, bytes of equal weight together, which the shuffle's codec then shrinks."""
    step = np.diff(sorted_values, prepend=U(0))
    return np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(U).ravel(), dtype=U)


PARTS = pa.schema([("bucket", pa.int32()), ("s", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
PARTS_DDL = "bucket int, s int, keys binary, counts binary"


def bucketed(s: int, keys: np.ndarray, counts: np.ndarray, buckets: int) -> pa.Table:
    """Rows of PARTS for sorted keys, dealt to ranges of the key space."""
    bounds = np.searchsorted(keys, np.array([(b << HASH_BITS) // buckets for b in range(1, buckets)], U))
    rows = {"bucket": [], "s": [], "keys": [], "counts": []}
    for b, (k, c) in enumerate(zip(np.split(keys, bounds), np.split(counts, bounds), strict=True)):
        if len(k):
            for name, v in (("bucket", b), ("s", s), ("keys", pack(k)), ("counts", c.astype(np.uint32).tobytes())):
                rows[name].append(v)
    return pa.table(rows, schema=PARTS)


@lean_group
def shared_keys(table: pa.Table) -> pa.Table:
    """For each group the keys that count twice or more over all groups, with their counts."""
    owners = table.column("s").to_pylist()
    keys = [unpack(x.as_py()) for x in table.column("keys")]
    counts = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table.column("counts")])
    owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    every = every[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    total = np.add.reduceat(counts[order].astype(np.int64), first)
    total = np.repeat(total, np.diff(np.append(first, len(every))))
    some = total >= 2
    every, total, owner = every[some], total[some], owner[order][some]
    back = np.argsort(owner, kind="stable")
    ends = np.searchsorted(owner[back], np.arange(1, len(keys)))
    bucket = table.column("bucket")[0].as_py()
    rows = {"bucket": [], "s": [], "keys": [], "counts": []}
    for s, part in zip(owners, np.split(back, ends), strict=True):
        if len(part):
            for name, v in (("bucket", bucket), ("s", s), ("keys", pack(every[part])),
                            ("counts", np.minimum(total[part], TOP_FREQUENCY).astype(np.uint32).tobytes())):
                rows[name].append(v)
    return pa.table(rows, schema=PARTS)


def answers(parts: DataFrame, groups: int) -> DataFrame:
    return parts.repartition(groups, "bucket").groupBy("bucket").applyInArrow(shared_keys, PARTS_DDL)


def merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and counts of a group's answers."""
    if not table.num_rows:
        return np.zeros(0, U), np.zeros(0, np.uint32)
    keys = np.concatenate([unpack(x.as_py()) for x in table.column("keys")])
    counts = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table.column("counts")])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    return keys[new], counts[new]


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


SETS_DDL = "h1 long, h2 long, n long, own long, keys binary"


def described_sets(texts_of_group: DataFrame, parts: DataFrame) -> DataFrame:
    """For each text: size of its set, how many shingles are its own, and if a partner is possible the shared ones in order."""

    @lean_cogroup
    def describe(table: pa.Table, answer: pa.Table) -> pa.Table:
        rows = {"h1": [], "h2": [], "n": [], "own": [], "keys": []}
        if table.num_rows:
            table = distinct_rows(table)
            keys, counts = merged(answer)
            rows["h1"], rows["h2"] = table.column("h1"), table.column("h2")
            for found in sets_of(table):
                n, h = len(found), np.unique(found & HASH_MASK)
                at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
                hit = keys[at] == h if len(keys) else np.zeros(len(h), bool)
                own = n - int(hit.sum())
                rows["n"].append(n)
                rows["own"].append(own)
                ordered = np.sort((counts[at[hit]].astype(U) << U(HASH_BITS)) | h[hit])
                rows["keys"].append(ordered.tobytes() if n and own < prefix_length(n) else None)
        return pa.table(rows, schema=pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64()),
                                                ("own", pa.int64()), ("keys", pa.binary())]))

    return texts_of_group.groupBy("s").cogroup(parts.groupBy("s")).applyInArrow(describe, SETS_DDL)


def counted_shingles(texts_of_group: DataFrame, buckets: int) -> DataFrame:
    @lean_group
    def count(table: pa.Table) -> pa.Table:
        s = table.column("s")[0].as_py()
        every = np.concatenate([np.unique(x & HASH_MASK) for x in sets_of(distinct_rows(table))])
        keys, counts = np.unique(every, return_counts=True)
        return bucketed(s, keys, counts, buckets)

    return texts_of_group.groupBy("s").applyInArrow(count, PARTS_DDL)


def index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for node, n, own, keys in zip(*(batch.column(c).to_pylist() for c in ("node", "n", "own", "keys")), strict=True):
            k = np.frombuffer(keys, U)[: prefix_length(n) - own].view(np.int64)
            if len(k):
                m = len(k)
                yield pa.record_batch(
                    [pa.array(k), pa.array(np.full(m, node)), pa.array(np.full(m, n)), pa.array(np.full(m, own)),
                     pa.array(own + np.arange(m, dtype=np.int64))], ["key", "node", "n", "own", "pos"])


def prefix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, own = batch.column("n").to_pylist(), batch.column("own").to_pylist()
        found = [
            np.frombuffer(keys, U)[: prefix_length(x) - o].view(np.int64)
            for x, o, keys in zip(n, own, batch.column("keys").to_pylist(), strict=True)
        ]
        after = [x - prefix_length(x) for x in n]
        yield pa.record_batch([batch.column("node"), pa.array(after, pa.int64()), pa.array(found, pa.list_(pa.int64()))],
                              ["node", "after", "prefix"])


def least_overlap(a: Column, b: Column) -> Column:
    return F.ceil(PERCENT * (a + b) / (100 + PERCENT))


def similar_sizes(a: Column, b: Column) -> Column:
    return (100 * a >= PERCENT * b) & (100 * b >= PERCENT * a)


def pairs_of(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) once each, after the positional filter at their first common key; ``common`` counts the prefix keys shared."""
    pairs = rows.groupBy("a", "b").agg(
        F.min("pos_a").alias("pos_a"), F.min("pos_b").alias("pos_b"), F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"),
        F.count("*").alias("common"),
    )
    room = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    return pairs.filter(room >= least_overlap(F.col("n_a"), F.col("n_b")))


def may_overlap(x: np.ndarray, y: np.ndarray, missing: int, depth: int = 2) -> bool:
    """Suffix filter: splits both ordered lists at the middle key of ``y`` and adds up how far the sizes differ."""

    def differ(x: np.ndarray, y: np.ndarray, depth: int) -> int:
        if not depth or not len(x) or not len(y):
            return abs(len(x) - len(y))
        pivot = y[len(y) // 2]
        at = int(np.searchsorted(x, pivot))
        return differ(x[:at], y[: len(y) // 2], depth - 1) + differ(x[at:], y[len(y) // 2 :], depth - 1)

    return differ(x, y, depth) <= missing


@lean
def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = [], []
        columns = (batch.column(c).to_pylist() for c in ("a", "b", "n_a", "n_b", "keys_a", "keys_b"))
        for i, j, n_i, n_j, x, y in zip(*columns, strict=True):
            x, y = np.frombuffer(x, U), np.frombuffer(y, U)
            need = -(-PERCENT * (n_i + n_j) // (100 + PERCENT))
            if may_overlap(x, y, len(x) + len(y) - 2 * need):
                if len(np.intersect1d(x, y, assume_unique=True)) >= need:
                    a.append(i)
                    b.append(j)
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def links_of(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    x = sets.select(F.col("node").alias("a"), F.col("keys").alias("keys_a"))
    y = sets.select(F.col("node").alias("b"), F.col("keys").alias("keys_b"))
    both = pairs.select("a", "b", "n_a", "n_b").join(x, "a").join(y, "b")
    return both.mapInArrow(verified, "a long, b long")


def similar_documents(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` for every row of ``docs`` (which has ``doc_id`` and ``text``)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    groups = groups_for(docs)
    keyed = written(docs.select("doc_id", *text_key(F.coalesce("text", F.lit("")))))
    classes = keyed.filter("doc_id IS NOT NULL").groupBy("h1", "h2").agg(F.min("doc_id").alias("node"))
    grouped = grouped_texts(docs, groups)
    sets = written(described_sets(grouped, answers(counted_shingles(grouped, groups), groups)))

    active = written(sets.filter("keys IS NOT NULL").join(classes, ["h1", "h2"]).select("node", "n", "own", "keys"))
    index = written(active.mapInArrow(index_rows, "key long, node long, n long, own long, pos long"))

    # One leader for each document: of the most central documents in its buckets, the one that shares most prefix keys.
    leaders = index.groupBy("key").agg(
        F.count("*").alias("size"), F.min(F.struct((F.col("own") / F.col("n")).alias("share"), "node", "n", "pos")).alias("top")
    ).filter("size > 1").select("key", F.col("top.node").alias("b"), F.col("top.n").alias("n_b"), F.col("top.pos").alias("pos_b"))
    to_leader = index.select("key", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("pos").alias("pos_a")).join(
        leaders, "key").filter((F.col("a") != F.col("b")) & similar_sizes(F.col("n_a"), F.col("n_b")))
    nearest = pairs_of(to_leader).groupBy("a").agg(
        F.max(F.struct("common", "b", "n_a", "n_b")).alias("top")
    ).select("a", "top.b", "top.n_a", "top.n_b")
    # Classes whose rows share a doc_id need no link: they have one node.
    links = written(links_of(nearest, active))
    spread = components(links)

    # What is left: pairs of the index in different components.
    placed = written(
        index.join(spread.withColumnRenamed("id", "node"), "node", "left").select(
            "key", "node", "n", "own", "pos", F.coalesce("component", "node").alias("component")
        )
    )
    parts = placed.groupBy("key", "component").agg(F.count("*").alias("size"))
    mixed = parts.groupBy("key").agg(F.count("*").alias("n_parts"), F.max(F.struct("size", "component")).alias("top")).filter(
        "n_parts > 1").select("key", F.col("top.component").alias("largest"))
    rest = placed.join(mixed.withColumn("component_largest", F.col("largest")), "key")
    # A row carries its document's prefix, so that the join lets a pair through at its first common key alone, and only if the
    # common keys of the prefixes and what follows the shorter-reaching prefix can still add up.
    rest = rest.withColumn("before", F.col("pos") - F.col("own")).join(
        active.mapInArrow(prefix_rows, "node long, after long, prefix array<long>"), "node")
    sides = ["node", "n", "pos", "component", "before", "after", "prefix"]
    left = rest.filter("component <> largest").select(
        "key", "component_largest", *[F.col(c).alias(f"{c}_a") for c in sides])
    right = rest.select("key", *[F.col(c).alias(f"{c}_b") for c in sides])
    n_a, n_b = F.col("n_a"), F.col("n_b")
    earlier = [F.slice(f"prefix_{x}", F.lit(1), F.col(f"before_{x}").cast("int")) for x in "ab"]
    reach = F.element_at("prefix_a", -1) <= F.element_at("prefix_b", -1)
    in_both = F.size(F.array_intersect("prefix_a", "prefix_b"))
    met = left.join(right, "key").filter(
        (F.col("component_a") != F.col("component_b"))
        # Between two smaller components the pair comes up from both sides: one is enough.
        & ((F.col("component_b") == F.col("component_largest")) | (F.col("node_a") < F.col("node_b")))
        & similar_sizes(n_a, n_b)
        & (F.least(n_a - F.col("pos_a"), n_b - F.col("pos_b")) >= least_overlap(n_a, n_b))
        & ~F.arrays_overlap(*earlier)
        & (in_both + F.when(reach, F.col("after_a")).otherwise(F.col("after_b")) >= least_overlap(n_a, n_b))
    )
    one_way = met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), "n_a", "n_b").dropDuplicates(["a", "b"])
    more = links_of(one_way, active)
    final = components(links.unionByName(more))

    named = classes.join(final.withColumnRenamed("id", "node"), "node", "left").select(
        "h1", "h2", F.coalesce("component", "node").alias("component"))
    lowest = sets.select("h1", "h2", "n").join(named, ["h1", "h2"], "left")
    return keyed.join(lowest, ["h1", "h2"]).select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))).alias("component_id"),
    )


def op3_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """Size of the shingle set and component of every document."""
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The stage of the pipeline: of each component the document with the smallest id stays (rows without id stay too).

    Of several rows with that doc_id the least in the order of the columns stays.
    """
    keep = similar_documents(docs).filter("doc_id = component_id").select("doc_id").distinct()
    named = docs.filter("doc_id IS NOT NULL").join(keep, "doc_id", "left_semi")
    others = [c for c in docs.columns if c != "doc_id"]
    least = named.groupBy("doc_id").agg(F.min(F.struct(*others)).alias("least")).select("doc_id", "least.*")
    return least.select(docs.columns).unionByName(docs.filter("doc_id IS NULL"))
