"""Removal of repeated strings: bytes covered by a string of 100 bytes that starts earlier somewhere else.

A distributed suffix sort of all windows of 100 bytes, of which only those go to the shuffle that can have a twin:

1. Equal texts form classes; all but the smallest doc_id's is removed as a whole (if it has 100 bytes), so one text stands for a class.
2. A window's *anchor* is its 50-gram with the least hash (the leftmost of equal ones). Equal windows have equal anchors at the same
   place, so windows meet by anchor. Neighbouring windows with one anchor are a *piece*. The groups of texts count anchors (pre-aggregated,
   packed) and learn which occur twice or more; pieces with a single anchor leave the work here.
3. The other pieces go, with their bytes, to the range of their anchor's hash. Pieces that are equal inside a group are sent once, so a passage
   of a third of all documents costs one piece for each group.
4. There the windows are sorted as suffixes by mergesort: prefix polynomial hashes and binary search give the common extension of two
   suffixes in a logarithmic number of steps, and the byte after it their order. Equal neighbours are verified byte by byte. The sort is stable
   in (doc_id, start), so the first of equal windows is the one that stays.
5. The others go back to their text as intervals, which are merged and cut out.

Edge cases: a null text is empty; texts under 100 bytes stay; a missing doc_id counts as larger than all others, and such rows as separate
documents only if their texts differ (equal texts: the copy with the smallest doc_id stays, rows that repeat it stay like it); rows with the same
doc_id and different texts are ordered by start; an empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.hashing import U, chunks, mix, prefix_hash, range_hash, texts
from tillroll.llm.ngram_join import HASH_MASK, PARTS_DDL, answers, bucketed, groups_for, merged, text_key

LENGTH, GRAM = 100, 50
GRAMS = LENGTH - GRAM + 1
#: Positions are packed beside the hash that orders grams; longer texts are cut into parts that overlap by a window.
PLACE_BITS = 24
MOST = 1 << 23
LAST = np.iinfo(np.int64).max


def first_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text of a task once; if a later copy has a smaller doc_id, a row without text says so at the end."""
    least: dict[tuple[int, int, int], list[int]] = {}
    schema = None
    for batch in batches:
        schema = batch.schema
        new = []
        for s, h1, h2, doc in zip(*(batch.column(c).to_pylist() for c in ("s", "h1", "h2", "doc")), strict=True):
            known = least.get((s, h1, h2))
            new.append(known is None)
            if known is None:
                least[s, h1, h2] = [doc, doc]
            else:
                known[1] = min(known[1], doc)
        yield batch.filter(pa.array(new, pa.bool_()))
    late = [(*k, low, None) for k, (first, low) in least.items() if low < first]
    if late:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*late, strict=True), schema, strict=True)], schema=schema)


def classes_of(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """One row with text for each class, in the order of its key, and the smallest doc of each."""
    keys = np.rec.fromarrays([table.column("h1").to_numpy(), table.column("h2").to_numpy()])
    _, inverse = np.unique(keys, return_inverse=True)
    least = np.full(int(inverse.max()) + 1, LAST)
    np.minimum.at(least, inverse, table.column("doc").to_numpy())
    filled = np.flatnonzero(~table.column("text").is_null().to_numpy())
    _, first = np.unique(inverse[filled], return_index=True)
    return table.take(pa.array(filled[first])), least


def windows_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each window, from running minima inside blocks, forwards and backwards."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, U)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return np.minimum(back[:m], ahead[width - 1 : width - 1 + m])


def pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, start in data, windows, anchor's place after the start, anchor's hash) of the pieces of some texts."""
    for base in range(0, len(data), MOST):
        part = data[base : base + MOST + LENGTH - 1] if len(data) > MOST else data
        if len(part) >= LENGTH:
            at = np.arange(len(part) - GRAM + 1)
            grams = mix(range_hash(prefix_hash(part), at, at + GRAM))
            order = (grams >> U(PLACE_BITS)) << U(PLACE_BITS) | at.astype(U)
            anchor = (windows_min(order, GRAMS) & U((1 << PLACE_BITS) - 1)).astype(np.int64)
            text = np.searchsorted(offsets, base + np.arange(len(anchor)), "right") - 1
            inside = base + np.arange(len(anchor)) + LENGTH <= offsets[text + 1]
            new = np.ones(len(anchor), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | ~inside[:-1]
            start = np.flatnonzero(new & inside)
            stops = np.flatnonzero(new | ~inside)
            end = np.append(stops, len(anchor))[np.searchsorted(stops, start, "right")]
            yield text[start], base + start, end - start, anchor[start] - start, grams[anchor[start]] & HASH_MASK
        if len(data) <= MOST:
            return


def each_chunk(table: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for batch in table.combine_chunks().to_batches():
        for head, _, data, offsets in chunks(*texts(batch.column("text"))):
            yield head, data, offsets


def anchor_counts(grouped: DataFrame, buckets: int) -> DataFrame:
    def count(table: pa.Table) -> pa.Table:
        s = table.column("s")[0].as_py()
        found = [np.zeros(0, U)]
        for _, data, offsets in each_chunk(classes_of(table)[0]):
            found += [p[4] for p in pieces(data, offsets)]
        return bucketed(s, *np.unique(np.concatenate(found), return_counts=True), buckets)

    return grouped.groupBy("s").applyInArrow(count, PARTS_DDL)


#: bucket -1: not a piece but an interval of the text ``owner`` of group s that is known to be repeated.
PIECES_DDL = "bucket int, s int, owner int, doc long, start long, windows int, place int, token long, bytes binary"
PIECES = pa.schema([("bucket", pa.int32()), ("s", pa.int32()), ("owner", pa.int32()), ("doc", pa.int64()), ("start", pa.int64()),
                    ("windows", pa.int32()), ("place", pa.int32()), ("token", pa.int64()), ("bytes", pa.binary())])


def shared_pieces(grouped: DataFrame, shared: DataFrame, buckets: int) -> DataFrame:
    bounds = np.array([(b << 52) // buckets for b in range(1, buckets)], U)

    def send(table: pa.Table, answer: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if table.num_rows and answer.num_rows:
            s, keys = table.column("s")[0].as_py(), merged(answer)[0]
            table, least = classes_of(table)
            best: dict[bytes, tuple] = {}
            for head, data, offsets in each_chunk(table):
                raw = data.tobytes()
                for text, start, windows, place, token in pieces(data, offsets):
                    at = np.minimum(np.searchsorted(keys, token), len(keys) - 1)
                    hit = np.flatnonzero(keys[at] == token)
                    bucket = np.searchsorted(bounds, token[hit], "right")
                    found = (bucket, text[hit], start[hit], windows[hit], place[hit], token[hit].view(np.int64), offsets[text[hit]])
                    for b, t, a, n, p, k, o in zip(*(x.tolist() for x in found), strict=True):
                        owner, body = head + t, raw[a : a + n + LENGTH - 1]
                        row = (b, s, owner, int(least[owner]), a - o, n, p, k, body)
                        other = best.get(body)
                        if other is None:
                            best[body] = row
                            continue
                        if (row[3], row[4]) < (other[3], other[4]):
                            best[body], row = row, other
                        rows.append((-1, s, row[2], None, row[4], row[5], None, None, None))
            rows += best.values()
        columns = list(zip(*rows, strict=True)) or [()] * len(PIECES)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, PIECES, strict=True)], schema=PIECES)

    return grouped.groupBy("s").cogroup(shared.groupBy("s")).applyInArrow(send, PIECES_DDL)


class Suffixes:
    """Windows of a byte string, compared by prefix hashes."""

    def __init__(self, data: np.ndarray):
        self.data, self.prefix = data, prefix_hash(data)
        self.words = np.ndarray((max(len(data) - 7, 0),), "<u8", data, strides=(1,))

    def same(self, x: np.ndarray, y: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        return range_hash(self.prefix, x, x + n) == range_hash(self.prefix, y, y + n)

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many bytes the windows at x and y have in common, up to LENGTH: by binary search."""
        out = np.full(len(x), LENGTH)
        differ = np.flatnonzero(~self.same(x, y, LENGTH))
        x, y = x[differ], y[differ]
        low, high = np.zeros(len(x), np.int64), np.full(len(x), LENGTH - 1)
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self.same(x, y, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        out[differ] = low
        return out

    def less(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the window at x comes before the one at y, and whether they are equal."""
        common = self.extension(x, y)
        equal = common == LENGTH
        at = np.minimum(common, LENGTH - 1)
        return ~equal & (self.data[x + at] < self.data[y + at]), equal

    def verified(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Equal in all bytes."""
        ok = np.ones(len(x), bool)
        for at in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
            ok &= self.words[x + at] == self.words[y + at]
        return ok

    def merge_sorted(self, windows: np.ndarray, group: np.ndarray) -> np.ndarray:
        """``windows``, ordered by group, sorted by content inside each group; equal ones keep their order. Returns the order.

        Bottom-up mergesort of all groups at once: every window finds its rank in the neighbouring run by binary search.
        """
        n = len(windows)
        order = np.arange(n)
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.zeros(0, np.int64)
        size = np.diff(np.append(first, n))
        begin, length = np.repeat(first, size), np.repeat(size, size)
        width = 1
        while n and width < size.max():
            active = np.flatnonzero(length > width)
            base, inside = begin[active], active - begin[active]
            run = inside // width
            left = run % 2 == 0
            other = np.where(left, run + 1, run - 1) * width
            low = base + np.minimum(other, length[active])
            high = base + np.minimum(other + width, length[active])
            start_other = low.copy()
            mine = windows[order[active]]
            while (open_ := low < high).any():
                k = np.flatnonzero(open_)
                middle = (low[k] + high[k]) // 2
                theirs = windows[order[middle]]
                before, equal = self.less(theirs, mine[k])
                before |= equal & ~left[k]
                low[k] = np.where(before, middle + 1, low[k])
                high[k] = np.where(before, high[k], middle)
            target = base + (run // 2) * 2 * width + inside % width + (low - start_other)
            moved = order.copy()
            moved[target] = order[active]
            order = moved
            width *= 2
        return order


INTERVALS_DDL = "s int, owner int, start long, end long"
INTERVALS = pa.schema([("s", pa.int32()), ("owner", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])


def repeated_windows(table: pa.Table) -> pa.Table:
    """Intervals of the windows of a bucket that are not the first of their kind."""
    number = {c: table.column(c).to_numpy() for c in ("s", "owner", "doc", "start", "windows", "place", "token")}
    data, offsets = texts(table.column("bytes").combine_chunks())
    piece = np.repeat(np.arange(table.num_rows), number["windows"])
    ordinal = np.arange(len(piece)) - np.repeat(np.cumsum(number["windows"]) - number["windows"], number["windows"])
    # Equal windows have the same anchor at the same distance.
    where = mix(number["token"].view(U)[piece] * U(64) + (number["place"][piece] - ordinal).astype(U))
    start = number["start"][piece] + ordinal
    order = np.lexsort((start, number["doc"][piece], where))
    piece, ordinal, start, where = piece[order], ordinal[order], start[order], where[order]
    windows = offsets[piece] + ordinal
    suffixes = Suffixes(np.ascontiguousarray(data))
    sorted_ = suffixes.merge_sorted(windows, where)
    x, y = windows[sorted_[:-1]], windows[sorted_[1:]]
    near = np.flatnonzero((where[sorted_[1:]] == where[sorted_[:-1]]) & suffixes.same(x, y, LENGTH))
    near = near[suffixes.verified(x[near], y[near])]
    again = sorted_[near + 1]
    p, t = piece[again], ordinal[again]
    by = np.lexsort((t, p))
    p, t = p[by], t[by]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (t[1:] != t[:-1] + 1)
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(p)) - 1
    at = number["start"][p[head]] if len(head) else np.zeros(0, np.int64)
    return pa.table([pa.array(number["s"][p[head]], pa.int32()), pa.array(number["owner"][p[head]], pa.int32()),
                     pa.array(at + t[head]), pa.array(at + t[last] + LENGTH)], schema=INTERVALS)


KEPT_DDL = "h1 long, h2 long, least long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"


def cut_out(grouped: DataFrame, intervals: DataFrame, keep_bytes: bool) -> DataFrame:
    def cut(table: pa.Table, found: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if table.num_rows:
            table, least = classes_of(table)
            owner, start, end = (found.column(c).to_numpy() for c in ("owner", "start", "end"))
            order = np.lexsort((start, owner))
            owner, start, end = owner[order], start[order], end[order]
            place = np.searchsorted(owner, np.arange(table.num_rows + 1))
            keys = (table.column("h1").to_pylist(), table.column("h2").to_pylist())
            for head, data, offsets in each_chunk(table):
                raw = data.tobytes()
                for t in range(len(offsets) - 1):
                    i = head + t
                    text = raw[offsets[t] : offsets[t + 1]]
                    kept, last, removed, spans, until = [], 0, 0, 0, -1
                    for a, b in zip(start[place[i] : place[i + 1]].tolist(), end[place[i] : place[i + 1]].tolist(), strict=True):
                        if a > until:
                            spans += 1
                            kept.append(text[last:a])
                        if b > until:
                            removed += b - max(a, until if until >= 0 else a)
                            until = last = b
                    kept.append(text[last:])
                    rest = b"".join(kept)
                    rows.append((keys[0][i], keys[1][i], int(least[i]), len(text), removed, spans, rest if keep_bytes else None,
                                 hashlib.sha256(rest).hexdigest()))
        kinds = [pa.int64()] * 6 + [pa.binary(), pa.string()]
        names = ["h1", "h2", "least", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]
        columns = list(zip(*rows, strict=True)) or [()] * 8
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return grouped.groupBy("s").cogroup(intervals.groupBy("s")).applyInArrow(cut, KEPT_DDL)


def without_repeats(docs: DataFrame, keep_bytes: bool = True) -> DataFrame:
    """For every row doc_id, n_bytes, n_removed, n_spans, ``kept`` (the bytes that stay, null unless wanted) and their digest."""
    groups = groups_for(docs)
    filled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = filled.select(
        F.pmod(F.xxhash64("text", F.lit(3)), F.lit(groups)).cast("int").alias("s"), *text_key(F.col("text")),
        F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "text",
    )
    grouped = keyed.mapInArrow(first_copies, keyed.schema.simpleString().removeprefix("struct<").removesuffix(">")).repartition(groups, "s")
    shared = answers(anchor_counts(grouped, groups), groups)
    sent = shared_pieces(grouped, shared, groups)
    # Intervals found inside a group are dealt with the pieces, by their own group, and pass through.
    dealt = sent.withColumn("_to", F.when(F.col("bucket") < 0, F.col("s") + groups).otherwise(F.col("bucket"))).repartition(groups, "_to")

    def sort(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() >= groups:
            start = table.column("start")
            end = pa.array(start.to_numpy() + table.column("windows").to_numpy() + LENGTH - 1)
            return pa.table([table.column("s"), table.column("owner"), start, end], schema=INTERVALS)
        return repeated_windows(table)

    intervals = dealt.groupBy("_to").applyInArrow(sort, INTERVALS_DDL).repartition(groups, "s")
    kept = cut_out(grouped, intervals, keep_bytes)
    whole = (F.coalesce("doc_id", F.lit(LAST)) > F.col("least")) & (F.col("n_bytes") >= LENGTH)
    rows = filled.select("doc_id", *text_key(F.col("text"))).join(kept, ["h1", "h2"])
    return rows.select(
        "doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(whole & F.col("kept").isNotNull(), F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
        F.when(whole, F.sha2(F.lit(b""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What stays of every document when repeated strings of 100 bytes are gone."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return without_repeats(docs, keep_bytes=False).drop("kept")
