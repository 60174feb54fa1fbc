"""Benchmark decontamination by latent semantic retrieval.

Terms are words between white space and ASCII punctuation, A-Z as a-z. Only terms of the benchmark can bring a passage nearer to an
item, so the term space is the benchmark's vocabulary, which bounds every model here by the benchmark's size, not the corpus's.

1. One scan counts in how many passages (64 words) each term stands, over all documents, and writes the terms of every passage, packed.
2. A randomised SVD (subspace iteration, its products summed by Spark) of the TF-IDF rows of all passages and of the items gives the
   latent space. Passages without a term of the benchmark are empty rows, which no product has. What frequent terms have with all terms
   is the same in every product and added up once; only the rest is multiplied each time.
3. A second scan looks for the rarest words of the items. A leak lacks at most three tenths of an item's words, so it has one of the
   rarest of them, one more than it may lack. Windows (80 words, a new one every 32) that hold none for any item can't be leaks. The
   others are projected and compared with the items that brought them up; those within ``COSINE`` are candidates.
4. A candidate is a leak if the longest common subsequence of its words and the item's has ``OVERLAP`` of the item's words, and
   for an item with an answer, if ``ANSWER`` of the words of that are there as well.

All terms of the items count, however often they occur; their inverse frequency alone weighs them. Long items are searched by parts of
64 words. A benchmark is searched in slices of ``SLICE_BYTES`` and models of ``MODEL_TERMS``, two scans for each, which bounds what the
driver holds and what is broadcast. The answer check runs where the benchmark has a column ``answer``.

Edge cases: a null or empty text has no passages; a null or empty item matches nothing; rows with one key are reported together;
an empty table on either side gives an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import batched
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.hashing import MARKS, U, chunks, texts, word_hashes
from tillroll.operators.lineage import written

PASSAGE, BLOCK, WINDOW_BLOCKS, STEP_BLOCKS = 64, 16, 5, 2
RANK, EXTRA, ROUNDS = 256, 16, 2
COSINE, OVERLAP, ANSWER = 0.5, 0.7, 0.6
SLICE_BYTES = 8 << 20
#: Terms of one model: its broadcast has ``RANK`` floats for each, 64 MB.
MODEL_TERMS = 1 << 16
#: Windows and parts of items that are compared at once.
PAIRS = 1 << 12
#: Passages that are packed into one row for the fit.
FIT_BLOCK = 256
#: Rows of few terms that are multiplied at once, as a matrix over the terms they have.
DENSE_ROWS = 64
#: Rows whose vectors are added up at once.
SUM_ROWS = 512
#: Cells of the columns of M' M that are added up once; ``RANK`` columns at least.
HEAD_CELLS = 1 << 21
#: Packed rows whose pairs of terms are sorted together, and pairs that are added up at once.
COLUMN_BLOCKS, COLUMN_PAIRS = 16, 1 << 16
#: Cells of a matrix that are sent and added up as one row.
PART_CELLS = 1 << 16
#: Packed rows whose products are added up in single precision.
SINGLE_BLOCKS = 64


@dataclass
class Item:
    """A part of an item: its words and those of its answer."""

    item_id: int
    words: list[int]
    answer: list[int]


def hashed_words(text: str | None) -> np.ndarray:
    return word_hashes(*texts(pa.array([text or ""])), MARKS)[0]


def parts_of(rows: list) -> list[Item]:
    out = []
    for row in rows:
        found = hashed_words(row["text"])
        answer = hashed_words(row["answer"]).tolist()
        for a in range(0, max(len(found) - PASSAGE // 2, 1), PASSAGE // 2):
            if len(part := found[a : a + PASSAGE]):
                out.append(Item(row["item_id"], part.tolist(), answer))
    return out


def models(parts: list[Item], most: int = MODEL_TERMS) -> Iterator[list[Item]]:
    """The parts in runs of at most ``most`` terms (one part has far fewer)."""
    run: list[Item] = []
    terms: set[int] = set()
    for x in parts:
        own = {*x.words, *x.answer}
        if run and len(terms | own) > most:
            yield run
            run, terms = [], set()
        run.append(x)
        terms |= own
    if run:
        yield run


class Lookup:
    """Finds words in a sorted vocabulary: the leading bits of a hash tell where to look, and a few steps reach its place."""

    def __init__(self, vocabulary: np.ndarray):
        bits = len(vocabulary).bit_length() + 3  # eight slots for a term at least
        self.shift = U(64 - bits)
        ends = np.cumsum(np.bincount((vocabulary >> self.shift).astype(np.int64), minlength=1 << bits))
        self.first = np.concatenate([[0], ends[:-1]]).astype(np.int32)
        self.steps = int(np.diff(ends, prepend=0).max()) - 1
        self.terms = np.append(vocabulary, np.repeat(vocabulary[-1:], self.steps + 1))  # steps may lead beyond the last term

    def known(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that are in the vocabulary, and their numbers there."""
        at = self.first[hashes >> self.shift]
        for _ in range(self.steps):
            at += self.terms[at] < hashes
        place = np.flatnonzero(self.terms[at] == hashes)
        return place, at[place].astype(np.int64)


def dense(owner: np.ndarray, term: np.ndarray, weight: np.ndarray | None, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct terms of some rows, and the rows as a matrix over these; a term that a row has again adds to its cell."""
    terms, column = np.unique(term, return_inverse=True)
    cells = np.bincount(owner * len(terms) + column, weight, rows * len(terms))
    return terms, cells.reshape(rows, len(terms)).astype(np.float32)


def row_sums(vectors: np.ndarray, term: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The sum of the vectors of each row's terms (``size`` of them from ``first`` on, one at least), and a last row of zeros.

    The vectors of the k-th terms are added for many rows at once, so longer rows come first.
    """
    out = np.zeros((len(size) + 1, vectors.shape[1]), np.float32)
    for a in range(0, len(size), SUM_ROWS):
        order = a + np.argsort(-size[a : a + SUM_ROWS], kind="stable")
        at = first[order]
        longer = len(order) - np.cumsum(np.bincount(size[order]))
        part = vectors[term[at]]
        for k, n in enumerate(longer[1:-1].tolist(), 1):
            part[:n] += vectors[term[at[:n] + k]]
        out[order] = part
    return out


COUNTS_DDL = "term int, n long, terms binary, sizes binary"
COUNTS = pa.schema([("term", pa.int32()), ("n", pa.int64()), ("terms", pa.binary()), ("sizes", pa.binary())])


def term_type(size: int) -> type:
    """Two bytes hold a term, unless one part's answer alone brings more than ``MODEL_TERMS``."""
    return np.uint16 if size <= MODEL_TERMS else np.uint32


def packed(terms: np.ndarray, sizes: np.ndarray, size: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(passages, their terms one after the other, their numbers of terms) of ``FIT_BLOCK`` passages each, which have 64 terms at most;
    ``size`` is that of the vocabulary."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    for a in range(0, len(sizes), FIT_BLOCK):
        own = sizes[a : a + FIT_BLOCK]
        yield len(own), terms[ends[a] : ends[a + len(own)]].astype(term_type(size)).tobytes(), own.astype(np.uint8).tobytes()


def passage_counts(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """Rows of a term and its passages, of the number of passages (term -1), and of the terms of all passages that have one (term -2)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(shared.value)
        size = len(shared.value)
        total, passages = np.zeros(size, np.int64), 0
        for batch in batches:
            for _, _, data, offsets in chunks(*texts(batch.column("text"))):
                hashes, place = word_hashes(data, offsets, MARKS)
                lengths = np.diff(place)
                each = -(-lengths // PASSAGE)
                first = np.concatenate([[0], np.cumsum(each)])
                passages += int(first[-1])
                at, term = lookup.known(hashes)
                doc = np.searchsorted(place, at, "right") - 1
                passage = first[doc] + (at - place[doc]) // PASSAGE
                pairs = np.sort(passage * size + term)  # nearly in order already
                pairs = pairs[np.diff(pairs, prepend=-1) != 0]
                owner, term = np.divmod(pairs, size)
                total += np.bincount(term, minlength=size)
                starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else owner
                if len(starts):
                    yield batch_of([(-2, *block) for block in packed(term, np.diff(np.append(starts, len(pairs))), size)])
        some = np.flatnonzero(total)
        yield batch_of([(int(t), int(total[t]), None, None) for t in some] + [(-1, passages, None, None)])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), COUNTS, strict=True)], schema=COUNTS)

    return docs.select("text").mapInArrow(count, COUNTS_DDL)


def unpacked(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Of each packed row the terms, the passage of each, their TF-IDF, and the number of passages."""
    for batch in batches:
        for terms, sizes, scale in zip(*(batch.column(c).to_pylist() for c in ("terms", "sizes", "scale")), strict=True):
            term, size = np.frombuffer(terms, term_type(len(weights))), np.frombuffer(sizes, np.uint8).astype(np.int64)
            owner, w = np.repeat(np.arange(len(size)), size), weights[term]
            norm = np.sqrt(np.add.reduceat(w * w, np.cumsum(size) - size))
            yield term.astype(np.int64), owner, w / np.where(norm > 0, norm, 1.0)[owner] * scale, len(size)


def summed(rows: DataFrame, share: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None], shape: tuple[int, int]) -> np.ndarray:
    """The sum of the tasks' matrices, each sent in single precision: Spark adds them up by some rows each, and the driver gets one matrix."""
    block = max(1, PART_CELLS // shape[1])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = share(batches)
        if out is not None:
            starts = range(0, len(out), block)
            yield pa.record_batch([pa.array([i // block for i in starts], pa.int32()),
                                   pa.array([out[i : i + block].astype(np.float32).tobytes() for i in starts], pa.binary())], ["block", "part"])

    def add(table: pa.Table) -> pa.Table:
        total = 0.0
        for x in table.column("part"):
            total = total + np.frombuffer(x.as_py(), np.float32).astype(np.float64)
        return pa.table({"block": table.column("block")[:1], "part": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    schema = "block int, part binary"
    out = np.zeros(shape)
    for r in rows.mapInArrow(parts, schema).groupBy("block").applyInArrow(add, schema).collect():
        found = np.frombuffer(r["part"], np.float32).reshape(-1, shape[1])
        out[r["block"] * block : r["block"] * block + len(found)] = found
    return out


def product(rows: DataFrame, weights: np.ndarray, against: np.ndarray, left_out: np.ndarray | None = None) -> np.ndarray:
    """M' M X for the TF-IDF rows M, packed, or for these without the columns ``left_out``.

    ``DENSE_ROWS`` passages are multiplied at once; single precision holds the sums of ``SINGLE_BLOCKS`` packed rows, double those of all.
    """
    stays = np.ones(len(weights), bool)
    stays[[] if left_out is None else left_out] = False
    shared = rows.sparkSession.sparkContext.broadcast((weights, against.astype(np.float32), stays))

    def share(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        weights, x, stays = shared.value
        out, part, blocks = np.zeros(x.shape), np.zeros(x.shape, np.float32), 0
        for term, owner, w, _ in unpacked(batches, weights):
            own = np.flatnonzero(stays[term])
            term, w, owner = term[own], w[own], owner[own]
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            owner = np.cumsum(np.diff(owner, prepend=-1) > 0) - 1  # passages that are left
            ends = np.append(starts, len(owner))
            for a in range(0, len(starts), DENSE_ROWS):
                n = min(DENSE_ROWS, len(starts) - a)
                own = slice(ends[a], ends[a + n])
                t, m = dense(owner[own] - a, term[own], w[own], n)
                part[t] += m.T @ (m @ x[t])
            blocks += 1
            if blocks % SINGLE_BLOCKS == 0:
                out += part
                part[:] = 0
        return out + part if blocks else None

    return summed(rows, share, against.shape)


def columns(rows: DataFrame, weights: np.ndarray, head: np.ndarray) -> np.ndarray:
    """The columns ``head`` of M' M for the TF-IDF rows M, packed: each term of a passage meets each of the head's terms in it.

    A term's pairs in ``COLUMN_BLOCKS`` packed rows follow each other, so that the sums are written row by row and not all over the matrix.
    """
    number = np.full(len(weights), -1)
    number[head] = np.arange(len(head))
    shared = rows.sparkSession.sparkContext.broadcast((weights, number))
    size = len(head)

    def share(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        weights, number = shared.value
        out, some = np.zeros(len(weights) * size), False
        for group in batched(unpacked(batches, weights), COLUMN_BLOCKS):
            some = True
            before = np.cumsum([0] + [passages for *_, passages in group])
            term, w = (np.concatenate([x[k] for x in group]) for k in (0, 2))
            owner = np.concatenate([x[1] + n for x, n in zip(group, before, strict=False)])
            column = number[term]
            common = np.flatnonzero(column >= 0)
            column, v = column[common], w[common]
            each = np.bincount(owner[common], minlength=int(before[-1]))
            order = np.argsort(term.astype(term_type(len(weights))), kind="stable")
            term, owner, w = term[order], owner[order], w[order]
            times = each[owner]
            ends = np.cumsum(times)
            first = (np.cumsum(each) - each)[owner] - (ends - times)
            a = 0
            while a < len(term):
                low = int(ends[a] - times[a])
                b = max(a + 1, int(np.searchsorted(ends, low + COLUMN_PAIRS, "right")))
                n = times[a:b]
                other = np.arange(low, int(ends[b - 1])) + np.repeat(first[a:b], n)
                np.add.at(out, np.repeat(term[a:b] * size, n) + column[other], np.repeat(w[a:b], n) * v[other])
                a = b
        return out.reshape(-1, size) if some else None

    return summed(rows, share, (len(weights), size))


def latent_basis(rows: DataFrame, weights: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Leading right singular vectors of the TF-IDF rows, one column each.

    M' M is taken apart by its columns: those of the most frequent terms are added up once and serve all products; what the other terms
    have with each other is multiplied anew for each.
    """
    head = np.argsort(weights, kind="stable")[: max(rank, HEAD_CELLS // len(weights))]
    tail = np.setdiff1d(np.arange(len(weights)), head)
    common = columns(rows, weights, head)

    def times(x: np.ndarray) -> np.ndarray:
        out = common @ x[head]
        if len(tail):
            out[head] += common[tail].T @ x[tail]
            out += product(rows, weights, x, head)
        return out

    width = min(rank + EXTRA, len(weights))
    basis = np.linalg.qr(np.random.default_rng(5).standard_normal((len(weights), width)))[0]
    for _ in range(ROUNDS):
        basis = np.linalg.qr(times(basis))[0]
    small = basis.T @ times(basis)
    value, vector = np.linalg.eigh((small + small.T) / 2)
    return basis @ vector[:, np.argsort(-value)[:rank]]


def common_subsequence(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence, one bit for each word of the item."""
    full = (1 << size) - 1
    state = full
    for w in words:
        if m := masks.get(w):
            hit = state & m
            state = ((state + hit) | (state - hit)) & full
    return size - state.bit_count()


def least_common(size: int) -> int:
    """Words of an item of ``size`` words that a leak has in order."""
    return ceil(OVERLAP * size)


@dataclass
class Model:
    lookup: Lookup  # of the terms
    latent: np.ndarray  # a row for each term: weight times its latent vector
    queries: np.ndarray  # a unit row for each part of an item
    items: list[Item]
    first: np.ndarray  # for each term the place of its first part in ``part``, one more for the end
    part: np.ndarray  # parts that have the term among their rarest words

    def raised(self, block: np.ndarray, first: np.ndarray, doc: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows and parts of items such that one of the part's rarest words stands where the two would be compared.

        A leak misses at most ``size - least_common(size)`` of a part's words, so of one more than that, the rarest, it has one.
        """
        each = self.first[term + 1] - self.first[term]
        some = np.flatnonzero(each)
        each = each[some]
        before = np.cumsum(each) - each
        part = self.part[np.repeat(self.first[term[some]] - before, each) + np.arange(int(each.sum()))]
        # The words compared with a window reach one block beyond it on both sides.
        reach = np.arange(-WINDOW_BLOCKS, 2)
        window = np.repeat(block[some], each)[:, None] + reach
        fits = (window >= 0) & (window % STEP_BLOCKS == 0)
        row, column = np.nonzero(fits)
        every = np.repeat(first[doc[some]], each)[row] + window[row, column]
        inside = every < np.repeat(first[doc[some] + 1], each)[row]
        pairs = np.unique(every[inside] * len(self.items) + part[row][inside])
        return pairs // len(self.items), pairs % len(self.items)

    def candidates(self, hashes: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(text, first word, part of an item, cosine) of the windows that are near a part whose rare words they hold."""
        at, term = self.lookup.known(hashes)
        if not len(at):
            return
        doc = np.searchsorted(place, at, "right") - 1
        block = (at - place[doc]) // BLOCK
        first = np.concatenate([[0], np.cumsum(-(-np.diff(place) // BLOCK) + WINDOW_BLOCKS)])
        window, part = self.raised(block, first, doc, term)
        if not len(window):
            return
        needed = np.unique((np.unique(window)[:, None] + np.arange(WINDOW_BLOCKS)).ravel())
        every = first[doc] + block  # blocks of different texts are further apart than a window is long
        near = needed[np.minimum(np.searchsorted(needed, every), len(needed) - 1)] == every
        every, term = every[near], term[near]
        starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
        blocks, ends = every[starts], np.append(starts[1:], len(term))
        for a in range(0, len(window), PAIRS):
            rows, parts = window[a : a + PAIRS], part[a : a + PAIRS]
            distinct, row = np.unique(rows, return_inverse=True)
            low, high = np.searchsorted(blocks, [distinct[0], distinct[-1] + WINDOW_BLOCKS])
            sums = row_sums(self.latent, term, starts[low:high], ends[low:high] - starts[low:high])
            own = np.append(blocks[low:high], -1)
            total = np.zeros((len(distinct), sums.shape[1]), np.float32)
            for k in range(WINDOW_BLOCKS):
                i = np.searchsorted(own[:-1], distinct + k)
                total += sums[np.where(own[i] == distinct + k, i, len(own) - 1)]
            total /= np.maximum(np.sqrt(np.einsum("ij,ij->i", total, total)), 1e-9)[:, None]
            cosine = np.einsum("ij,ij->i", total[row], self.queries[parts])
            close = cosine >= COSINE
            text = np.searchsorted(first, rows[close], "right") - 1
            yield text, place[text] + (rows[close] - first[text]) * BLOCK, parts[close], cosine[close]


LEAKS_DDL = "key long, item_id long, overlap double, cosine double, lcs long, item_words long"


def search(docs: DataFrame, model: Model) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        masks = []
        for item in model.items:
            bits: dict[int, int] = {}
            for i, w in enumerate(item.words):
                bits[w] = bits.get(w, 0) | (1 << i)
            masks.append(bits)
        for batch in batches:
            keys = batch.column("key")
            rows: dict[tuple[int, int], tuple] = {}
            for head, _, data, offsets in chunks(*texts(batch.column("text"))):
                hashes, place = word_hashes(data, offsets, MARKS)
                for text, start, part, cosine in model.candidates(hashes, place):
                    for d, a, i, c in zip(text.tolist(), start.tolist(), part.tolist(), cosine.tolist(), strict=True):
                        item = model.items[i]
                        a0 = max(a - BLOCK, int(place[d]))
                        region = hashes[a0 : min(a + (WINDOW_BLOCKS + 1) * BLOCK, int(place[d + 1]))].tolist()
                        size = len(item.words)
                        lcs = common_subsequence(masks[i], size, region)
                        if lcs >= least_common(size):
                            there = set(region)
                            if sum(w in there for w in item.answer) >= ANSWER * len(item.answer):
                                found = (lcs / size, c, lcs, size)
                                at = (head + d, item.item_id)
                                rows[at] = max(rows.get(at, found), found)
            found = [(keys[d].as_py(), item, *v) for (d, item), v in rows.items()]
            names = ["key", "item_id", "overlap", "cosine", "lcs", "item_words"]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
            columns = list(zip(*found, strict=True)) or [()] * 6
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    best = docs.select("key", "text").mapInArrow(find, LEAKS_DDL).groupBy("key", "item_id").agg(
        F.max(F.struct("overlap", "cosine", "lcs", "item_words")).alias("best"))
    return best.select("key", "item_id", "best.*")


def fitted(docs: DataFrame, items: list[Item]) -> Model | None:
    spark = docs.sparkSession
    vocabulary = np.unique(np.array([w for x in items for w in x.words + x.answer], U))
    counts = written(passage_counts(docs, vocabulary))
    totals = {r["term"]: r["n"] for r in counts.select("term", "n").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n, filled = totals.pop(-1, 0) or 0, totals.pop(-2, 0) or 0
    if not n:
        return None
    df = np.zeros(len(vocabulary))
    df[list(totals)] = list(totals.values())
    number = {int(h): i for i, h in enumerate(vocabulary)}
    weights = np.log((n + 1) / (df + 1))
    passages = counts.filter("term = -2").select("terms", "sizes", F.lit(1.0).alias("scale"))
    # all items weigh as much as all passages
    scale = float(np.sqrt(max(1.0, filled / max(1, len(items)))))
    blocks = packed(np.array([number[w] for x in items for w in x.words]), np.array([len(x.words) for x in items]), len(vocabulary))
    own = spark.createDataFrame([(bytearray(t), bytearray(s), scale) for _, t, s in blocks], "terms binary, sizes binary, scale double")
    basis = latent_basis(passages.unionByName(own), weights)
    latent = (weights[:, None] * basis).astype(np.float32)
    queries = np.stack([latent[[number[w] for w in x.words]].sum(axis=0) for x in items])
    queries /= np.maximum(np.sqrt((queries * queries).sum(axis=1)), 1e-9)[:, None]
    # The rarest words of each part, by the passages that have them.
    rare = set()
    for i, x in enumerate(items):
        terms = sorted((number[w] for w in x.words), key=lambda t: (df[t], t))
        rare |= {(t, i) for t in terms[: len(terms) - least_common(len(terms)) + 1]}
    term, part = (np.array(c, np.int64) for c in zip(*sorted(rare), strict=True))
    first = np.searchsorted(term, np.arange(len(vocabulary) + 1))
    return Model(Lookup(vocabulary), np.ascontiguousarray(latent), np.ascontiguousarray(queries), items, first, part)


def leaks(docs: DataFrame, benchmark: DataFrame, key: Column | str = "doc_id") -> DataFrame:
    """(key, item_id, overlap, cosine, lcs, item_words): the items that a document holds, with their best passage."""
    docs = docs.select((F.col(key) if isinstance(key, str) else key).cast("long").alias("key"), "text")
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text", answer.alias("answer"))
    size = items.agg(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("answer"), F.lit(0)))).first()[0] or 0
    slices = -(-size // SLICE_BYTES) or 1
    found = []
    for k in range(slices):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k)
        for parts in models(parts_of(own.collect())):  # about SLICE_BYTES
            if model := fitted(docs, parts):
                found.append(search(docs, model))
    if not found:
        return docs.sparkSession.createDataFrame([], LEAKS_DDL)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, and the item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select(F.col("key").alias("doc_id"), "item_id", "overlap", "cosine", "lcs", "item_words")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The stage of the pipeline: documents that hold no item. What a text holds depends on the text alone, so its hash is the key."""
    key, name = F.xxhash64("text"), "_leak_key"
    while name in docs.columns:
        name += "_"
    bad = leaks(docs, benchmark, key).select(F.col("key").alias(name)).distinct()
    return docs.join(bad, key == bad[name], "left_anti")
