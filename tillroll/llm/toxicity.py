"""Toxicity by compression distance: how much better does a text compress with what toxic texts say than with what ordinary ones say?

Training (on the driver, from a bounded sample of labelled rows: at most ``SAMPLE`` of each class, the lowest hashes, texts of up to
``SAMPLE_CHARS``):

1. Stems (starts of words) that stand in more contexts of toxic texts than chance allows make the toxic dictionary; contexts are counted once,
   so copies and shared passages don't weigh. The ordinary dictionary has other words of ordinary texts in their place. Both start from the same
   common words, so that ordinary language compresses alike with either.
2. Windows of about ``WINDOW`` bytes are compressed with both (zstandard, raw literals, so a match of a whole stem shows). A threshold of the
   difference of the lengths is set where it parts the windows of both classes best. Mean difference, best window, and the windows from
   the threshold on (share and number) are calibrated by a logistic regression.

Dictionaries trained on the texts themselves were tried first: their common language drowns what sets the classes apart (see README).

Scoring is one scan over whole texts; each text's score depends on its text alone. Nothing is shuffled but the sampled labels.

Edge cases: a null or empty text has no windows and gets the score of differences of zero; rows without doc_id are held out (their
id counts as an empty text); repeated rows are scored alike; without labels of both classes all scores are 0; an empty table gives an
empty table; other columns are left out.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE, SAMPLE_CHARS = 2000, 20_000
WINDOW, LONGEST = 80, 120
MIN_STEM, MIN_TEXTS, MIN_G, MIN_RATIO = 4, 5, 40.0, 3.0
LONGER = 0.6
COMMON_WORDS = 2500
FOLDS = 5

_WORD = re.compile(r"\w+")


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def surprise(a: int, b: int, n_a: int, n_b: int) -> float:
    """The likelihood-ratio statistic of a count in one class against the other."""
    share = (a + b) / (n_a + n_b)
    return 2 * sum(c * math.log(c / (n * share)) for c, n in ((a, n_a), (b, n_b)) if c)


def stems(toxic: list[str], ordinary: list[str]) -> list[str]:
    """Starts of words that toxic texts have in more contexts than chance allows, the strongest of each family."""
    texts = Counter(p for t in toxic for p in {w[:n] for w in set(_WORD.findall(t)) for n in range(MIN_STEM, len(w) + 1)})
    number = {p: i for i, p in enumerate(sorted(p for p, n in texts.items() if n >= MIN_TEXTS))}
    if not number:
        return []
    counts, totals = [], []
    for side in (toxic, ordinary):
        pairs, total = array("Q"), 0
        for t in side:
            words = ["", *_WORD.findall(t), ""]
            total += len(words) - 2
            for a, w, b in zip(words, words[1:], words[2:]):
                context = None
                for n in range(MIN_STEM, len(w) + 1):
                    i = number.get(w[:n])
                    if i is not None:
                        if context is None:
                            context = zlib.crc32(f"{a} {w} {b}".encode())
                        pairs.append((i << 32) | context)
        unique = np.unique(np.frombuffer(pairs, np.uint64)) if pairs else np.zeros(0, np.uint64)
        counts.append(np.bincount((unique >> np.uint64(32)).astype(np.int64), minlength=len(number)))
        totals.append(total)
    (n_a, n_b), found = totals, []
    for p, i in number.items():
        a, b = int(counts[0][i]), int(counts[1][i])
        if a * n_b > MIN_RATIO * b * n_a and (g := surprise(a, b, n_a, n_b)) >= MIN_G:
            found.append((-g, p, a))
    out: list[str] = []
    for _, p, a in sorted(found):
        if not any(p.startswith(x) or x.startswith(p) for x in out):
            # A longer start that stands in most of the same contexts makes a longer match.
            out.append(max((q for _, q, n in found if q.startswith(p) and n >= LONGER * a), key=len))
    return out


def windows(text: bytes) -> list[tuple[int, int]]:
    """Cuts a text at blanks into windows."""
    out, a, n = [], 0, len(text)
    while a < n:
        b = a + WINDOW
        if b < n:
            blank = text.find(b" ", b, a + LONGEST)
            b = blank + 1 if blank >= 0 else min(a + LONGEST, n)
        b = min(b, n)
        out.append((a, b))
        a = b
    return out


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    settings = zstandard.ZstdCompressionParameters(
        window_log=18, hash_log=17, chain_log=15, search_log=6, min_match=5, target_length=1, strategy=zstandard.STRATEGY_FAST,
        write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(compression_params=settings, dict_data=data)


def lengths(with_: zstandard.ZstdCompressor, text: bytes, cut: list[tuple[int, int]]) -> np.ndarray:
    segments = np.array([(a, b - a) for a, b in cut], np.uint64).tobytes()
    out = with_.multi_compress_to_buffer(zstandard.BufferWithSegments(text, segments), threads=0)
    return np.array([len(out[i]) for i in range(len(out))])


def gains(text: str, toxic: zstandard.ZstdCompressor, ordinary: zstandard.ZstdCompressor) -> tuple[np.ndarray, int]:
    """For each window the bytes that the toxic dictionary saves against the ordinary one, and the bytes of the text."""
    data = text.lower().encode()
    cut = windows(data)
    if not cut:
        return np.zeros(0), 0
    return lengths(ordinary, data, cut) - lengths(toxic, data, cut), len(data)


def features(gain: np.ndarray, size: int, threshold: int) -> list[float]:
    """Mean gain, the best window, and windows from the threshold on: for each 1000 bytes and in number.

    The best window and the number don't shrink with the length of the text, so a passage in a long text counts.
    """
    if not size:
        return [0.0] * 4
    over = int((gain >= threshold).sum())
    return [1000 * float(gain.sum()) / size, float(gain.max()), 1000 * over / size, math.log1p(over)]


def window_threshold(toxic: list[np.ndarray], ordinary: list[np.ndarray]) -> int:
    """The gain that parts the windows of toxic texts best from those of ordinary ones (the largest difference of shares)."""
    a, b = (np.concatenate([np.zeros(0), *side]) for side in (toxic, ordinary))
    most = int(max(a.max(initial=1), 1))
    return max(range(1, most + 1), key=lambda t: (a >= t).mean() - (b >= t).mean()) if len(a) and len(b) else 1


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    threshold: int
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        z = np.c_[(rows - self.mean) / self.scale, np.ones(len(rows))] @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def logistic(rows: np.ndarray, y: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge-penalised fit by Newton steps; the intercept is moved to the share of toxic rows among all labelled ones."""
    mean, scale = rows.mean(axis=0), rows.std(axis=0) + 1e-9
    z = np.c_[(rows - mean) / scale, np.ones(len(rows))]
    weights = np.zeros(z.shape[1])
    ridge = np.eye(len(weights))
    ridge[-1, -1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ weights, -500, 500)))
        weights -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (p - y) + ridge @ weights)
    share = y.mean()
    weights[-1] += math.log(prior / (1 - prior)) - math.log(share / (1 - share))
    return mean, scale, weights


def train(toxic: list[str], ordinary: list[str], prior: float) -> Model:
    low = [t.lower() for t in toxic], [t.lower() for t in ordinary]
    marks = stems(*low)
    frequent = [w for w, _ in sorted(Counter(w for t in low[1] for w in set(_WORD.findall(t))).items(), key=lambda x: (-x[1], x[0]))]
    plain = [w for w in frequent if not any(w.startswith(x) for x in marks)]
    # The end of a dictionary is the nearest: the class's own words, after the common ones, the most frequent last.
    common = (" " + " ".join(reversed(plain[:COMMON_WORDS])) + " ").encode()
    own = (" " + " ".join(reversed(marks)) + " ").encode()
    rest = plain[COMMON_WORDS:] or plain
    other = (" " + " ".join(rest)).encode()[: len(own) - 1].ljust(len(own))
    dictionaries = common + own, common + other
    pair = [compressor(d) for d in dictionaries]
    found = [gains(t, *pair) for t in toxic + ordinary]
    threshold = window_threshold([g for g, _ in found[: len(toxic)]], [g for g, _ in found[len(toxic) :]])
    rows = np.array([features(*x, threshold) for x in found])
    y = np.array([1.0] * len(toxic) + [0.0] * len(ordinary))
    return Model(*dictionaries, threshold, *logistic(rows, y, prior))


def fitted(docs: DataFrame, labels: DataFrame) -> Model | None:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(
        "doc_id IS NOT NULL AND toxic IN (0, 1)").filter(fold(F.col("doc_id")) != 0)
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return None
    pick = lambda k: known.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    sample = F.broadcast(pick(0).unionByName(pick(1)).dropDuplicates())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.length("text") <= SAMPLE_CHARS).join(
        sample, "doc_id").groupBy("toxic", "doc_id").agg(F.min("text").alias("text")).collect()
    rows = sorted(rows, key=lambda r: r["doc_id"])
    sides = [[r["text"] for r in rows if r["toxic"] == k] for k in (1, 0)]
    return train(*sides, counts[1] / sum(counts.values())) if all(sides) else None


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` for every row of ``docs``."""
    model = fitted(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        pair = [compressor(model.toxic), compressor(model.ordinary)] if model else None
        for batch in batches:
            out = np.zeros(batch.num_rows)
            if model and batch.num_rows:
                out = model.scores(np.array([features(*gains(t or "", *pair), model.threshold) for t in batch.column("text").to_pylist()]))
            yield pa.record_batch([batch.column("doc_id"), pa.array(out)], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, score double")
    return scored.select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score of every document."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return toxicity(read("documents").select("doc_id", "text"), read("labels"))
