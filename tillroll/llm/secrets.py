"""Secret scan: three base patterns, and windows of high Shannon entropy in strings that look like keys.

A candidate is a whole run of ``[A-Za-z0-9+/_=-]`` of at least ``WINDOW`` characters. A window of that length slides over it; its entropy
is kept up to date from the counts of the character that leaves and the one that enters. The threshold depends on the class of
characters in the window (hexadecimal; letters of one case and digits; mixed). Windows above it are joined to one span of kind ``entropy``.
Candidates without a digit or without a letter (words, numbers) are dropped. The allow-list (paths, well-known fillers) takes only the
windows that overlap one of its matches, so that the rest of a long candidate counts. Spans inside a base span are dropped, too.

Offsets are code points of the whole text. Every text is scanned on its own in one pass, so no row meets another: no shuffle.

Edge cases: a null text counts as empty and has no spans; repeated rows, missing doc_id and very long texts are treated alike;
an empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.hashing import chunks, texts

#: Fixed values of the base kinds.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ASSIGN_WORDS = [b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"]
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KINDS = ["assign", "access", "hex", "entropy"]
LEAST = {"assign": 12, "access": 18, "hex": 16}

WINDOW = 20
#: Bits for each character, by class of characters ("hex" and "lower": in one case, whichever).
THRESHOLDS = {"hex": 3.0, "lower": 3.5, "mixed": 3.7}
#: The parts of a path are whole words, so that a key behind a path isn't taken for a part of it.
ALLOWED = re.compile(
    rb"(?i)(0123456789|abcdefghij|x{8}|example|placeholder|changeme|your[_-]|lorem|https?|www"
    rb"|(?:/[a-z]+(?:[_-][a-z]+)*[0-9]{0,3}){2,}(?![a-z0-9+=_-])|(.)\2{7})"
)

_HEX, _KEY = np.zeros(256, bool), np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_KEY[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True
_TERM = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]


def runs(data: np.ndarray, offsets: np.ndarray, allowed: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of allowed bytes that are long enough; none crosses texts."""
    inside = allowed[data]
    start, stop = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    filled = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][filled], offsets[1:][filled] - 1
    start[first] |= inside[first]
    stop[last] |= inside[last]
    begin, end = np.flatnonzero(start), np.flatnonzero(stop) + 1
    long = end - begin >= least
    return begin[long], end[long]


def high_entropy(text: bytes) -> list[tuple[int, int]]:
    """Joined windows above the threshold of their class that no match of the allow-list overlaps.

    Counts change by the two characters that differ.
    """
    counts, total = [0] * 256, 0.0
    upper = lower = high_upper = high_lower = other = 0  # A-Z; a-z; G-Z; g-z; + / _ = -
    allowed = [m.span() for m in ALLOWED.finditer(text)]
    nearest = 0
    out: list[list[int]] = []
    for i, c in enumerate(text):
        total += _TERM[counts[c] + 1] - _TERM[counts[c]]
        counts[c] += 1
        upper += 65 <= c <= 90
        lower += 97 <= c <= 122
        high_upper += 71 <= c <= 90
        high_lower += 103 <= c <= 122
        other += c in b"+/_=-"
        if i >= WINDOW:
            d = text[i - WINDOW]
            total += _TERM[counts[d] - 1] - _TERM[counts[d]]
            counts[d] -= 1
            upper -= 65 <= d <= 90
            lower -= 97 <= d <= 122
            high_upper -= 71 <= d <= 90
            high_lower -= 103 <= d <= 122
            other -= d in b"+/_=-"
        if i >= WINDOW - 1:
            a = i - WINDOW + 1
            while nearest < len(allowed) and allowed[nearest][1] <= a:
                nearest += 1
            if nearest < len(allowed) and allowed[nearest][0] <= i:
                continue
            kind = "mixed" if other or upper and lower else "lower" if high_upper or high_lower else "hex"
            if math.log2(WINDOW) - total / WINDOW >= THRESHOLDS[kind]:
                if out and a <= out[-1][1]:
                    out[-1][1] = i + 1
                else:
                    out.append([a, i + 1])
    return [(a, b) for a, b in out]


def suspicious(text: bytes) -> bool:
    """False for words and numbers: no digit or no letter."""
    return any(48 <= c <= 57 for c in text) and any(c > 64 for c in text if c != 95)


def spans_of(data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """By text: (start, number of kind, end) in bytes of that text."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    raw = data.tobytes()
    low = raw.lower()
    maybe: dict[int, set[str]] = {}
    for kind, marks, where in (("assign", ASSIGN_WORDS, low), ("access", [b"AKIA"], raw)):
        for mark in marks:
            at = where.find(mark)
            while at >= 0:
                text = int(np.searchsorted(offsets, at, "right")) - 1
                maybe.setdefault(text, set()).add(kind)
                at = where.find(mark, int(offsets[text + 1]))
    for text, kinds in maybe.items():
        own = raw[offsets[text] : offsets[text + 1]]
        for kind, pattern, group in (("assign", ASSIGN, 2), ("access", ACCESS, 0)):
            if kind in kinds:
                found.setdefault(text, []).extend(
                    (m.start(), KINDS.index(kind), m.end()) for m in pattern.finditer(own) if len(m.group(group)) >= LEAST[kind])
    for allowed, least, kind in ((_HEX, LEAST["hex"], 2), (_KEY, WINDOW, 3)):
        begin, end = runs(data, offsets, allowed, least)
        owner = np.searchsorted(offsets, begin, "right") - 1
        for text, a, b in zip(owner.tolist(), begin.tolist(), end.tolist(), strict=True):
            own, base = found.setdefault(text, []), int(offsets[text])
            if kind == 2:
                own.append((a - base, 2, b - base))
            elif suspicious(raw[a:b]):
                for x, y in high_entropy(raw[a:b]):
                    x, y = a - base + x, a - base + y
                    if not any(k < 3 and s <= x and y <= e for s, k, e in own):
                        own.append((x, 3, y))
    return {t: sorted(x) for t, x in found.items() if x}


SPANS = "array<struct<kind:string,start:long,end:long>>"
SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def secrets(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``found``: all spans of every text, by start, then kind."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for head, _, data, offsets in chunks(*texts(batch.column("text"))):
                for text, spans in spans_of(data, offsets).items():
                    a, b = offsets[text], offsets[text + 1]
                    points = np.concatenate([[0], np.cumsum((data[a:b] & 0xC0) != 0x80)])
                    rows[head + text] = [{"kind": KINDS[k], "start": int(points[s]), "end": int(points[e])} for s, k, e in spans]
            yield pa.record_batch([batch.column("doc_id"), pa.array(rows, SPANS_ARROW)], ["doc_id", "found"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, f"doc_id long, found {SPANS}")


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Counts of the base kinds, their digest, and all spans of every document."""
    found = secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(said(F.filter("found", lambda x: x["kind"] != "entropy")), 256).alias("base_sha256"),
        said(F.col("found")).alias("spans"),
    )
