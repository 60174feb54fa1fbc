from __future__ import annotations

import hashlib

import pytest
import zstandard
from helpers import SMALL
from pyspark.sql import functions as F

from tillroll.llm.infill import digests, op11_fill_in_middle, stored, transformed

DOCS = "doc_id long, text string, form string, frames int"


def by_hand(doc_id, text: str | None, rate: int = 90, spm: int = 20) -> tuple:
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def texts(rng) -> list[tuple]:
    letters = "abc <>PSM\néß中🙂"
    docs = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    docs += [(1000 + i, "".join(rng.choice(letters) for _ in range(rng.choice([7, 8, 9, 16, 17, 4096, 4097, 9000])))) for i in range(60)]
    docs += [(1, None), (2, ""), (3, "<P>"), (4, "a<M>b"), (None, "no number"), (5, "twice"), (5, "twice"), (6, "🙂" * 50_000), (-7, "minus")]
    return docs


@pytest.mark.parametrize("frame", [1, 8, 4096])
def test_outputs_against_slices(spark, rng, frame):
    docs = texts(rng)
    df = spark.createDataFrame([(*d, "mine", 3) for d in docs], DOCS).repartition(3)
    if frame == 1:
        df, docs = df.filter(F.coalesce(F.length("text"), F.lit(0)) < 1000), [d for d in docs if len(d[1] or "") < 1000]
    outputs = transformed(stored(df, frame=frame))
    expand = zstandard.ZstdDecompressor().decompress
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, b"".join(map(expand, r.frames)).decode()) for r in outputs.collect()), key=str)
    assert got == sorted(((i, *by_hand(i, t)) for i, t in docs), key=str)
    for r in outputs.collect():
        ends = [0]
        for f in r.frames:
            ends.append(ends[-1] + len(expand(f).decode()))
        assert ends[1:] == r.ends
    read = digests(outputs).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert sorted(((r.doc_id, r.output_sha256, r.restored_sha256) for r in read), key=str) == sorted(
        ((i, sha(by_hand(i, t)[4]), sha(t or "")) for i, t in docs), key=str)
    assert {r.form for r in read} == {"plain", "psm", "spm"}


def test_only_frames_at_cuts_are_made_anew(spark):
    text = "".join(chr(97 + i % 26) for i in range(100_000))
    df = spark.createDataFrame([(i, text) for i in range(20)], "doc_id long, text string")
    old = {r.doc_id: set(map(bytes, r.frames)) for r in stored(df).collect()}
    for r in transformed(stored(df), rate=100).collect():
        assert len([f for f in r.frames if bytes(f) not in old[r.doc_id]]) <= 3 + 4  # the marks, and both sides of two cuts
        assert r.form != "plain"


def test_rates(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    assert transformed(stored(df), rate=0).filter("form != 'plain'").count() == 0
    assert transformed(stored(df), rate=100, spm_rate=100).filter("form != 'spm'").count() == 0
    first, second = (transformed(stored(df), seed=s).select("form", "prefix_chars").collect() for s in (1, 2))
    assert first != second


def test_odd_rows(spark, odd_docs, no_docs):
    rows = digests(transformed(stored(odd_docs))).collect()
    assert len(rows) == odd_docs.count()
    assert {r.form for r in rows if r.doc_id in (2, 4)} == {"plain"}
    assert digests(transformed(stored(no_docs))).collect() == []


def test_query_covers_the_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r.doc_id: (r.n, r.form, r.prefix_chars, r.middle_chars, r.restored_sha256) for r in op11_fill_in_middle(spark, SMALL).collect()}
    want = {r.doc_id: (*by_hand(r.doc_id, r.text)[:4], hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect()}
    assert got == want
