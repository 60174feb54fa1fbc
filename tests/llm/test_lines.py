from __future__ import annotations

import hashlib
import re
from collections import Counter

from helpers import SMALL
from pyspark.sql import functions as F

from tillroll.llm.lines import LineRuns, line_counts, op13_line_dedup, without_common_lines

DOCS = "doc_id long, text string, kept string, n_lines int"


def key(line: str) -> str:
    line = re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line)
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line)


def by_hand(docs: list[tuple], least: int, min_chars: int = 1) -> list[tuple]:
    seen = Counter(k for _, text in docs for k in {key(x) for x in (text or "").split("\n")} if len(k) >= min_chars)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= min_chars and seen[key(x)] >= least)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def read(df) -> list[tuple]:
    rows = df.collect()
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in rows)
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in rows), key=str)


def corpus(rng) -> list[tuple]:
    pool = ["Read more", "  read MORE\t", "ÄRGER", "ärger", "a", "", " \x0b", "x\ry", "one line of its own"] + [f"line {i}" for i in range(60)]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12)))) for i in range(200)]
    docs += [(1000 + i, "the same text\nin many\ndocuments") for i in range(100)]
    docs += [(5, "Read more\n" * 5000 + "end"), (6, None), (7, ""), (8, "\n"), (None, "line 1\nline 2"), (1000, "the same text\nin many\ndocuments")]
    return docs


def test_against_counts_by_hand(spark, rng):
    docs = corpus(rng)
    df = spark.createDataFrame([(*d, "mine", 7) for d in docs], DOCS).repartition(5)
    for least, min_chars in ((10, 1), (3, 1), (1, 0), (10, 2), (12, 8)):
        assert read(without_common_lines(df, least, min_chars)) == by_hand(docs, least, min_chars)


def test_counts_spread_over_runs_and_levels_are_summed(spark, rng):
    docs = corpus(rng)
    df = spark.createDataFrame([(*d, "mine", 7) for d in docs], DOCS)
    for batches in (1, 3, 17):
        assert read(without_common_lines(df, 10, batches=batches)) == by_hand(docs, 10)


def test_runs_grow_by_batches(spark):
    runs = LineRuns(spark, least=3, fanout=2)
    counted = []
    for batch in (["a\nb", "c"], ["a\nb"], ["a"], ["a\nb\nc", "c"], ["d"]):
        docs = spark.createDataFrame([(0, t) for t in batch], "s int, text string")
        runs.add(line_counts(docs, 4, 1).select("bucket", "keys", "counts"))
        counted.append(sum(len(r["keys"]) // 16 for r in runs.common().collect()))
    runs.settle()
    common = runs.common().collect()
    assert sum(len(r["keys"]) // 16 for r in common) == 3  # a, b, c
    assert counted == [0, 0, 0, 3, 3]  # the second compaction of level 0 brings three counts of a and b together
    left = spark.read.parquet(*[p for level in runs.levels for p in level]).filter(~F.col("common"))
    assert sum(len(r["keys"]) // 16 for r in left.collect()) == 1  # d
    assert sum(map(len, runs.levels)) == 1


def test_odd_rows(spark, odd_docs, no_docs):
    rows = without_common_lines(odd_docs, 2).collect()
    assert len(rows) == odd_docs.count()
    assert {r.n_dropped for r in rows if r.doc_id in (1, 3)} == {1}
    assert without_common_lines(no_docs).collect() == []


def test_query_covers_the_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = {i: (n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in by_hand(docs, 10)}
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in op13_line_dedup(spark, SMALL).collect()}
    assert got == want and any(d for _, d, _ in want.values())
