from __future__ import annotations

import zlib

import numpy as np
from helpers import SMALL

from tillroll.llm import toxicity as t

#: The next smaller table has 6 toxic documents that are held out, this one 97.
LARGE = SMALL.replace("0.001", "0.1")


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{LARGE}/labels.parquet").collect()}
    rows = t.op8_toxicity(spark, LARGE).collect()
    assert len(rows) == spark.read.parquet(f"{LARGE}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    bad, good = [x for x, y in held if y], [x for x, y in held if not y]
    wins = sum((a > b) + 0.5 * (a == b) for a in bad for b in good)
    assert wins / (len(bad) * len(good)) > 0.9
    assert sum(x >= 0.5 for x in bad) >= 0.7 * len(bad) and sum(x >= 0.5 for x in good) <= 0.02 * len(good)


def test_a_passage_in_a_long_text_counts(spark):
    """A long clean text scores higher with a toxic one put into its middle."""
    docs, labels = (spark.read.parquet(f"{LARGE}/{x}.parquet") for x in ("documents", "labels"))
    both = [(r.text, r.toxic) for r in docs.join(labels, "doc_id").filter("text IS NOT NULL AND crc32(cast(doc_id AS string)) % 5 = 0").collect()]
    model = t.fitted(docs, labels)
    pair = [t.compressor(model.toxic), t.compressor(model.ordinary)]
    score = lambda text: float(model.scores(np.array([t.features(*t.gains(text, *pair), model.threshold)]))[0])
    passages = sorted((x for x, y in both if y), key=len)[-30:]
    clean = max((x for x, y in both if not y and score(x) < 0.1), key=len)
    assert len(clean) > 5000
    half = len(clean) // 2
    raised = [score(f"{clean[:half]} {p} {clean[half:]}") > score(clean) for p in passages]
    assert sum(raised) >= 0.8 * len(raised)


def test_held_out_labels_and_other_columns_do_not_matter(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "toxic")
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    other = docs.selectExpr("doc_id", "text", "'zz' AS lang", "'zz' AS source", "1 AS score")
    score = lambda d, y: {r.doc_id: r.score for r in t.toxicity(d, y).collect()}
    assert score(docs, labels) == score(other, turned)


def test_odd_tables(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int, text string")
    assert {r.score for r in t.toxicity(odd_docs, none).collect()} == {0.0}
    some = spark.createDataFrame([(1, 1, "x"), (3, 0, None), (8, 0, None), (9, 1, None), (None, 1, None), (4, None, None)], none.schema)
    assert t.toxicity(odd_docs, some).count() == odd_docs.count()
    assert t.toxicity(no_docs, some).count() == 0
