from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from helpers import SMALL

from tillroll.llm.lexical import Heaps, index_of, op12_ranked_lexical_search, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, score long, rank int"
ITEMS = "item_id long, text string, doc_id long"


def terms(text: str | None) -> list[str]:
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(docs: list[tuple], items: list[tuple], top: int = 20) -> list[tuple]:
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counted:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
                for t in terms(text) if t in c
            )
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


def read(df) -> list[tuple]:
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


def corpus(rng) -> tuple[list, list]:
    vocabulary = [f"w{i}" for i in range(80)] + ["Ünder", "the", "THE", "中文", "a-b", "x_y", "9"]
    say = lambda n: " ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(len(vocabulary))], k=n))
    docs = [(i, say(rng.randint(1, 40))) for i in range(400)]
    docs += [(1000 + i, docs[3][1]) for i in range(60)]  # ties
    docs += [(5000, say(9000)), (5001, None), (5002, ""), (5003, " - _ "), (None, docs[3][1]), (7, say(5)), (7, docs[3][1]), (-4, docs[3][1])]
    items = [(i, say(rng.randint(1, 12))) for i in range(30)] + [(50, None), (51, ""), (52, "nowhere found"), (53, docs[3][1]), (53, "the the w1"), (None, "w2")]
    return docs, items


def test_against_all_scores(spark, rng):
    docs, items = corpus(rng)
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], DOCS).repartition(6)
    benchmark = spark.createDataFrame([(*i, 3) for i in items], ITEMS)
    assert read(search(df, benchmark)) == by_hand(docs, items)
    assert read(search(df, benchmark, top=3)) == by_hand(docs, items, 3)
    # in slices
    assert read(search(df, benchmark, slice_bytes=300)) == by_hand(docs, items)


def test_index_holds_the_counts_of_all_items(rng):
    _, items = corpus(rng)
    index = index_of([{"item_id": i, "text": t} for i, t in items])
    for word in ("the", "w0", "Ünder"):
        at = [bytes(index.data[a:b]).decode() for a, b in zip(index.start, index.start[1:])].index(word)
        held = {int(i): int(c) for i, c in zip(index.item[index.first[at] : index.first[at + 1]], index.count[index.first[at] : index.first[at + 1]])}
        assert held == {i: n for i, (_, t) in enumerate(items) if (n := terms(t).count(word))}


def test_heap_keeps_the_lowest_ids_of_equal_scores():
    heaps = Heaps(1, 2)
    for ids, scores in (([9, 4], [5, 5]), ([1, 7], [5, 0]), ([3], [5]), ([2], [4]), ([20], [6])):
        heaps.update(np.array(scores)[:, None], np.array(ids))
    assert sorted((s, ~k) for s, k in heaps.heaps[0]) == [(5, 1), (6, 20)]


def test_empty_sides(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "the quick fox", 1)], ITEMS)
    assert search(no_docs, items).collect() == []
    assert search(odd_docs, items.limit(0)).collect() == []
    found = search(odd_docs, items).collect()
    assert [r.doc_id for r in sorted(found, key=lambda r: r.rank)][:3] == [1, 1, 3]


def test_query_covers_the_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert read(op12_ranked_lexical_search(spark, SMALL)) == by_hand(docs, items)
