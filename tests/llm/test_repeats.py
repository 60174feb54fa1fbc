from __future__ import annotations

import hashlib

from tillroll.llm.repeats import without_repeats

DOCS = "doc_id long, text string, least string, n_bytes long"


def by_hand(docs: list[tuple]) -> dict[int, tuple]:
    seen, out = set(), {}
    for i, text in sorted(docs):
        data = (text or "").encode()
        gone = [False] * len(data)
        for k in range(len(data) - 99):
            window = data[k : k + 100]
            if window in seen:
                gone[k : k + 100] = [True] * 100
            seen.add(window)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def read(df) -> dict[int, tuple]:
    rows = df.collect()
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in rows)
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}


def test_against_sets_of_windows(spark, rng):
    words = ["alpha", "béta", "gamma", "delta", "epsilon", "zeta", "eta", "θ"]
    say = lambda n: " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(n))
    passages = [say(n) for n in (12, 20, 40)]
    docs = [(100 + i, " ".join(rng.choice([say(rng.randint(1, 30)), rng.choice(passages)]) for _ in range(rng.randint(1, 6)))) for i in range(150)]
    docs += [(1000 + i, docs[i][1]) for i in range(20)]  # copies
    docs += [(1, "a" * 450), (2, "a" * 99), (3, "ab" * 300), (4, "b" + "ab" * 90), (5, "abcdefghij" * 60), (6, passages[0] * 5)]
    docs += [(7, None), (8, ""), (9, "x" * 100), (10, "x" * 100), (11, "y" + "x" * 100 + "z")]
    df = spark.createDataFrame([(*d, "of the input", 3) for d in docs], DOCS).repartition(7)
    assert read(without_repeats(df)) == by_hand(docs)


def test_repeated_rows_and_missing_ids(spark, odd_docs, no_docs):
    rows = without_repeats(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r.n_removed for r in rows if r.doc_id in (1, 2, 3, 4, 5)} == {0}
    assert next(r.n_removed for r in rows if r.doc_id == 8) > 29_000
    assert without_repeats(no_docs).count() == 0
