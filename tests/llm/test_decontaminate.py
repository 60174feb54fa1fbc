from __future__ import annotations

import numpy as np
from helpers import SMALL

from tillroll.llm import decontaminate as d

BENCHMARK = "item_id long, text string, key string"


def test_common_subsequence_against_a_table(rng):
    for _ in range(300):
        a, b = ([rng.randint(0, 6) for _ in range(rng.randint(1, 40))] for _ in range(2))
        masks: dict[int, int] = {}
        for k, w in enumerate(a):
            masks[w] = masks.get(w, 0) | 1 << k
        row = [0] * (len(b) + 1)
        for x in a:
            before = row[:]
            for j, y in enumerate(b):
                row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
        assert d.common_subsequence(masks, len(a), b) == row[-1]


def test_planted_items_are_found_and_others_left(spark):
    items = [r for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect() if r.text and len(r.text.split()) >= 12]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    clean = {r.doc_id for r in docs.collect()}
    rows = []
    for k, item in enumerate(items[:40]):
        words = item.text.split()
        changed = [w for i, w in enumerate(words) if i % 9 != 4]  # some words left out
        rows += [(10**9 + 2 * k, f"Before it. {item.text} And after it."), (10**9 + 2 * k + 1, " ".join(["so"] * 200 + changed + ["then"] * 50))]
    found = {r.key for r in d.leaks(docs.unionByName(spark.createDataFrame(rows, docs.schema)), spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
    planted = {r[0] for r in rows}
    assert {x for x in planted if x % 2 == 0} <= found
    altered = {x for x in planted if x % 2}
    assert len(altered & found) >= 0.9 * len(altered)
    whole = [r.text.lower() for r in items]
    for r in docs.collect():
        if r.text and any(w in r.text.lower() for w in whole):
            assert r.doc_id in found
    assert len(found & clean) < 0.2 * len(clean)


def test_common_subsequence_decides_without_answers(spark):
    items = [r for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect() if r.text and len(r.text.split()) >= 12][:20]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    # A hot group of copies of the first item, so that its terms stand in many passages.
    rows = [(10**9 + k, f"copy {k} of it: {items[0].text}") for k in range(300)]
    for k, item in enumerate(items):
        rows.append((2 * 10**9 + k, " ".join(["so"] * 200 + [w for i, w in enumerate(item.text.split()) if i % 9 != 4] + ["then"] * 50)))
    found = {(r.key, r.item_id) for r in d.leaks(docs.unionByName(spark.createDataFrame(rows, docs.schema)), spark.createDataFrame(items)).collect()}
    assert {(10**9 + k, items[0].item_id) for k in range(300)} <= found
    missing = {(2 * 10**9 + k, item.item_id) for k, item in enumerate(items)} - found
    assert not missing, len(missing)


def by_hand(docs: list[tuple], items: list[tuple]) -> set[tuple]:
    """Every pair of a document and an item of up to 64 words with a long common subsequence in some window, all pairs tried."""
    hashed = [(i, d.hashed_words(t).tolist()) for i, t in items]
    out = set()
    for doc, text in docs:
        words = d.hashed_words(text).tolist()
        for item, own in hashed:
            masks: dict[int, int] = {}
            for k, w in enumerate(own):
                masks[w] = masks.get(w, 0) | 1 << k
            step, size = d.BLOCK * d.STEP_BLOCKS, d.BLOCK * (d.WINDOW_BLOCKS + 1)
            for a in range(0, max(len(words), 1), step):
                if own and d.common_subsequence(masks, len(own), words[max(a - d.BLOCK, 0) : a + size]) >= d.least_common(len(own)):
                    out.add((doc, item))
    return out


def test_recall_against_an_exhaustive_search(spark, rng):
    """Items with words left out or replaced, among the words of other documents."""
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect() if r.text][:25]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    pool = [w for r in docs.collect() if r.text for w in r.text.split()]
    rows = []
    for n, (_, text) in enumerate(items):
        for every in (9, 6, 5, 4):
            for replaced in (False, True):
                words = [rng.choice(pool) if i % every == 2 else w for i, w in enumerate(text.split()) if replaced or i % every != 2]
                before, after = ([rng.choice(pool) for _ in range(rng.randint(0, 150))] for _ in range(2))
                rows.append((10**9 + len(rows), " ".join(before + words + after)))
    want = by_hand(rows, items)
    assert len(want) >= 0.9 * len(rows)
    every = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    found = {(r.key, r.item_id) for r in d.leaks(every, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want & found) >= 0.98 * len(want)
    assert {x for x in found if x[0] >= 10**9} <= want


def test_models_hold_so_many_terms_and_all_parts(spark, rng):
    parts = [d.Item(i, [rng.randint(0, 300) for _ in range(rng.randint(1, 20))], []) for i in range(100)]
    runs = list(d.models(parts, 60))
    assert [x for run in runs for x in run] == parts and len(runs) > 5
    assert all(len({w for x in run for w in x.words}) <= 60 for run in runs)


def test_small_models_find_the_same(spark, monkeypatch):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    whole = {(r.key, r.item_id) for r in d.leaks(docs, items).collect()}
    monkeypatch.setattr(d, "MODEL_TERMS", 200)
    monkeypatch.setattr(d.models, "__defaults__", (200,))
    parted = {(r.key, r.item_id) for r in d.leaks(docs, items).collect()}
    assert len(parted ^ whole) <= 0.05 * len(whole)


def test_odd_tables(spark, odd_docs, no_docs):
    items = spark.createDataFrame([
        (1, "The quick brown fox jumps over the lazy dog near the river bank today.", "k"), (2, None, None), (3, "", None), (None, "x y z", None),
        (1, "The quick brown fox jumps over the lazy dog near the river bank today.", "k")], BENCHMARK)
    assert {r.key for r in d.leaks(odd_docs, items).collect()} == {1, 3}
    left = d.without_leaks(odd_docs, items)
    assert left.columns == odd_docs.columns and left.count() == odd_docs.count() - 3
    assert d.leaks(no_docs, items).count() == 0
    assert d.leaks(odd_docs, items.limit(0)).count() == 0 and d.without_leaks(odd_docs, items.limit(0)).count() == odd_docs.count()


def test_the_latent_space_comes_from_all_passages(spark):
    """20,000 distinct passages and 100 copies of one: every one is a row of the fit, and the products are those of the whole matrix."""
    words = [f"word{k}" for k in range(300)]
    docs = [(f"{words[k % 150]} {words[150 + k // 150]} other", ) for k in range(20_000)] + [("word1 word2 word3", )] * 100 + [("nothing here", ), (None, )]
    vocabulary = np.unique(np.concatenate([d.hashed_words(w) for w in words]))
    rows = spark.createDataFrame(docs, "text string").repartition(4)
    counts = d.passage_counts(rows, vocabulary).filter("term = -2").selectExpr("n", "terms", "sizes", "1D AS scale").cache()
    sizes = [x for r in counts.collect() for x in r.sizes]
    assert len(sizes) == 20_100 == sum(r.n for r in counts.collect())
    dense = np.zeros((len(sizes), len(vocabulary)))
    weights = np.linspace(0.5, 3, len(vocabulary))
    k = 0
    for r in counts.collect():
        terms, at = np.frombuffer(bytes(r.terms), np.uint16), 0
        for size in r.sizes:
            dense[k, terms[at : at + size]] = weights[terms[at : at + size]]
            k, at = k + 1, at + size
    dense /= np.linalg.norm(dense, axis=1)[:, None]
    x = np.random.default_rng(1).standard_normal((len(vocabulary), 20))
    assert np.allclose(d.product(counts, weights, x), dense.T @ (dense @ x), rtol=1e-4, atol=1e-2)


def test_rows_become_a_matrix_over_their_terms(rng):
    owner = np.sort(np.array([rng.randint(0, 9) for _ in range(200)]))
    term = np.array([rng.choice([3, 5, 8, 900, 60_000]) for _ in range(200)], np.uint16)
    weight = np.array([rng.random() for _ in range(200)])
    terms, matrix = d.dense(owner, term, weight, 10)
    want = np.zeros((10, 60_001))
    np.add.at(want, (owner, term), weight)
    assert terms.tolist() == [3, 5, 8, 900, 60_000] and np.allclose(matrix, want[:, terms]) and not np.delete(want, terms, axis=1).any()


def test_words_are_looked_up_in_a_vocabulary(rng):
    """Terms that crowd in one slot or at the end of all numbers, and words beside them."""
    for size in (1, 2, 7, 500):
        near = [rng.getrandbits(64) for _ in range(size)] + [2**64 - 1 - k for k in range(size % 5)] + [12345 + k for k in range(size % 7)]
        vocabulary = np.unique(np.array(near, np.uint64))
        words = np.array([rng.choice(near) if rng.random() < 0.5 else rng.choice([rng.getrandbits(64), 2**64 - 9, 12344, 0]) for _ in range(2000)], np.uint64)
        place, term = d.Lookup(vocabulary).known(words)
        number = {int(h): i for i, h in enumerate(vocabulary)}
        want = [(k, number[int(w)]) for k, w in enumerate(words) if int(w) in number]
        assert list(zip(place.tolist(), term.tolist(), strict=True)) == want
    assert [len(x) for x in d.Lookup(vocabulary).known(np.zeros(0, np.uint64))] == [0, 0]


def test_products_are_put_together_from_columns_and_the_rest(spark, rng, monkeypatch):
    """The frequent terms' columns are added up once; a scan of the rest alone makes each product whole, with terms that a row has again."""
    size, passages = 400, [sorted(min(int(rng.expovariate(0.02)), 399) for _ in range(rng.randint(1, 60))) for _ in range(5000)]
    weights = np.log(5001 / (1 + np.bincount([t for p in passages for t in set(p)], minlength=size)))
    blocks = d.packed(np.array([t for p in passages for t in p]), np.array([len(p) for p in passages]), size)
    rows = spark.createDataFrame([(bytearray(t), bytearray(n), 1.0) for _, t, n in blocks], "terms binary, sizes binary, scale double").repartition(3)
    dense = np.zeros((len(passages), size))
    for k, p in enumerate(passages):
        for t in p:
            dense[k, t] += weights[t] / np.linalg.norm(weights[p])
    gram = dense.T @ dense
    monkeypatch.setattr(d, "COLUMN_PAIRS", 1000)
    head = np.argsort(weights, kind="stable")[:50]
    assert np.allclose(d.columns(rows, weights, head), gram[:, head], rtol=1e-5, atol=1e-5)
    tail = np.setdiff1d(np.arange(size), head)
    x = np.random.default_rng(1).standard_normal((size, 20))
    want = np.zeros((size, 20))
    want[tail] = gram[np.ix_(tail, tail)] @ x[tail]
    assert np.allclose(d.product(rows, weights, x, head), want, rtol=1e-4, atol=1e-3)
    # The frequent terms take no part in the scans of the iteration, and the space is that of the whole matrix.
    monkeypatch.setattr(d, "HEAD_CELLS", 0)
    seen, whole = [], d.product

    def product(rows, weights, x, left_out=None):
        seen.append(left_out)
        return whole(rows, weights, x, left_out)

    monkeypatch.setattr(d, "product", product)
    basis = d.latent_basis(rows, weights, 32)
    assert len(seen) == d.ROUNDS + 1 and all(sorted(s) == sorted(np.argsort(weights, kind="stable")[:32]) for s in seen)
    start = np.linalg.qr(np.random.default_rng(5).standard_normal((size, 32 + d.EXTRA)))[0]
    for _ in range(d.ROUNDS):
        start = np.linalg.qr(gram @ start)[0]
    value, vector = np.linalg.eigh(start.T @ gram @ start)
    exact = start @ vector[:, np.argsort(-value)[:32]]
    assert np.allclose(np.abs(np.sum(basis * exact, axis=0))[:16], 1, atol=1e-3)
    assert abs(np.trace(basis.T @ gram @ basis) / np.trace(exact.T @ gram @ exact) - 1) < 1e-5


def test_rows_of_any_length_are_summed(rng):
    size = np.array([rng.randint(1, 16) for _ in range(2 * d.SUM_ROWS + 7)])
    first = np.cumsum(size) - size
    term = np.array([rng.randint(0, 30) for _ in range(int(size.sum()))])
    vectors = np.random.default_rng(2).standard_normal((31, 8)).astype(np.float32)
    found = d.row_sums(vectors, term, first, size)
    want = [vectors[term[a : a + n]].sum(axis=0) for a, n in zip(first, size, strict=True)] + [np.zeros(8)]
    assert np.allclose(found, want, atol=1e-4)
    assert not d.row_sums(vectors, term, first[:0], size[:0]).any()
