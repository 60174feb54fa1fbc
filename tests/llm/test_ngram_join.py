from __future__ import annotations

from collections import Counter, defaultdict

from helpers import SMALL
from tillroll.llm.components import components
from tillroll.llm.ngram_join import may_overlap, one_of_each, op3_ngram_jaccard, pack, similar_documents, unpack


def by_hand(docs):
    """doc_id -> (size, component) for a list of (doc_id, text) with distinct ids."""
    sets, where = {}, defaultdict(list)
    for i, text in docs:
        words = (text or "").encode().lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())
        for g in sets[i]:
            where[g].append(i)
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j, n in Counter(j for g in sets[i] for j in where[g] if j < i).items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), top(i)) for i, s in sets.items()}


def test_all_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op3_ngram_jaccard(spark, SMALL).collect()}
    assert got == by_hand(docs)


def test_near_copies_chains_and_case(spark, rng):
    base = [f"w{k}" for k in range(120)]
    docs = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(120)] = f"x{rng.randrange(10_000)}"
        docs.append((100 - i, " ".join(words).upper() if i % 7 == 0 else "\t".join(words)))
    for k in range(0, 200, 4):  # each one close to the next, the ends far apart
        docs.append((1000 + k, " ".join(f"c{j}" for j in range(k, k + 90))))
    docs += [(5000, "one two three"), (5001, "ONE  two\nthree"), (5002, "one two"), (5003, None), (5004, "")]
    rows = similar_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == by_hand(docs)


def test_a_passage_in_more_than_2048_texts(spark):
    rare, hot, other = ([f"{x}{k}" for k in range(30)] for x in "rhq")
    rare = rare[:10]
    # Two of unequal size (36 of 40 shingles shared); document 1 is the leader of their rare shingles and similar to neither.
    docs = [(1, rare + other), (2, rare + hot), (3, rare + hot + ["e1", "e2", "e3", "e4"])]
    docs += [(10 + i, rare[-4:] + other + [f"o{i}x{k}" for k in range(60)]) for i in range(5)]
    docs += [(100 + i, rare[-4:] + hot + [f"n{i}x{k}" for k in range(60)]) for i in range(2100)]
    docs = [(i, " ".join(words)) for i, words in docs]
    rows = similar_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert got == by_hand(docs) and got[3] == (40, 2)


def test_edges(spark, odd_docs, no_docs):
    rows = similar_documents(odd_docs).collect()
    assert Counter((r.doc_id, r.component_id) for r in rows) == Counter(
        {(1, 1): 2, (3, 1): 1, (2, 2): 1, (4, 4): 1, (5, 5): 1, (None, None): 1, (7, 7): 2, (8, 8): 1, (9, 9): 1})
    assert similar_documents(no_docs).count() == 0
    kept = one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 4, 5, 7, 8, 9]


def test_components_of_paths_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (200, 199)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{100 + k: 100 for k in range(30)}, 199: 199, 200: 199}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_packing_of_keys_and_the_suffix_filter(rng):
    import numpy as np

    keys = np.unique(np.array([rng.getrandbits(52) for _ in range(1000)], np.uint64))
    assert (unpack(pack(keys)) == keys).all()
    for _ in range(200):
        x, y = (np.unique(np.array([rng.randrange(80) for _ in range(40)], np.uint64)) for _ in range(2))
        missing = len(x) + len(y) - 2 * len(np.intersect1d(x, y))
        assert may_overlap(x, y, missing)
