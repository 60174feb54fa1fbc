from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np

from helpers import SMALL
from tillroll.llm.hashing import texts
from tillroll.llm.packing import op10_best_fit_packing, packed, patterns, public_tokenizer
from tillroll.llm.tokenize import Encoder, tokenizer


def by_hand(docs, capacity=1024):
    out = []
    for doc_id, text in docs:
        ids = np.array([*tokenizer(public_tokenizer()).encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        out += [(doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return sorted(out, key=str)


def check(rows, docs, capacity=1024):
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == by_hand(docs, capacity)
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_all_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows = op10_best_fit_packing(spark, SMALL).collect()
    bins = check(rows, docs)
    assert bins <= 1.03 * -(-sum(r.length for r in rows) // 1024)


def test_edges(spark, odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    rows = packed(odd_docs, public_tokenizer()).collect()
    check(rows, docs)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    assert packed(no_docs, public_tokenizer()).count() == 0


def test_pieces_like_the_library(rng):
    encoder = Encoder(public_tokenizer())
    letters = "ab's 'tre'll 'd  \n\t\n é1²½٣,.!?''    x'm'veLS中😀́ \xa0"
    rows = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["", " ", "a", "<|endoftext|>"]
    import pyarrow as pa

    data, offsets = texts(pa.array(rows))
    ids, before = encoder.encode(data.tobytes(), offsets)
    for i, found in enumerate(encoder.library.encode_batch(rows, add_special_tokens=False)):
        assert ids[before[i] : before[i + 1]].tolist() == found.ids


def test_patterns_use_all_pieces_and_replace_the_smallest():
    counts = {6: 1, 3: 1, 2: 2}
    plan = patterns(counts, 10)
    used = defaultdict(int)
    for lengths, bins in plan:
        assert sum(lengths) <= 10
        for x in lengths:
            used[x] += bins
    assert used == counts
    # 6 + 3 leaves a gap of 1; 2 + 2 fills it in place of the 3.
    assert ([6, 2, 2], 1) in plan
    many = patterns({n: 10**9 + n for n in range(1, 1025)})
    assert len(many) <= 4096 and sum(b for _, b in many) * 1024 < 1.001 * sum(n * (10**9 + n) for n in range(1, 1025)) + 10**6
