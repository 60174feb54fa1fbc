from __future__ import annotations

import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from tillroll.llm import ngram_join, packing, workers


def resident() -> float:
    return int(Path("/proc/self/statm").read_text().split()[1]) * 4096 / 1e6


@pytest.mark.skipif(not workers._trim, reason="the C library has no such call")
def test_a_task_gives_its_memory_back():
    held = []

    @workers.lean
    def task(batches):
        arrays = [np.ones(6_000) for _ in range(4_000)]  # 192 MB in pieces that the allocator keeps
        held.append(arrays[-1])
        yield from batches

    workers.give_back()
    before = resident()
    assert list(task(iter([1, 2]))) == [1, 2]
    assert resident() - before < 60


def test_steps_of_the_pipeline_give_back_when_they_end(monkeypatch):
    seen = []
    monkeypatch.setattr(workers, "give_back", lambda: seen.append(1))
    assert not list(ngram_join.verified(iter([])))
    assert not list(ngram_join.local_copies_dropped(iter([])))
    parts = ngram_join.bucketed(0, np.arange(3, dtype=np.uint64), np.ones(3, np.uint32), 1)
    assert ngram_join.shared_keys(parts).num_rows == 0
    assert len(seen) == 3


@pytest.mark.parametrize("step", ["shingles", "tokens"])
def test_memory_of_a_step_does_not_follow_the_table(step):
    rng = np.random.default_rng(1)
    words = [f"word{i}" for i in range(500)]
    table = pa.table({"text": [" ".join(rng.choice(words, 500)) for _ in range(2_000)]})
    assert table.nbytes > 6 << 20
    encode = packing.Encoder(packing.public_tokenizer()).encode
    tracemalloc.start()
    try:
        if step == "shingles":
            assert sum(len(x) > 0 for x in ngram_join.sets_of(table)) == 2_000
        else:
            batch = table.to_batches()[0]
            for _, _, data, offsets in packing.chunks(*packing.texts(batch.column("text")), packing.SMALL_CHUNK_BYTES):
                encode(data.tobytes(), offsets)
        assert tracemalloc.get_traced_memory()[1] < 60e6
    finally:
        tracemalloc.stop()
