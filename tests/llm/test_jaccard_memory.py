"""What reading a block of documents as sets of shingles holds at once."""

import random
import tracemalloc
from types import SimpleNamespace

import pyarrow as pa

from briefmill.llm import jaccard_join


def test_a_block_holds_few_arrays_of_its_words(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randint(0, 5000)}" for _ in range(400)) for _ in range(4000)]
    monkeypatch.setattr(jaccard_join, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    size = sum(map(len, texts))
    tracemalloc.start()
    try:
        made = [b.num_rows for b in jaccard_join._blocks(2, 5)(iter([batch]))]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert made == [3] and peak < 10 * size
