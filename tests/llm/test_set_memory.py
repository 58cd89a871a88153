"""Shingle sets are made of a few megabytes of text at a time, whatever the size of the batches that a worker gets."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from xxhash import xxh64_intdigest

from spectraloom.llm import jaccard, simhash


def test_sets_come_from_a_few_megabytes_of_text():
    """One batch of 12 MB: every row's whole set comes out, of 4 MB of text at once."""
    n = 12
    texts = [" ".join(f"{(i * 131 + k * 7919) % 9_973:04d}" for k in range(200_000)) for i in range(n)]
    whole = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(n), pa.int64()), "text": texts})
    made = list(jaccard._sets(5, simhash._hashes, simhash.majority)(iter([whole])))
    want = np.unique(np.array(simhash._hashes(texts[-1].encode(), 5, xxh64_intdigest), "<u8")).tobytes()
    assert [x for batch in made for x in batch.column("doc_id").to_pylist()] == list(range(n))
    assert made[-1].column("set")[-1].as_py() == want
    sizes = pc.binary_length(whole.column("text")).to_pylist()
    assert max(sum(sizes[i] for i in batch.column("doc_id").to_pylist()) for batch in made) <= 4 << 20
