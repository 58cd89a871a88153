"""Memory that a worker takes to encode texts, whatever the size of the batches that it gets."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from spectraloom.llm import tokens
from spectraloom.llm.queries import tokenizer_path


@pytest.mark.parametrize("batch_rows", [1, 100])
def test_encoding_takes_memory_for_a_few_megabytes_of_text(batch_rows):
    """24 MB of text in batches of 0.25 and of 24 MB: all rows and ids come out, a slice at a time."""
    text = "one two three four five six seven eight nine ten " * 5_100
    n, end_id = 96, 2
    whole = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(n), pa.int64()), "text": [text] * n})
    batches = [whole.slice(i, batch_rows) for i in range(0, n, batch_rows)]
    path = tokenizer_path()
    ids = np.append(tokens.WordTokenizer(path).encode(pa.array([text]))[1], end_id)
    tokens.worker_tokenizer(path)
    rows = 0
    tracemalloc.start()
    try:
        for batch, offsets, found in tokens.encoded(iter(batches), "text", path, end_id):
            assert batch.column("doc_id").to_pylist() == list(range(rows, rows + batch.num_rows))
            assert (np.diff(offsets) == len(ids)).all() and (found.reshape(-1, len(ids)) == ids).all()
            rows += batch.num_rows
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == n
    assert peak < 100 << 20, peak
