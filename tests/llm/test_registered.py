"""Registered queries without SQL, run whole on the smallest tables against brute force."""

import zlib

import numpy as np
import pytest

from spectraloom.llm import queries
from tests.llm.test_text_operators import check_packing, fingerprint, ids_of, least_reachable, tokenizer  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return queries.table(spark, SF, "documents").collect()


def test_op2(spark, documents, tokenizer):  # noqa: F811
    want, at = [], 0
    for d in sorted(documents, key=lambda d: d.doc_id):
        ids = ids_of(tokenizer, d.text, 2)
        want.append((d.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = queries.op2_token_store(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want


def test_op3(spark, documents, tokenizer):  # noqa: F811
    rows = queries.op3_packing(spark, SF).collect()
    sequences = check_packing(rows, documents, tokenizer, 4096)
    assert sequences <= 1.01 * -(-sum(r.length for r in rows) // 4096) + 1


def test_op4(spark, documents):
    got = {r.doc_id: r for r in queries.op4_simhash(spark, SF).collect()}
    prints = {d.doc_id: fingerprint(d.text, 3) for d in documents}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{x:016x}" for i, x in prints.items()}
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    assert {i: r.component_id for i, r in got.items()} == least_reachable(prints, near)
