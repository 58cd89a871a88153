"""Embeddings of several lengths, and tables of copies."""

import numpy as np

from spectraloom.llm import embeddings


def found(spark, vectors):
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    return {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()}


def test_vectors_of_each_length_link(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(12, 32)), rng.normal(size=(6, 24))
    got = found(spark, [*a, *b, b[0], b[1] * 1.001 + 0.001, rng.normal(size=8)])
    assert got[18] == got[12] == (1, 12) and got[19] == got[13] == (1, 13) and got[20] == (0, 20)
    assert all(got[i] == (0, i) for i in (*range(12), 14, 15, 16, 17))


def test_a_table_of_copies(spark):
    assert found(spark, [[1, 2, 3, 4]] * 3) == {i: (2, 0) for i in range(3)}
