"""A cluster of near copies gives the same links however its buckets and parts are cut, in rows that grow with vectors."""

import numpy as np

from spectraloom.llm import embeddings


def cluster(spark, others=60):
    rng = np.random.default_rng(11)
    near = rng.normal(size=64) + rng.normal(scale=0.2, size=(180, 64))
    rows = [*near, *rng.normal(size=(others, 64)), *near[:4]]
    return np.array(rows), spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "vec_id long, embedding array<double>")


def test_cells_and_tiles_lose_no_link(spark):
    x, df = cluster(spark)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = unit @ unit.T >= 0.9
    n_links = links.sum(axis=1) - 1
    assert n_links.max() > 150
    seen = []
    for block in (2_048, 16):
        got = {r.vec_id: r for r in embeddings.near_duplicates(df, block=block).collect()}
        assert all(got[i].n_links <= n for i, n in enumerate(n_links.tolist())) and sum(r.n_links for r in got.values()) >= 0.95 * n_links.sum()
        seen.append([got[i].n_links for i in range(len(x))])
        assert all(got[i].component_id == (0 if n_links[i] else i) for i in range(len(x)))
    assert seen[0] == seen[1]


def test_codes_of_a_table_that_is_mostly_one_cluster():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=64) + rng.normal(scale=0.25, size=(900, 64)), rng.normal(size=(300, 64))])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(unit @ unit.T >= 0.9, 1))
    code = embeddings.codes_of(unit, *embeddings.fitted(unit, 64, 0.9, embeddings.REACH, embeddings.TABLES))
    assert len(i) > 100_000 and embeddings.met(code[i], code[j], 64, embeddings.REACH, embeddings.TABLES).mean() >= 0.95
    about_mean = embeddings.codes_of(unit, *embeddings.rotation(unit, 64))
    assert embeddings.met(about_mean[i], about_mean[j], 64, embeddings.REACH, embeddings.TABLES).mean() < 0.7


def test_rows_grow_with_vectors(spark):
    _, df = cluster(spark)
    assert embeddings.linked(df)[2].count() <= 180


def test_forest():
    u, v = np.array([5, 3, 7, 1, 8]), np.array([3, 2, 6, 1, 7])
    assert embeddings.forest(u, v, 10).tolist() == [0, 1, 2, 2, 4, 2, 6, 6, 6, 9]
    line = np.arange(999)
    assert not embeddings.forest(line, line + 1, 1000).any()
