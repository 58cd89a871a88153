"""The fit of the toxicity model at its full sample, its curve, and the linear scan."""

import os
import time

import numpy as np
import pytest

from spectraloom.llm import queries, toxicity

LARGE = "/root/testdata/check_l"


@pytest.mark.skipif(not os.path.isdir(LARGE), reason="needs the large driver tables")
def test_full_sample_of_labels_is_learned(spark):
    model = toxicity.fit(queries.table(spark, LARGE, "documents"), queries.table(spark, LARGE, "labels"))
    toxic, caught = model.learned
    assert toxic > 1_000 and caught >= 0.9 * toxic


def test_curve_converges_on_separable_evidence():
    rng = np.random.default_rng(5)
    for trial in range(300):
        n, toxic = int(rng.integers(200, 20_000)), rng.uniform(0.02, 0.3)
        y = (rng.random(n) < toxic).astype(float)
        x = np.where(y == 1, rng.normal(rng.uniform(2, 9), 0.8, n), np.where(rng.random(n) < 0.02, rng.normal(1.5, 0.5, n), 0)).clip(0)
        a, b = toxicity._logistic(x, y)
        caught = (a + b * x >= 0) & (y == 1)
        assert b > 0 and caught.sum() >= 0.8 * y.sum(), trial


def test_a_model_that_finds_nothing_is_refused(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError, match="would let toxic documents pass"):
        toxicity.clean(docs, toxicity.Model(learned=(1000, 100)))
    assert toxicity.clean(docs, toxicity.Model(curve=(-3.0, 0.0), learned=(10, 0))).count() == 1


def test_clean_keeps_ties_and_clashing_columns(spark):
    rows = [(1, "same words", "x", 1), (1, "same words", "x", 1), (None, None, None, None), (2, "", "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, c1 int")
    kept = toxicity.clean(docs, toxicity.Model(curve=(-3.0, 0.0)))
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))


def test_scan_is_linear():
    falling = lambda n: np.where(np.arange(n) % 2 == 0, np.linspace(1, 0.1, n), -1.5)

    began = time.process_time()
    toxicity.segments(falling(60_000))
    toxicity.segments(np.where(np.arange(60_000) % 2 == 0, 1.0, -1.001))
    assert time.process_time() - began < 0.5
