"""The class prior from positives and unlabelled rows, and rows that repeat or bring clashing columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraloom.llm import quality


@pytest.mark.parametrize("share", [0.3, 0.6, 0.9])
def test_prior_without_negatives(share):
    rng = np.random.default_rng(1)
    good = lambda n: rng.normal(1.5, 1, (n, 3))
    n = 4000
    unlabelled = np.concatenate([good(int(n * share)), rng.normal(-1.5, 1, (n - int(n * share), 3))])
    found = quality.class_prior(good(n), rng.permutation(unlabelled))
    assert share - 0.08 < found < share + 0.03


def test_prior_of_little():
    assert quality.class_prior(np.zeros((0, 2)), np.zeros((5, 2))) == 0.5


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "Some plain words here.", 0.1), (1, "Some plain words here.", 0.1), (None, None, None), (2, "", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double").withColumns({"kind": F.lit("k"), "x": F.lit(1)})
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    scored = quality.scored(docs, quality.fit(docs, labels)).collect()
    assert sorted(str(r.doc_id) for r in scored) == ["1", "1", "2", "None"]
    assert all(0 <= r.score <= 1 for r in scored) and len({r.score for r in scored if r.doc_id == 1}) == 1
