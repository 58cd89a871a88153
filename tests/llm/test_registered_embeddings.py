"""The registered query of embeddings on a table that has links, against its SQL."""

import numpy as np

from spectraloom.llm import embeddings, queries
from tests.llm.test_models_and_mixes import same_as_sql


def test_op7_on_near_copies(spark, tmp_path):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(120, 64))
    copies = [base[rng.integers(0, 120, 150)] + rng.normal(scale=s, size=(150, 64)) for s in (0.05, 0.2, 0.3)]
    rows = np.concatenate([base, *copies, base[:5]]).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(rows)], "vec_id long, embedding array<float>, label int")
    (tmp_path / "in").mkdir()
    df.write.parquet(str(tmp_path / "in" / "embeddings.parquet"))
    got = queries.op7_embeddings(spark, str(tmp_path / "in"))
    assert got.where("n_links > 0").count() > 300
    same_as_sql(spark, got, embeddings.SQL, tmp_path, embeddings=df)
