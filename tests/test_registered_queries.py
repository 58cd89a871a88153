"""Registered queries without SQL, against brute force over the same tables."""

import numpy as np
import pyarrow.parquet as pq

from spectraloom.plans import registry

SF = "/root/testdata/sf0.001"


def lines(*columns):
    return pq.read_table(f"{SF}/lineitem.parquet", columns=list(columns)).to_pandas()


def test_pca_scores(spark):
    registry.load()
    rows = lines("l_partkey", "l_returnflag", "l_linestatus", "l_extendedprice")
    rows["obs"] = rows.l_returnflag + rows.l_linestatus
    wide = rows.groupby(["obs", "l_partkey"]).l_extendedprice.mean().unstack().dropna(axis=1)
    x = wide.to_numpy(float)
    u, s, axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    got = registry.QUERIES["pca_scores"](spark, SF).toPandas().set_index("obs_id").loc[wide.index]
    columns = [c for c in got.columns if c.startswith("PC_")]
    assert len(columns) == len(wide) - 1 and x.shape[1] > 5
    sign = np.sign(axes[np.arange(len(s)), np.abs(axes).argmax(axis=1)])
    want = (u * s * sign)[:, : len(columns)]
    assert np.allclose(got[columns].to_numpy(), want, atol=0.01)


def test_protein_subsets(spark):
    registry.load()
    sets = lines("l_partkey", "l_orderkey").groupby("l_orderkey").l_partkey.agg(frozenset)
    named = {}
    for protein, own in sorted(sets.items()):
        named.setdefault(own, str(protein))
    inside = {(p, c) for a, p in named.items() for b, c in named.items() if b < a}
    children = {c for _, c in inside}
    want = {}
    for p, c in inside:
        if p not in children:
            want[c] = max(want.get(c, ""), p)
    got = {r.protein: r.group for r in registry.QUERIES["protein_subsets"](spark, SF).collect()}
    assert got == want and want
