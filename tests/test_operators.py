"""Filters, roll-up, normalisation, batch correction and multivariate operators on small matrices."""

import numpy as np
import pytest
from helpers import near, study, values
from pyspark.sql import functions as F

from spectraloom.model import load, save
from spectraloom.operators import batch, filters, merge, multivariate, normalise, qc, rollup

OBS = [{"obs_id": f"s{i + 1}", "group": "A" if i < 2 else "B", "batch": "x" if i % 2 == 0 else "y"} for i in range(4)]
M = [[1, 2, None], [2, 3, 4], [None, 1, 2], [3, None, 5]]


def test_filters_and_decoys(spark):
    var = [{"var_id": f"v{i}", "score": s} for i, s in enumerate((10.0, 20.0, 30.0))]
    decoy = [{"var_id": f"d{i}", "score": s} for i, s in enumerate((5.0, 25.0, 30.0))]
    s = study(spark, [[1, 2, 3], [2, 3, 4]], OBS[:2], var, decoy=decoy)
    s = filters.add_filter(filters.add_filter(s, "psm", "score", "gt", 15), "psm", "score", "lt", 30)
    assert filters.filter_columns(s["psm"]).columns == ["var_id", "score_gt_15", "score_lt_30"]
    out = filters.apply_filter(s, "psm")
    assert [r.var_id for r in out["psm"].var.collect()] == ["v1"] and [r.var_id for r in out["psm"].decoy.collect()] == ["d1"]
    assert values(out["psm"].x) == {("s1", "v1"): 2.0, ("s2", "v1"): 3.0}
    assert [e["function"] for e in out.log] == ["add_filter", "add_filter", "apply_filter"]
    with pytest.raises(ValueError):
        filters.apply_filter(out, "psm")
    with pytest.raises(ValueError):
        filters.predicate("score", "like", 1)


def test_predicates_on_missing(spark):
    df = spark.createDataFrame([("ab",), (None,)], "c string")
    got = {k: [r[0] for r in df.select(filters.predicate("c", k, "a.")).collect()] for k in ("eq", "ne", "contains", "not_contains")}
    assert got == {"eq": [False, False], "ne": [True, True], "contains": [True, False], "not_contains": [False, False]}


def test_ranks_and_top_n(spark):
    var = [{"var_id": "a", "peptide": "p1"}, {"var_id": "b", "peptide": "p1"}, {"var_id": "c", "peptide": "p1"}, {"var_id": "d", "peptide": "p2"}]
    s = study(spark, [[5, 5, 1, 2], [5, 5, 1, None]], OBS[:2], var)["psm"]
    ranks = {r.var_id: r.rank for r in rollup.feature_ranks(s.x, s.var, "peptide", "total_intensity").collect()}
    assert ranks == {"a": 1.5, "b": 1.5, "c": 3.0, "d": 1.0}
    assert {v for _, v in values(rollup.top_features(s.x, s.var, "peptide", 1, "total_intensity"))} == {"d"}


def test_to_peptide_and_purity(spark):
    var = [{"var_id": f"v{i}", "peptide": p, "proteins": f"P{i}", "stripped_peptide": p.upper(), "PEP": e, "purity": u} for i, (p, e, u) in enumerate([("p1", 0.1, 0.9), ("p1", 0.01, 0.5), ("p2", 0.2, 0.8)])]
    decoy = [{"var_id": "d", "peptide": "r1", "proteins": "rev_P", "stripped_peptide": "R", "PEP": 0.15, "purity": 0.9}]
    s = study(spark, [[1, 9, 3], [2, 9, 4]], OBS[:2], var, decoy=decoy, label="tmt")
    out = rollup.to_peptide(s)["peptide"]
    rows = {r.peptide: r for r in out.var.collect()}
    assert rows["p1"].count_psm == 2 and rows["p1"].PEP == 0.01 and rows["p1"].proteins == "P0"
    assert values(out.x) == {("s1", "p1"): 1.0, ("s1", "p2"): 3.0, ("s2", "p1"): 2.0, ("s2", "p2"): 4.0}
    assert near(rows["p1"].q_value, 1.0) and out.decoy.count() == 1


def test_sum_of_nothing(spark):
    s = study(spark, [[1, None], [None, None]], OBS[:2], [{"var_id": "a", "g": "x"}, {"var_id": "b", "g": "y"}])["psm"]
    x = rollup.values_by_group(s.x.join(s.var, "var_id"), "g", "sum")
    assert x.count() == 1
    zero = rollup.with_missing_as_zero(x, "g", s.var, spark.createDataFrame([("s1",), ("s2",)], "obs_id string"))
    assert sorted(r.value for r in zero.collect()) == [0.0, 0.0, 0.0, 1.0]


def test_median_and_centre(spark):
    x = study(spark, M, OBS)["psm"].x
    a = np.array([[np.nan if v is None else v for v in r] for r in M], float)
    want = a - np.nanmedian(a, axis=1, keepdims=True)
    got, moved = values(normalise.median_center(x)), values(normalise.median(x))
    for (i, j), v in np.ndenumerate(want):
        if not np.isnan(v):
            assert near(got[f"s{i + 1}", f"v{j + 1}"], v) and near(moved[f"s{i + 1}", f"v{j + 1}"], v + np.nanmedian(a))


def quantile_by_hand(a):
    """a: features x samples. Stretch, average, take back by mean ranks."""
    n = len(a)
    columns = [np.sort(c[~np.isnan(c)]) for c in a.T]
    grid = np.mean([np.interp(np.linspace(0, len(c) - 1, n), np.arange(len(c)), c) for c in columns], axis=0)
    out = np.full_like(a, np.nan)
    for k, c in enumerate(columns):
        for i in range(n):
            if not np.isnan(a[i, k]):
                rank = (np.sum(c < a[i, k]) + 1 + np.sum(c <= a[i, k])) / 2
                out[i, k] = np.interp((n - 1) * (rank - 1) / (len(c) - 1), np.arange(n), grid)
    return out


def test_quantile(spark):
    rng = np.random.default_rng(5)
    a = np.round(rng.normal(size=(23, 5)), 1)
    a[rng.random(a.shape) < 0.2] = np.nan
    obs = [{"obs_id": f"s{k}"} for k in range(5)]
    s = study(spark, [[None if np.isnan(v) else v for v in c] for c in a.T], obs, [{"var_id": f"v{i}"} for i in range(23)])
    got, want = values(normalise.normalise(s, "quantile", "psm")["psm"].x), quantile_by_hand(a)
    assert len(got) == np.sum(~np.isnan(a))
    assert all(near(v, want[int(f[1:]), int(o[1:])], 1e-9) for (o, f), v in got.items())


def test_log2_scale_and_errors(spark):
    s = study(spark, [[0, 8], [4, -1]], OBS[:2])
    got = values(normalise.log2_transform(s, "psm")["psm"].x)
    assert got == {("s1", "v1"): None, ("s1", "v2"): 3.0, ("s2", "v1"): 2.0, ("s2", "v2"): None}
    scaled = values(normalise.scale_data(study(spark, [[1, 7], [3, 7]], OBS[:2]), "psm")["psm"].x)
    assert near(scaled["s1", "v1"], -1.0) and scaled["s1", "v2"] is None
    with pytest.raises(NotImplementedError):
        normalise.normalise(s, "total_sum", "psm")
    with pytest.raises(ValueError):
        normalise.normalise(s, "other", "psm")


def test_ridge_against_numpy(spark):
    rng = np.random.default_rng(2)
    p = rng.normal(size=6)
    y = 2 * p + rng.normal(size=6)
    site = spark.createDataFrame([("P", f"s{i}", "site", float(v)) for i, v in enumerate(y)], "protein_group string, obs_id string, var_id string, value double")
    prot = spark.createDataFrame([("P", f"s{i}", float(v)) for i, v in enumerate(p)], "protein_group string, obs_id string, value double")
    b = ((p - p.mean()) @ (y - y.mean())) / (((p - p.mean()) ** 2).sum() + 100)
    got = values(normalise.ridge_adjusted(site, prot))
    assert all(near(got[f"s{i}", "site"], y[i] - y.mean() - b * (p[i] - p.mean())) for i in range(6))
    assert normalise.ridge_adjusted(site.where("obs_id in ('s0', 's1')"), prot).count() == 0


SIX = [{"obs_id": o, "batch": b, "order": i} for i, (o, b) in enumerate((("s1", "b1"), ("s2", "b1"), ("gis1", "b1"), ("s3", "b2"), ("s4", "b2"), ("gis2", "b2")))]
SIX_M = [[1, 2], [3, 4], [6, 6], [7, 8], [9, 10], [11, 12]]


def test_gis_and_batch_median(spark):
    s = study(spark, SIX_M, SIX)
    out = batch.correct_batch_effect(s, "psm", "gis", "batch", gis_samples=["gis1", "gis2"], rescale=False)
    assert values(out["psm"].x) == {(o, f"v{j + 1}"): float(SIX_M[i][j] - SIX_M[2 if i < 3 else 5][j]) for i, o in ((0, "s1"), (1, "s2"), (3, "s3"), (4, "s4")) for j in range(2)}
    assert out.obs.count() == 4
    a = np.array(SIX_M, float)
    centred = np.concatenate([a[:3] - np.median(a[:3], 0), a[3:] - np.median(a[3:], 0)]) + np.median(a)
    got = values(batch.correct_batch_effect(s, "psm", "median_center", "batch")["psm"].x)
    assert all(near(got[o["obs_id"], f"v{j + 1}"], centred[i, j]) for i, o in enumerate(SIX) for j in range(2))
    with pytest.raises(ValueError):
        batch.correct_batch_effect(s, "psm", "gis", "batch", gis_samples=["nobody"])
    with pytest.raises(ValueError):
        batch.correct_batch_effect(s, "psm", "magic", "batch")


def combat_by_hand(m, groups):
    """The published steps over a dense matrix, samples x features."""
    grand = m.mean(0)
    fitted = np.concatenate([np.repeat(m[g].mean(0)[None], len(g), 0) for g in groups])
    sd = np.sqrt(((m[np.concatenate(groups)] - fitted) ** 2).mean(0))
    z = (m - grand) / sd
    out = np.empty_like(m)
    for g in groups:
        n, gamma, delta = len(g), z[g].mean(0), z[g].var(0, ddof=1)
        g0, t2, mean, s2 = gamma.mean(), gamma.var(ddof=1), delta.mean(), delta.var(ddof=1)
        a, b = (2 * s2 + mean**2) / s2, (mean * s2 + mean**3) / s2
        for j in range(m.shape[1]):
            x, y = gamma[j], delta[j]
            for _ in range(500):
                x2 = (t2 * n * gamma[j] + y * g0) / (t2 * n + y)
                y2 = (0.5 * ((z[g, j] - x2) ** 2).sum() + b) / (n / 2 + a - 1)
                x, y = x2, y2
            out[g, j] = (z[g, j] - x) / np.sqrt(y) * sd[j] + grand[j]
    return out


def test_combat(spark):
    rng = np.random.default_rng(8)
    m = rng.normal(size=(12, 40)) + rng.normal(size=40) * 3
    m[6:] += 5
    obs = [{"obs_id": f"s{i}", "batch": "a" if i < 6 else "b"} for i in range(12)]
    got = values(batch.correct_batch_effect(study(spark, m.tolist(), obs), "psm", "combat", "batch")["psm"].x)
    want = combat_by_hand(m, [np.arange(6), np.arange(6, 12)])
    after = np.array([[got[f"s{i}", f"v{j + 1}"] for j in range(40)] for i in range(12)])
    assert np.abs(after - want).max() < 1e-2  # the iteration stops at a relative change of 1e-4
    assert abs(after[:6].mean() - after[6:].mean()) < 0.1


def test_lowess_follows_a_line():
    x = np.arange(20.0)
    assert np.allclose(batch.lowess(x, 3 * x + 1), 3 * x + 1)
    y = np.sin(x / 4)
    y[10] = 50  # an outlier gets no weight
    assert np.abs(batch.lowess(x, y, 0.4) - np.sin(x / 4))[np.arange(20) != 10].max() < 0.3


def test_continuous(spark):
    obs = [{"obs_id": f"s{i}", "order": i} for i in range(8)]
    s = study(spark, [[2.0 * i, None if i == 3 else 1.0] for i in range(8)], obs)
    got = values(batch.correct_batch_effect(s, "psm", "continuous", "order", rescale=False)["psm"].x)
    assert len(got) == 15 and all(abs(v) < 1e-9 for v in got.values())


def test_correlation(spark):
    rng = np.random.default_rng(4)
    m = np.round(rng.normal(size=(3, 15)), 1)
    x = study(spark, [[None if (i, j) == (0, 2) else v for j, v in enumerate(r)] for i, r in enumerate(m)], OBS[:3])["psm"].x
    keep = [j for j in range(15) if j != 2]
    r = {(c.obs_i, c.obs_j): c.r for c in multivariate.corr(x).collect()}
    assert near(r["s1", "s2"], np.corrcoef(m[0, keep], m[1, keep])[0, 1]) and near(r["s2", "s3"], np.corrcoef(m[1], m[2])[0, 1]) and near(r["s3", "s2"], r["s2", "s3"])
    rank = lambda v: np.array([(np.sum(v < a) + 1 + np.sum(v <= a)) / 2 for a in v])
    s = {(c.obs_i, c.obs_j): c.r for c in multivariate.corr(x, method="spearman").collect()}
    assert near(s["s1", "s2"], np.corrcoef(rank(m[0, keep]), rank(m[1, keep]))[0, 1])
    a, b = m[1], m[2]
    sign = [(np.sign(a[i] - a[j]), np.sign(b[i] - b[j])) for i in range(15) for j in range(i)]
    tau = sum(p * q for p, q in sign) / np.sqrt(sum(p != 0 for p, _ in sign) * sum(q != 0 for _, q in sign))
    k = {(c.obs_i, c.obs_j): c.r for c in multivariate.corr(x, method="kendall").collect()}
    assert near(k["s2", "s3"], tau)
    with pytest.raises(ValueError):
        multivariate.corr(x, method="other")


def test_pca_against_svd(spark):
    rng = np.random.default_rng(6)
    m = rng.normal(size=(5, 30))
    rows = [[None if (i, j) == (1, 29) else v for j, v in enumerate(r)] for i, r in enumerate(m)]
    out = multivariate.pca(study(spark, rows, [{"obs_id": f"s{i}"} for i in range(5)])["psm"].x, n_components=3)
    a = m[:, :29] - m[:, :29].mean(0)
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(out["variance"], s[:3] ** 2 / 4) and np.allclose(out["variance_ratio"], s[:3] ** 2 / (s**2).sum())
    scores = np.array([list(r)[1:] for r in out["scores"].orderBy("obs_id").collect()], float)
    assert np.allclose(np.abs(scores), np.abs(u[:, :3] * s[:3]))
    loads = {r.var_id: r.PC_1 for r in out["loadings"].collect()}
    assert len(loads) == 29 and max(loads.values(), key=abs) > 0
    assert np.allclose(np.abs([loads[f"v{j + 1}"] for j in range(29)]), np.abs(vt[0]))


def test_umap_shape(spark):
    m = np.random.default_rng(0).normal(size=(8, 10))
    out = multivariate.umap(study(spark, m.tolist(), [{"obs_id": f"s{i}"} for i in range(8)])["psm"].x, n_neighbors=3)
    assert out.count() == 8 and out.columns == ["obs_id", "UMAP_1", "UMAP_2"]


def test_merge_subset_and_split(spark):
    parts = {}
    for k in ("one", "two"):
        obs = [{"obs_id": f"{k}_s{i}", "g": k} for i in range(2)]
        parts[k] = study(spark, [[1, 2], [3, 4]], obs, [{"var_id": "a", "note": k}, {"var_id": "b", "note": None if k == "one" else k}], label="tmt")
    out = merge.merge_studies(parts)
    assert out.obs.count() == 4 and out["psm"].x.count() == 8
    assert {r.var_id: r.note for r in out["psm"].var.collect()} == {"a": "one", "b": "two"}
    assert filters.subset(out, cond_obs="dataset = 'one'")["psm"].x.count() == 4
    assert out.label() == "tmt" and filters.subset(out, "psm", cond_var="note = 'two'")["psm"].x.count() == 4
    s = study(spark, [[1, 2], [3, 4]], [{"obs_id": "126"}, {"obs_id": "127"}], [{"var_id": "a", "filename": "f1"}, {"var_id": "b", "filename": "f2"}])
    cut = filters.split_sets(s, {"f1": "A", "f2": "B"})
    assert values(cut["psm"].x) == {("126_A", "a"): 1.0, ("126_B", "b"): 2.0, ("127_A", "a"): 3.0, ("127_B", "b"): 4.0} and cut.obs.count() == 4
    with pytest.raises(ValueError):
        merge.add_modality(s, "new", s["psm"], [])


def test_save_and_load(spark, tmp_path):
    s = filters.subset(study(spark, M, OBS, label="tmt", engine="sage"), cond_obs="group = 'A'")
    save(s, str(tmp_path / "study"))
    back = load(spark, str(tmp_path / "study"))
    assert values(back["psm"].x) == values(s["psm"].x) and back["psm"].label == "tmt" and back.log[0]["function"] == "subset"


def test_qc_tables(spark):
    s = study(spark, M, OBS)
    x, var, obs = s["psm"].x, s["psm"].var, s.obs
    assert {r.group: r.n for r in qc.id_counts(x, obs, "group").collect()} == {"A": 3, "B": 3}
    h = qc.histogram(spark.createDataFrame([(v,) for v in (0.0, 1.0, 2.0, 4.0)], "v double"), "v", 4).orderBy("bin").collect()
    assert [r.n for r in h] == [2, 1, 0, 1] and [r.frequency for r in h] == [50.0, 25.0, 0.0, 25.0]
    miss = {r.missing: (r.n, r.cumulative) for r in qc.missingness(x, var, 4).collect()}
    assert miss == {0: (0, 0), 1: (3, 3), 4: (0, 3)}
    assert {r.pattern: r.n for r in qc.upset(x, obs, "group", ["A", "B"]).collect()} == {"11": 3}
    assert qc.plot_type(spark.range(30).select(F.col("id").alias("a")), "a") == "box" and qc.plot_type(spark.range(5).select(F.col("id").alias("a")), "a") == "stack"
    b = qc.intensity_box(x, obs, "group").where("group = 'A'").first()
    assert b["count"] == 5 and b["median"] == 2.0 and b.lower_fence >= b["min"]
