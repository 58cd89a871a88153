"""Steps that grew faster than their tables."""

import io
import re
from contextlib import redirect_stdout

import numpy as np
import pandas as pd
import pytest
from helpers import near, study
from pyspark.sql import functions as F

from spectraloom.functions.ranges import wide_median
from spectraloom.model import Assay, Study
from spectraloom.operators import batch, fdr, inference, multivariate, normalise
from spectraloom.sources import fasta


def plan(df):
    with redirect_stdout(io.StringIO()) as text:
        df.explain()
    return text.getvalue().lower()


@pytest.mark.parametrize("rate", [fdr.benjamini_hochberg, fdr.storey])
def test_adjusted_p_reads_no_frame_anew_for_each_row(spark, rate):
    n = 4000
    rows = spark.range(n).selectExpr("id", "((id * 7919) % 4000 + 1) / 4000.0D as p")
    out = rate(rows, "p", "id")
    # A frame up to the last row is summed up again for each row, so time would grow with the square of a range.
    assert "unboundedfollowing" not in plan(out)
    got = {r.id: r.q_value for r in out.collect()}
    share = min(1.0, (n - n // 2) / (0.5 * n)) if rate is fdr.storey else 1.0
    assert len(got) == n and all(near(q, share, 1e-12) for q in got.values())


def test_target_decoy_reads_no_frame_anew_for_each_row(spark):
    rows = spark.range(3000).selectExpr("id", "((id * 7919) % 3000) / 1.0D as PEP", "id % 3 = 0 as d")
    out = fdr.target_decoy(rows, "PEP", "d", "id")
    assert "unboundedfollowing" not in plan(out)
    low, want, t, d = 1.0, {}, 0, 0
    order = sorted((((i * 7919) % 3000, i % 3 == 0, i) for i in range(3000)))
    rates = []
    for _, decoy, _ in order:
        t, d = t + (not decoy), d + decoy
        rates.append(min(1.0, (d + 1) / t) if t else None)
    for (_, _, i), rate in zip(reversed(order), reversed(rates), strict=True):
        low = low if rate is None else min(low, rate)
        want[i] = None if rate is None else low
    assert all(near(r.q_value, want[r.id]) for r in out.collect())


def test_a_long_group_is_named_once(spark):
    """Of 3,000 proteins with the same peptides each had the sorted list of all made anew."""
    edges = spark.range(3000).selectExpr("concat('p', id) protein", "explode(array('a', 'b')) peptide").unionByName(spark.createDataFrame([("q1", "a"), ("q2", "c"), ("q3", "c")], "protein string, peptide string"))
    members, names = inference.same_peptides(edges)
    got = {r.id: r.group for r in names.collect()}
    assert got == {"p0,": ",".join(sorted(f"p{i}" for i in range(3000))), "q2,": "q2,q3"}
    assert members.count() == 3002 and members.join(names, "id").count() == 3002


def test_groups_go_by_ids_until_the_end(spark):
    """Proteins in a square share a peptide with their row and one with their column: one component, and none but Z has a peptide of its own."""
    m = 20
    n = m * m
    rows = [(f"r{k}", ";".join(f"P{k * m + i}" for i in range(m))) for k in range(m)] + [(f"c{k}", ";".join(f"P{k + i * m}" for i in range(m))) for k in range(m)]
    rows += [("own", "Z"), ("own2", "Z"), ("tie", f"Z;P{n // 2}"), ("e1", "E1;E2")]
    peptides, proteins = inference.infer(spark.createDataFrame(rows, "stripped_peptide string, proteins string"))
    whole = ",".join(sorted(f"P{i}" for i in range(n)))
    got = {r.initial_protein: (r.protein_group, r.indistinguishable, r.subsumable) for r in proteins.collect()}
    assert got.pop("Z") == ("Z", False, False) and got.pop("E1") == got.pop("E2") == ("E1,E2", True, False)
    assert len(got) == n and set(got.values()) == {(whole, False, True)}
    found = {r.peptide: r.protein_group for r in peptides.collect()}
    assert found["r7"] == whole and found["tie"] == f"{whole};Z" and found["e1"] == "E1,E2"
    merge = inference.subsumable(inference.edges_of(spark.createDataFrame(rows, "p string, q string"), "p", "q"))[0]
    assert merge.agg({"group": "max"}).first()[0].count(",") == 2  # an id, not the list of members


def test_wide_median(spark):
    """Equals the median of each group, with ties, signs, one value or none; no aggregate gathers a group's values."""
    rng = np.random.default_rng(5)
    groups = {"normal": rng.normal(size=5001), "ties": rng.integers(0, 3, 4000).astype(float), "half": np.r_[np.zeros(500), np.arange(1.0, 501)], "one": np.array([7.0]), "two": np.array([-1.0, 4.0])}
    rows = [(g, float(v)) for g, own in groups.items() for v in own] + [("none", None), ("one", None)]
    x = spark.createDataFrame(rows, "g string, value double").repartition(3)
    out = wide_median(x, "value", ("g",), "m")
    assert not re.search(r"[^e]\bmedian\(|percentile\(", plan(out))
    got = {r.g: r.m for r in out.collect()}
    assert got == {g: float(np.median(own)) for g, own in groups.items()}
    assert wide_median(x, "value", name="m").first().m == float(np.median(np.concatenate(list(groups.values()))))
    assert wide_median(x.where("g = 'none'"), "value", name="m").first().m is None


@pytest.mark.parametrize("fraction", [False, True])
def test_median_of_all_values_is_no_single_task(spark, fraction):
    s = study(spark, [[1.0, 2.0, None], [4.0, 8.0, 9.0]], [{"obs_id": "a"}, {"obs_id": "b"}], [{"var_id": f"v{i}", "filename": "f"} for i in (1, 2, 3)])
    out = normalise.normalise(s, "median", "psm", fraction=fraction)["psm"].x
    got = {(r.obs_id, r.var_id): r.value for r in out.collect()}
    assert got == {("a", "v1"): 3.5, ("a", "v2"): 4.5, ("b", "v1"): 0.0, ("b", "v2"): 4.0, ("b", "v3"): 5.0}
    assert "percentile_approx" in plan(out)


@pytest.mark.parametrize("method", ["spearman", "kendall"])
def test_rank_correlation_by_ranges(spark, method, monkeypatch):
    """A pair of samples is no longer one task's: with ranges from the first value on, r is that of whole pairs."""
    rng = np.random.default_rng(2)
    m = np.round(rng.normal(size=(3, 700)), 1)
    m[1] = np.round(m[0] + rng.normal(size=700), 1)
    here = rng.random((3, 700)) < 0.9
    x = spark.createDataFrame([(f"s{i}", f"v{j}", float(m[i, j])) for i, j in zip(*np.nonzero(here), strict=True)], "obs_id string, var_id string, value double")
    monkeypatch.setattr(multivariate, "MOST_VALUES", 0)
    assert multivariate._with_range(x, "value").select("_range").distinct().count() > 20
    got = {(r.obs_i, r.obs_j): r.r for r in multivariate.corr(x, method=method).collect()}
    assert len(got) == 9
    for i in range(3):
        for j in range(3):
            a, b = (pd.Series(m[k][here[i] & here[j]]) for k in (i, j))
            if method == "spearman":
                want = np.corrcoef(a.rank(), b.rank())[0, 1]
            else:
                s, t = (np.sign(v.to_numpy()[:, None] - v.to_numpy()) for v in (a, b))
                want = (s * t).sum() / np.sqrt((s**2).sum() * (t**2).sum())
            assert near(got[f"s{i}", f"s{j}"], want, 1e-9)


def test_trends_of_many_features_at_once(spark, monkeypatch):
    """Features of several sizes, cut over Arrow batches, get the fit that each has alone; no Python call for each feature."""
    rng = np.random.default_rng(4)
    rows = [(f"s{i}", f"v{j}", float(rng.normal()), i * j) for j in range(60) for i in range(9) if j < 2 or rng.random() < 0.7]
    rows += [("s0", "flat", 2.0, 0), ("s1", "flat", 2.0, 0), ("s2", "flat", None, 0)]
    x = spark.createDataFrame(rows, "obs_id string, var_id string, value double, more int")
    codes = spark.createDataFrame([(f"s{i}", i // 2) for i in range(9)], "obs_id string, code int")
    monkeypatch.setattr(batch, "MOST_WEIGHTS", 200)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        out = batch.by_lowess(x, codes)
        assert "flatmapgroups" not in plan(out)
        got = {(r.var_id, r.obs_id): (r.value, r.more) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    own = {}
    for o, v, value, more in rows:
        if value is not None:
            own.setdefault(v, []).append((int(o[1:]) // 2, o, value, more))
    assert len(got) == sum(map(len, own.values()))
    for v, values in own.items():
        c, o, y, more = zip(*sorted(values), strict=True)
        fit = batch.lowess(np.array(c, float), np.array(y))
        assert all(near(got[v, name][0], a - f, 1e-9) and got[v, name][1] == m for name, a, f, m in zip(o, y, fit, more, strict=True))


def test_fasta_categories_need_one_grouping(spark):
    """Groups and their members were put together by two groupings of all rows."""
    info = spark.createDataFrame([("P1", "g2", "m"), ("P2", "g1", None), ("P3", "g2", "h"), ("P4", None, "h")], "accession string, Gene string, Organism string")
    var = spark.createDataFrame([("P1,P2,P3;P3", ), ("P4;P1,P9", ), ("P9", ), ("P2;P2", )], "protein_group string").withColumn("var_id", F.col("protein_group"))
    s = Study({"protein": Assay(spark.createDataFrame([], "obs_id string, var_id string, value double"), var, None, "protein")}, spark.createDataFrame([], "obs_id string"), {"protein_info": info})
    out = fasta.map_fasta(s, "protein", ["Gene", "Organism"])["protein"].var
    assert {r.protein_group: (r.Gene, r.Organism) for r in out.collect()} == {"P1,P2,P3;P3": ("g1,g2;g2", "h,m;h"), "P4;P1,P9": (";g2", "h;m"), "P9": (None, None), "P2;P2": ("g1;g1", ";")}
    assert plan(out).count("collect_set") and "collect_list" not in plan(out)
