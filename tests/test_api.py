"""The public names, and a study taken from reading to testing through them."""

import pytest
from helpers import study

import spectraloom as sl


def test_names():
    for module in (sl.pp, sl.tl, sl.pl, sl.io, sl.utils):
        assert all(callable(getattr(module, n)) for n in module.__all__)
    assert sl.read_sage is sl.io.read_sage and sl.merge_studies is sl.utils.merge_studies
    with pytest.raises(NotImplementedError):
        sl.read_comet()
    with pytest.raises(AttributeError):
        sl.nothing


def test_from_psms_to_test(spark, tmp_path):
    path = tmp_path / "p.fasta"
    path.write_text(">sp|P1|A One OS=X OX=1 GN=g1\nAAAKCCCK\n>tr|P2|B Two OS=X OX=1\nCCCKDDDK\n")
    var = [{"var_id": f"v{i}", "peptide": p, "stripped_peptide": p, "proteins": q, "PEP": 0.01 * (i + 1), "filename": "f"} for i, (p, q) in enumerate([("AAAK", "P1"), ("AAAK", "P1"), ("CCCK", "P1;P2"), ("DDDK", "P2")])]
    decoy = [{"var_id": "d", "peptide": "RRRK", "stripped_peptide": "RRRK", "proteins": "rev_P9", "PEP": 0.5, "filename": "f"}]
    obs = [{"obs_id": f"s{i}", "group": "a" if i < 3 else "b"} for i in range(6)]
    s = study(spark, [[2.0 ** (i + j) for j in range(4)] for i in range(6)], obs, var, decoy=decoy, label="label_free")
    s = sl.utils.attach_fasta(sl.pp.log2_transform(s, "psm"), str(path))
    s = sl.pp.to_protein(sl.pp.infer_protein(sl.pp.to_peptide(sl.pp.normalise(s, "median_center", "psm"))))
    assert sorted(r.var_id for r in s["protein"].var.collect()) == ["P1", "P2"]
    s = sl.utils.select_repr_protein(s, "protein")
    assert {r.var_id: r.representative for r in s["protein"].var.collect()} == {"P1": "P1", "P2": "P2"}
    s = sl.tl.pca(sl.tl.corr(s, "peptide"), "peptide", n_components=2)
    assert {"X_corr", "X_pca", "PCs", "X_pca_variance"} <= set(s["peptide"].extra)
    out = sl.tl.run_de(s, "protein", "group", "a", "b", n_resamples=None, fdr="bh").table
    assert {r.features for r in out.collect()} == {"P1", "P2"}
    assert [e["function"] for e in s.log][:3] == ["log2_transform", "attach_fasta", "normalise"]
