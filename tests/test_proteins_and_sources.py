"""Protein inference against a dense brute force, sites, FASTA, readers, exports, mzML and streaming."""

import base64
import random
import time

import numpy as np
import pytest
from helpers import study, values
from pyspark.sql import functions as F

from spectraloom.functions import labels
from spectraloom.functions import peptide as pep
from spectraloom.model import Study
from spectraloom.operators import inference, ptm, rollup
from spectraloom.sources import export, fasta, mzml, readers, tables
from spectraloom.streaming import ingest


def brute_inference(edges):
    """edges: {(peptide, protein)}. Returns peptide_map and protein_map as the operators should, by dense set comparisons."""
    of = {}
    for p, q in edges:
        of.setdefault(q, set()).add(p)
    start = dict(of)
    by_set = {}
    for q in sorted(of):
        by_set.setdefault(frozenset(of[q]), []).append(q)
    same = {q: ",".join(m) for m in by_set.values() if len(m) > 1 for q in m}
    of = {",".join(m): set(s) for s, m in by_set.items()}
    parents = {c: [p for p in of if of[c] < of[p]] for c in of}
    within = {c: max(p for p in ps if not parents[p]) for c, ps in parents.items() if ps}
    of = {q: s for q, s in of.items() if q not in within}
    owners = {}
    for q, s in of.items():
        for p in s:
            owners.setdefault(p, set()).add(q)
    candidates = {q for q, s in of.items() if all(len(owners[p]) > 1 for p in s)}
    seen, merge, drop = set(), {}, set()
    for q in of:
        if q in seen:
            continue
        component, todo = set(), [q]
        while todo:
            at = todo.pop()
            if at not in component:
                component.add(at)
                todo += [o for p in of[at] for o in owners[p]]
        seen |= component
        own = component & candidates
        if own:
            together = set().union(*(of[c] for c in own))
            others = set().union(*(of[c] for c in component - own)) if component - own else set()
            if together - others:
                merge |= {c: ",".join(sorted(own)) for c in own}
            else:
                drop |= own
    pm, groups = {}, {}
    for q in start:
        a = same.get(q, q)
        b = within.get(a, a)
        if b not in drop:
            pm[q] = (merge.get(b, b), q in same, a in within, b in merge)
            for p in start[q]:
                groups.setdefault(p, {}).setdefault(pm[q][0], q)
                groups[p][pm[q][0]] = min(groups[p][pm[q][0]], q)
    return {p: ";".join(sorted(g, key=lambda x: g[x])) for p, g in groups.items()}, pm


@pytest.mark.parametrize("seed", range(4))
def test_inference(spark, seed):
    rng = random.Random(seed)
    edges = {(f"p{rng.randint(0, 14):02}", f"Q{rng.randint(0, 11):02}") for _ in range(rng.choice((18, 30, 45)))}
    rows = {}
    for p, q in edges:
        rows.setdefault(p, []).append(q)
    df = spark.createDataFrame([(p, ";".join(sorted(q))) for p, q in rows.items()], "stripped_peptide string, proteins string")
    peptides, proteins = inference.infer(df)
    want_peptides, want_proteins = brute_inference(edges)
    assert {r.peptide: r.protein_group for r in peptides.collect()} == want_peptides
    got = {r.initial_protein: (r.protein_group, r.indistinguishable, r.subsetted, r.subsumable) for r in proteins.collect()}
    assert got == want_proteins


def test_inference_on_a_study(spark):
    var = [{"var_id": f"v{i}", "stripped_peptide": p, "peptide": p, "proteins": q, "PEP": 0.01, "count_psm": 1} for i, (p, q) in enumerate([("A", "P1"), ("B", "P1;P2"), ("C", "P3")])]
    s = study(spark, [[1, 2, 3]], [{"obs_id": "s"}], var, name="peptide")
    s = inference.infer_protein(s)
    assert {r.peptide: (r.protein_group, r.peptide_type) for r in s["peptide"].var.collect()} == {"A": ("P1", "unique"), "B": ("P1", "unique"), "C": ("P3", "unique")}
    out = rollup.to_protein(s)
    assert {k: v for (_, k), v in values(out["protein"].x).items()} == {"P1": 1.5, "P3": 3.0}
    other = inference.infer_protein(study(spark, [[1]], [{"obs_id": "s"}], [{"var_id": "z", "stripped_peptide": "ZZ", "proteins": "P9"}], name="peptide"), propagated_from=s)
    assert other["peptide"].var.first().peptide_type is None


def test_representative(spark):
    info = spark.createDataFrame([("P1", "sp_P1"), ("P1-2", "sp_P1-2"), ("Q2", "tr_Q2"), ("contam_P3", "contam_sp_P3")], "accession string, kind_id string")
    groups = spark.createDataFrame([("P1-2,P1",), ("P1-2;Q2",), ("Q2,contam_P3",), ("contam_P3",), ("none",)], "protein_group string")
    got = {r.protein_group: r.representative for r in inference.representative(groups, info).collect()}
    assert got == {"P1-2,P1": "P1", "P1-2;Q2": "P1-2", "Q2,contam_P3": "Q2", "contam_P3": "contam_sp_P3", "none": ""}


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first().c


def test_peptide_functions(spark):
    assert [one(spark, pep.missed_cleavages(F.lit(x))) for x in ("AKRP", "ACDK", "AAA")] == [1, 1, 0]
    assert one(spark, pep.stripped(F.lit("ACD[+57.02]EF"))) == "ACDEF"
    assert one(spark, pep.accessions(F.lit("sp|P1|A;rev_sp|P2|B;contam_tr|P3|C;rev_P4"))) == "P1;rev_P2;contam_P3;rev_P4"
    assert one(spark, pep.file_stem(F.lit("/a/b.c/run_L.mzML"))) == "run_L" and one(spark, pep.without_suffix(F.lit("sample_L.mzML"))) == "sample_L"
    assert abs(one(spark, pep.mass_to_charge(F.lit(1000.0), F.lit(2))) - 501.007276466812) < 1e-9
    assert len(labels.channels(16)) == 16 and labels.channels(10)[-1] == "131"
    with pytest.raises(ValueError):
        labels.channels(7)


FASTA = ">sp|P1|P1_HUMAN Protein One OS=Homo sapiens OX=9606 GN=GENE1\nMKWVTF\nISLL\n>tr|P2|P2_MOUSE Two OS=Mus musculus OX=10090\nMADEUPSEQSLL\n>contam_sp|P3|C Contaminant\nMKK\n"


def test_fasta_and_sites(spark, tmp_path):
    path = tmp_path / "a.fasta"
    path.write_text(FASTA)
    rows = {r.accession: r for r in fasta.read_fasta(spark, str(path)).collect()}
    assert set(rows) == {"P1", "P2", "contam_P3"}
    assert (rows["P1"].Gene, rows["P1"].Organism, rows["P1"].Description, rows["P1"].Sequence) == ("GENE1", "Homo sapiens", "Protein One", "MKWVTFISLL")
    assert rows["P2"].Gene == "Unknown" and rows["P2"].kind_id == "tr_P2"
    var = [{"var_id": "v1", "peptide": "IS[+79.97]LL", "stripped_peptide": "ISLL", "protein_group": "P1", "count_psm": 2}, {"var_id": "v2", "peptide": "S[+79.97]LL", "stripped_peptide": "SLL", "protein_group": "P1,P2;none", "count_psm": 1}]
    s = fasta.attach_fasta(study(spark, [[4, 8], [6, 2]], [{"obs_id": "s1"}, {"obs_id": "s2"}], var, name="peptide"), str(path))
    out = ptm.to_ptm(s, "phospho", "[+79.97]")
    assert {r.protein_site: r.count_psm for r in out["phospho_site"].var.collect()} == {"P1|S8": 2, "P1|S8,P2|S10": 2}
    assert values(out["phospho_site"].x)["s2", "P1|S8,P2|S10"] == 2.0
    named = fasta.map_fasta(s, "peptide", ["Gene", "Organism"])["peptide"].var
    assert {r.var_id: r.Organism for r in named.collect()} == {"v1": "Homo sapiens", "v2": "Homo sapiens,Mus musculus"}
    with pytest.raises(NotImplementedError):
        fasta.attach_fasta(s, None)


def test_occurrences_do_not_overlap(spark):
    assert one(spark, ptm.occurrences(F.lit("AAAAA"), F.lit("AA"))) == [1, 3] and one(spark, ptm.occurrences(F.lit("AXA"), F.lit("B"))) == []
    got = one(spark, ptm.peptide_sites(F.lit("AS[+79.97]C(unimod:4)T[+79.97]K"), "[+79.97]"))
    assert [(s.residue, s.place) for s in got] == [("S", 2), ("T", 4)]


SAGE = [("sp|P1|A", "x/run1.mzML", "scan=5", "PEPT[+57.02]K", 1, -2.0, 5, 0.001, 2, 0, 0, 1.0, 500.0), ("rev_sp|P2|B", "x/run1.mzML", "scan=6", "AAAK", -1, -1.0, 4, 0.2, 2, 0, 0, 1.5, 400.0)]
SAGE_COLUMNS = "proteins string, filename string, scannr string, peptide string, label int, posterior_error double, peptide_len int, spectrum_q double, charge int, missed_cleavages int, semi_enzymatic int, rt double, calcmass double"


def test_sage(spark):
    ident = spark.createDataFrame(SAGE, SAGE_COLUMNS)
    quant = spark.createDataFrame([("run1.mzML", "scan=5", 1.0, 10.0, 0.0)], "filename string, scannr string, ion_injection_time double, tmt_1 double, tmt_2 double")
    s = readers.read_sage(spark, ident, "tmt", quant)
    assert values(s["psm"].x) == {("126", "run1.5"): 10.0} and s["psm"].decoy.first().proteins == "rev_P2"
    row = s["psm"].var.first()
    assert (row.stripped_peptide, row.PEP, row.contaminant, row.q_value) == ("PEPTK", 0.01, 0, 0.001)
    wide = spark.createDataFrame([("PEPT[+57.02]K", 2, "P", 0.1, 1.0, 1.0, 5.0, float("nan"))], "peptide string, charge int, proteins string, q_value double, score double, spectral_angle double, `run1.mzML` double, `run2.mzML` double")
    lfq = readers.read_sage(spark, ident, "label_free", wide)
    assert values(lfq["peptide"].x) == {("run1", "PEPT[+57.02]K"): 5.0} and not lfq["psm"].has_quant()
    assert readers.read_sage(spark, ident, "label_free")["psm"].var.count() == 1
    with pytest.raises(ValueError):
        readers.read_sage(spark, ident, "silac")


def test_fragpipe_and_maxquant(spark):
    row = {"Spectrum": "f.00012.00012.2", "Protein": "sp|P1|A", "Mapped Proteins": "sp|P2|B, sp|P3|C", "Peptide": "AAK", "Modified Peptide": None, "Charge": 2, "Peptide Length": 3, "Number of Missed Cleavages": 0, "Retention": 120.0, "Calculated Peptide Mass": 300.0, "ch1": 5.0, "ch2": 0.0}
    kinds = {str: "string", int: "int", float: "double", type(None): "string"}
    frame = lambda r: spark.createDataFrame([tuple(r.values())], ", ".join(f"`{k}` {kinds[type(v)]}" for k, v in r.items()))
    s = readers.read_fragpipe(spark, frame(row), "tmt")
    psm = s["psm"].var.first()
    assert (psm.proteins, psm.peptide, psm.scan_num, psm.rt) == ("P1;P2;P3", "AAK", 12, 2.0) and values(s["psm"].x) == {("ch1", "f.12"): 5.0}
    with pytest.raises(ValueError):
        readers.read_fragpipe(spark, frame(row), "tmt", "dia")
    mq = {"Type": "MSMS", "Sequence": "AAK", "Modified sequence": "_AAK_", "Length": 3, "Missed cleavages": 0, "Charge": 2, "Raw file": "f", "MS/MS scan number": 7, "Retention time": 1.0, "Proteins": "CON__P1", "Leading proteins": "REV__P9", "Reverse": None, "Potential contaminant": "+", "score": 3.0, "Intensity": 9.0}
    s = readers.read_maxquant(spark, frame(mq), "label_free")
    assert s["psm"].var.first().proteins == "contam_P1" and values(s["peptide"].x) == {("f", "_AAK_"): 9.0}
    s = readers.read_maxquant(spark, frame({**mq, "Reverse": "+", "Reporter intensity corrected 1": 4.0, "Reporter intensity corrected 2": 5.0}), "tmt")
    assert s["psm"].var.count() == 0 and s["psm"].decoy.first().proteins == "rev_P9"
    with pytest.raises(NotImplementedError):
        readers.read_maxquant(spark, frame(mq), "tmt", "dia")


def test_diann(spark):
    columns = "`Protein.Ids` string, `Modified.Sequence` string, `Stripped.Sequence` string, Run string, `Precursor.Id` string, `Precursor.Charge` int, `Lib.Q.Value` double, `Global.Q.Value` double, PEP double, RT double, `Precursor.Mass` double, `Precursor.Quantity` double"
    rows = [("P1", "AAK", "AAK", "r1", "AAK2", 2, 0.0, 0.02, 0.1, 1.0, 300.0, 7.0), ("P1", "AAK", "AAK", "r2", "AAK2", 2, 0.0, 0.03, 0.1, 1.0, 300.0, 0.0)]
    s = readers.read_diann(spark, spark.createDataFrame(rows, columns))
    assert values(s["psm"].x) == {("r1", "r1.AAK2"): 7.0} and {r.q_value for r in s["psm"].var.collect()} == {0.02, 0.03}
    library = readers.read_diann(spark, spark.createDataFrame([(*r[:6], 0.5, *r[7:]) for r in rows], columns))
    assert {r.q_value for r in library["psm"].var.collect()} == {0.5}
    with pytest.raises(NotImplementedError):
        readers.DiannReader.from_pg()


def test_files_and_exports(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("a\tb\n1\tx\n")
    assert tables.read_table(spark, str(tmp_path / "t.tsv")).first().asDict() == {"a": 1, "b": "x"}
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.doc")
    var = [{"var_id": "v1", "filename": "f", "rt": 1.0, "stripped_peptide": "A", "peptide": "A", "calcmass": 2.0, "proteins": "P", "charge": 2, "extra": 1}]
    s = study(spark, [[3], [None]], [{"obs_id": "s1"}, {"obs_id": "s2"}], var)
    wide = export.to_readable(s, "psm", exclude=["extra", "var_ord"])
    assert "extra" not in wide.columns and wide.first().s1 == 3.0 and wide.first().s2 is None
    assert export.to_readable(s, "psm", include="peptide", quantification=False).columns == ["peptide"]
    export.write_csv(s, "psm", str(tmp_path / "out"), ",")
    export.write_flashlfq_input(s, str(tmp_path / "lfq"))
    assert spark.read.options(header=True, sep="\t").csv(str(tmp_path / "lfq")).columns == list(export.FLASHLFQ.values())


def spectrum(level, mz, intensity, target=None):
    pack = lambda v, name: f'<binaryDataArray><cvParam accession="MS:1000523"/><cvParam accession="{name}"/><binary>{base64.b64encode(np.array(v, "<f8").tobytes()).decode()}</binary></binaryDataArray>'
    more = f'<cvParam accession="MS:1000827" value="{target}"/><cvParam accession="MS:1000828" value="1"/><cvParam accession="MS:1000829" value="1"/><cvParam accession="MS:1000744" value="{target}"/><cvParam accession="MS:1000041" value="2"/>' if target else ""
    return f'<spectrum><cvParam accession="MS:1000511" value="{level}"/>{more}{pack(mz, "MS:1000514")}{pack(intensity, "MS:1000515")}</spectrum>'


def test_purity(spark, tmp_path):
    body = spectrum(1, [499.0, 500.0, 500.5, 500.501, 503.0], [9, 6, 3, 0, 9]) + spectrum(2, [100.0], [1], 500.0) + spectrum(2, [100.0], [1], 800.0)
    (tmp_path / "run_L.mzML").write_text(f"<mzML>{body}</mzML>")
    got = {r.scan_num: r.purity for r in mzml.purities(spark, str(tmp_path / "run_L.mzML")).collect()}
    # 500.5 is 1.7 mDa off the second isotope of a doubly charged ion at 500: inside 20 ppm; 499 is on the edge and 2 isotopes below.
    assert got[3] is None and 0 < got[2] <= 1
    s = study(spark, [[1, 2]], [{"obs_id": "s"}], [{"var_id": "a", "filename": "run_L", "scan_num": 2}, {"var_id": "b", "filename": "run_L", "scan_num": 9}])
    var = {r.var_id: r.purity for r in mzml.compute_precursor_isolation_purity(s, str(tmp_path / "run_L.mzML"))["psm"].var.collect()}
    assert var["a"] == got[2] and var["b"] is None
    with pytest.raises(ValueError):
        mzml.purities(spark, "x", tolerance=0)


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tsv").write_text("peptide\tvalue\nAAK\t1\nCCK\t2\n")
    stream = ingest.watch(spark, str(tmp_path / "in"), "peptide string, value double")
    for expected in (2, 3):
        ingest.append_to(stream, str(tmp_path / "table"), str(tmp_path / "state"), once=True).awaitTermination(60)
        assert spark.read.parquet(str(tmp_path / "table")).count() == expected
        (tmp_path / "in" / "b.tsv").write_text("peptide\tvalue\nDDK\t3\n")
        time.sleep(0.1)


def test_study_checks(spark):
    s = study(spark, [[1]], [{"obs_id": "s"}], label="tmt")
    other = study(spark, [[1]], [{"obs_id": "s"}], name="protein", label="label_free")
    with pytest.raises(ValueError):
        Study({**s.assays, **other.assays}, s.obs).label()
    with pytest.raises(ValueError):
        s.levels("protein")
    assert s.levels("psm") and s["psm"].has_quant() and not s["psm"].has_pep
