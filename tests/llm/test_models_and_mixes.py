"""Toxicity, quality, embeddings, mixing, chat, licences and the pipeline on small tables."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spectraloom.llm import chat, embeddings, licenses, mixing, quality, queries, toxicity

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def same_as_sql(spark, df, sql, tmp_path, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        frame.write.parquet(str(tmp_path / name))
        con.sql(f"create view {name} as select * from '{tmp_path}/{name}/*.parquet'")
    want = con.sql(sql)
    df.write.parquet(str(tmp_path / "result"))
    got = con.sql(f"select * from '{tmp_path}/result/*.parquet'")
    assert sorted(want.columns) == sorted(got.columns)
    pick = ", ".join(f'"{c}"' for c in sorted(want.columns))
    assert Counter(map(repr, want.project(pick).fetchall())) == Counter(map(repr, got.project(pick).fetchall()))


# -- toxicity


def test_segments_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(200):
        scores = rng.normal(-0.3, 1, rng.integers(0, 25)).round(2)
        total = np.concatenate([[0], np.cumsum(scores)])

        def brute(a, b):
            best = None
            for i in range(a, b):
                for j in range(i + 1, b + 1):
                    s = total[j] - total[i]
                    if s > 1e-9 and (best is None or s > best[0] + 1e-9 or (abs(s - best[0]) <= 1e-9 and j - i < best[2] - best[1])):
                        best = (s, i, j)
            return [] if best is None else [*brute(a, best[1]), best[1:], *brute(best[2], b)]

        got = toxicity.segments(scores)
        assert len(got) == len(brute(0, len(scores)))
        assert np.allclose([s for _, _, s in got], [total[b] - total[a] for a, b in brute(0, len(scores))])


def corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        w = rng.choices(vocabulary, k=rng.randint(5, 80))
        toxic = rng.random() < 0.25
        if toxic:
            at = rng.randrange(len(w))
            w[at:at] = rng.choices(["vilefoo", "nastybar", "rottenbaz"], k=rng.randint(2, 5))
        rows.append((i, " ".join(w).capitalize() + ".", f"src{i % 3}"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def test_toxicity(spark):
    rows, labels = corpus(600, 1)
    docs = docs_of(spark, [*rows, (9001, None, None), (9002, "", "x"), (None, "vilefoo nastybar rottenbaz vilefoo", None), (9003, "Vilefoo! " * 3000, "s")])
    model = toxicity.fit(docs, spark.createDataFrame([*labels, (5000, 1, 1), (None, 1, 1), (3, 1, None)], LABELS), ~toxicity.held_out(F.col("doc_id"), 5, 0))
    got = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got.values())
    truth = {i: t for i, _, t in labels}
    assert sum((got[i].score >= 0.5) == t for i, t in truth.items()) >= 0.98 * len(truth)
    assert got[9001].score == got[9002].score < 0.2 and got[None].score > 0.5 and got[9003].score > 0.5
    toxic = next(i for i, t in truth.items() if t)
    text = re.findall("[a-z0-9]+", rows[toxic][1].lower())
    found = " ".join(" ".join(text[p.start : p.end]) for p in got[toxic].passages)
    assert any(w in found for w in ("vilefoo", "nastybar", "rottenbaz"))
    kept = toxicity.clean(docs.withColumn("score", F.lit(1)), model)
    assert kept.columns == [*docs.columns, "score"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, r in got.items() if r.score < 0.5)


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], LABELS)
    docs = docs_of(spark, [(1, "a b", "s"), (2, None, None)])
    model = toxicity.fit(docs, none)
    assert toxicity.clean(docs, model).count() == 2
    empty = docs_of(spark, [])
    assert toxicity.scored(empty, toxicity.fit(empty, none)).count() == 0


def test_rate_solves_its_equation():
    s, w = np.array([2.0, -0.5, -1.0]), np.array([0.05, 0.6, 0.35])
    assert math.isclose(float((w * np.exp(toxicity._rate(s, w) * s)).sum()), 1.0, rel_tol=1e-9)


def held_out_accuracy(spark, name, column):
    out = queries.QUERIES[name](spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").select("predicted", column).collect()
    return sum(r.predicted == r[column] for r in out) / len(out), sum(r.predicted and r[column] for r in out) / sum(r[column] for r in out)


def test_toxicity_held_out(spark):
    accuracy, recall = held_out_accuracy(spark, "op1_toxicity", "toxic")
    assert accuracy >= 0.97 and recall >= 0.9


def test_quality_held_out(spark):
    accuracy, recall = held_out_accuracy(spark, "op6_quality", "quality")
    assert accuracy >= 0.97 and recall >= 0.98


# -- quality


def test_features_and_risk(spark):
    import pyarrow as pa

    x = quality.features(pa.array([None, "", "a", "A!!\nA!! b", "x " * 5000, "é漢"]))
    assert x.shape == (6, len(quality.FEATURES)) and np.isfinite(x).all() and (x[0] == x[1]).all()
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 1, (800, 3)), rng.normal(-1.5, 1, (800, 3))
    model = quality.learn(good[:400], np.concatenate([good[400:], bad[:400]]), 0.5)
    test = np.concatenate([rng.normal(1, 1, (300, 3)), rng.normal(-1.5, 1, (300, 3))])
    assert np.mean((quality.score(test, model) >= 0.5) == (np.arange(600) < 300)) > 0.9
    docs = docs_of(spark, [(1, None, None), (None, "a", "s"), (2, "b " * 40_000, "s")])
    none = spark.createDataFrame([], LABELS)
    assert quality.scored(docs, quality.fit(docs, none)).count() == 3
    assert quality.scored(docs_of(spark, []), quality.fit(docs_of(spark, []), none)).count() == 0


# -- embeddings


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(150, 32))
    near = [b + rng.normal(size=32) * s * np.linalg.norm(b) / 32**0.5 for b in base[:60] for s in rng.choice((0.05, 0.15, 0.3, 0.45), 3)]
    vectors = [*base, *near, base[0], base[0] * 3, base[1]]
    rows = [(int(i), [float(v) for v in x], 0) for i, x in zip(rng.permutation(len(vectors)), vectors, strict=True)]
    odd = [(1000, None, 0), (1001, [0.0] * 32, 0), (1002, [float("nan"), *[1.0] * 31], 0), (1003, [None, *[1.0] * 31], 0), (1004, [1.0, 2.0], 0), (1005, [], 0), (None, rows[0][1], None), (1006, [float("inf")] * 32, 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").withColumn("cls", F.lit(1))
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    real = [(i, np.array(r, np.float32).astype(float)) for i, r, _ in rows] + [(None, np.array(rows[0][1], np.float32).astype(float))]
    unit = np.array([v / np.linalg.norm(v) for _, v in real])
    want = (unit @ unit.T >= 0.9).sum(1) - 1
    found = sum(got[i].n_links for i, _ in real)
    assert all(got[i].n_links <= w for (i, _), w in zip(real, want, strict=True))
    assert found >= 0.9 * want.sum() and want.sum() > 300
    for i in (1000, 1001, 1002, 1003, 1004, 1005, 1006):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[None].component_id == got[rows[0][0]].component_id
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_rotation_is_orthogonal():
    x = np.random.default_rng(1).normal(size=(500, 16)) * np.linspace(1, 3, 16)
    _, axes = embeddings.rotation(x, 16)
    assert np.allclose(axes.T @ axes, np.eye(16))


# -- mixing


def test_mixing_against_sql(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.choice((0, 1, 5, 40, 300)))), rng.choice(["a", "b", "é", "z", None, "huge", "huge", "huge"])) for i in range(300)]
    rows += [(None, "one two", "a"), (7, "same", "b"), (7, "same", "b"), (900, None, "only null"), (901, " \t\n", "blank")]
    docs = docs_of(spark, rows)
    out = mixing.decisions(docs)
    got = out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
    same_as_sql(spark, got, mixing.SQL, tmp_path, documents=docs)
    rows = got.join(docs.select("doc_id", "source").distinct(), "doc_id").collect()
    assert all(r.taken <= 3 * r.size for r in rows)
    by = out.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("size"), F.max("size").alias("longest")).collect()
    assert all(abs(r.taken - r.target) <= 3 * r.longest and r.target <= 3 * r.size + 1e-6 for r in by)
    assert math.isclose(sum(r.target for r in by), sum(r.size for r in by))
    mixed = mixing.mixed(docs.withColumn("copies", F.lit("x")))
    assert mixed.columns == [*docs.columns, "copies"]
    assert mixed.count() >= out.agg(F.sum("copies")).first()[0]  # rows alike are taken equally often


def test_rows_alike_are_mixed_as_decided(spark):
    rng = random.Random(6)
    rows = [(i % 7 if i % 3 else None, " ".join(["w"] * rng.randint(1, 3)), rng.choice("abcdef")) for i in range(400)]
    docs = docs_of(spark, rows).withColumns({"key": F.lit("k"), "number": F.monotonically_increasing_id(), "often": F.lit(1), "more": F.create_map(F.lit("a"), F.lit(1))})
    decided = mixing.decisions(docs).agg(F.sum(F.col("size") * F.col("copies"))).first()[0]
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert mixed.agg(F.sum(mixing.size_of(F.col("text")))).first()[0] == decided <= sum(len(t.split()) for _, t, _ in rows)
    assert max(r["count"] for r in mixed.groupBy("number").count().collect()) <= 3


def test_the_budget_ends_alike_however_ranges_are_cut(spark, monkeypatch):
    rng = random.Random(7)
    docs = docs_of(spark, [(i, "w " * rng.randint(0, 40), rng.choice("aaaabcd")) for i in range(600)])
    taken = lambda: sorted((r.doc_id, r.copies) for r in mixing.decisions(docs).collect())
    once = taken()
    monkeypatch.setattr(mixing, "SORTED", 1)
    monkeypatch.setattr(mixing, "RANGES", 4)
    assert taken() == once


def test_mixing_of_little(spark):
    assert mixing.decisions(docs_of(spark, [])).count() == 0
    one = mixing.decisions(docs_of(spark, [(1, "a b", "s"), (2, None, "s")])).collect()
    assert {(r.doc_id, r.size, r.copies) for r in one} == {(1, 2, 1), (2, 0, 0)}
    assert mixing.mixed(docs_of(spark, [(1, None, None)])).count() == 0


# -- chat

TURNS = "conv_id long, turn long, role string, text string"


def test_chat_round_trip(spark, tmp_path):
    rng = random.Random(3)
    bits = ["<s>", "</s>", "[INST]", " [/INST]", "[/INST] ", "<<SYS>>", "<</SYS>>", "<", "[", "␛", "␛0", "␛1", "\n", " ", "é", "😀", "ok", "\\", "$1", "[INST", "/s>"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", None, "odd\nrole", "<s>", "user "]), rng.choice([None, "", "".join(rng.choices(bits, k=rng.randint(1, 9)))])) for c in range(150) for t in range(rng.randint(1, 6))]
    rows += [(500, 0, "user", "x"), (500, 0, "user", "x"), (None, None, "user", "y"), (501, 0, "assistant", "z" * 100_000)]
    turns = spark.createDataFrame(rows, TURNS)
    out = chat.formatted(turns)
    more = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], TURNS)
    same_as_sql(spark, chat.digests(chat.formatted(turns.unionByName(more))), chat.SQL, tmp_path, conversations=turns)
    for r in out.collect():
        assert sum(x.length for x in r.mask) == len(r.formatted)
        at, said = 0, []
        for x in r.mask:
            if x.loss:
                said.append(r.formatted[at : at + x.length])
            at += x.length
        plain = [s.replace("␛1", "<").replace("␛2", "[").replace("␛3", "\n").replace("␛0", "␛") for s in said]
        assert plain == [t.text for t in r.turns if t.role == "assistant"]
        assert not any(c in s for s in said for c in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


def test_plain_conversations_stay_plain(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a < b [c]"), (1, 1, "assistant", "yes")], TURNS)
    r = chat.formatted(turns).first()
    assert r.formatted == "[INST] a < b [c] [/INST]<s>yes</s>" and not r.escaped
    assert chat.digests(chat.formatted(turns.limit(0))).count() == 0
    assert chat.digests(chat.formatted(turns.withColumn("formatted", F.lit(1)))).count() == 1


# -- licences


def test_licences_against_sql(spark, tmp_path):
    rng = random.Random(5)
    parts = ["gnu", "General", "PUBLIC", "license", "apache", "cc", "by", "mit", "MIT License.", "Licensed under CC BY-NC 4.0.", "released under the MIT license", "this work is licensed under the GNU General Public License v3", "lantern", "é", "K", "\n", ". ", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated", "under the Apache License, Version 2.0"]
    rows = [(i, " ".join(rng.choices(parts, k=rng.randint(0, 14))), "s") for i in range(400)]
    rows += [(None, "mit license mit license", None), (401, None, "s"), (402, "", "s"), (403, "--- ...", "s"), (404, "mit license " * 4000, "s"), (5, "cc by", "s"), (5, "cc by", "s")]
    docs = docs_of(spark, rows).withColumn("line", F.lit(1))
    out = licenses.scanned(docs)
    same_as_sql(spark, out.drop("matches"), licenses.SQL, tmp_path, documents=docs.drop("line"))
    assert out.where("n_base = 0 and score > 0").count() > 0
    assert licenses.scanned(docs.limit(0)).count() == 0


# -- queries and pipeline


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_against_sql(spark, tmp_path, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    queries.QUERIES[name](spark, SF).write.parquet(str(tmp_path / "r"))
    got = con.sql(f"select * from '{tmp_path}/r/*.parquet'")
    pick = ", ".join(f'"{c}"' for c in sorted(want.columns))
    assert sorted(want.columns) == sorted(got.columns)
    assert Counter(map(repr, want.project(pick).fetchall())) == Counter(map(repr, got.project(pick).fetchall()))


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "simhash_dedup", "mixing", "packing"]
    kept = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(i)))
        docs, before = spark.read.parquet(str(tmp_path / str(i))), docs
        kept[name] = [r.asDict() for r in docs.collect()]
    left = {r["doc_id"] for r in kept["toxicity"]}
    toxic, clean = [i for i, t in labels.items() if t], [i for i, t in labels.items() if not t]
    # Some 50 toxic labels in four languages: not every language's words can be learned from so few.
    assert sum(i not in left for i in toxic) >= 0.6 * len(toxic) and sum(i in left for i in clean) >= 0.97 * len(clean)
    norm = lambda t: hashlib.sha256(re.sub("[\x20\x09-\x0d]", "", t or "").encode()).digest()
    groups = {}
    for r in kept["toxicity"]:
        groups.setdefault(norm(r["text"]), []).append((-len(r["text"] or ""), r["doc_id"]))
    assert sorted(r["doc_id"] for r in kept["exact_dedup"]) == sorted(min(g)[1] for g in groups.values())
    near = {r["doc_id"] for r in kept["simhash_dedup"]}
    assert near <= {r["doc_id"] for r in kept["exact_dedup"]} and len(near) >= 0.9 * len(kept["exact_dedup"])
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    total, taken = sum(size(r["text"]) for r in kept["simhash_dedup"]), sum(size(r["text"]) for r in kept["mixing"])
    assert 0.97 * total <= taken <= total and max(Counter(r["doc_id"] for r in kept["mixing"]).values()) <= 3
    lengths = Counter()
    for r in kept["packing"]:
        lengths[r["sequence_id"]] += r["length"]
    assert max(lengths.values()) <= 4096 and len(lengths) <= -(-sum(lengths.values()) // 4096) + 2
    assert Counter(r["doc_id"] for r in kept["packing"] if r["piece"] == 0) == Counter(r["doc_id"] for r in kept["mixing"])


def test_pipeline_of_nothing(spark):
    docs = docs_of(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        docs = out if "text" in out.columns else docs


def test_stages_take_odd_rows(spark):
    docs = docs_of(spark, [(1, None, None), (None, "a b c", "s"), (2, "", "s"), (3, "x " * 50_000, None), (3, "x " * 50_000, None)]).withColumn("nth", F.lit(None).cast("string")).withColumn("c0", F.lit(0))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() > 0, name
    assert corpus_pipeline.STAGES[4][1](spark, docs, SF).count() >= 5
