"""The registered queries against their SQL on the smallest tables, and what must hold without the llm subpackage."""

import pathlib
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from spectraloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
registry.load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, duck, name, tmp_path):
    want = duck.sql(registry.ORACLES[name])
    registry.QUERIES[name](spark, SF).write.parquet(str(tmp_path / "out"))
    got = duckdb.sql(f"select * from '{tmp_path}/out/*.parquet'")
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    pick = ", ".join(f'"{c}"' for c in columns)
    assert Counter(map(repr, want.project(pick).fetchall())) == Counter(map(repr, got.project(pick).fetchall()))


def test_entry_and_names(spark):
    assert entry.entry(spark).columns == ["peptide", "obs_id", "value"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_does_not_import_llm():
    root = pathlib.Path(registry.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "llm" not in path.read_text()
