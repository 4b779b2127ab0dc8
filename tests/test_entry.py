"""Every registered query of the engine runs; those with SQL agree with it."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from veilframe.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


def test_names():
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(catalog.ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


#: Of the smallest tables, whose 200 parts are no more than k.
EMPTY = {"k_assign_full", "k_assign_strict", "k_assign_counts"}


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, name, scale):
    sf_dir = f"/root/testdata/{scale}"
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, sf_dir)
    want = con.sql(catalog.ORACLES[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(c) for c in names]
    got = df.collect()
    assert sorted(str([r[c] for c in names]) for r in got) == sorted(str([r[i] for i in at]) for r in want.fetchall())
    assert got or scale == "sf0.001" and name in EMPTY, "nothing was compared"


def test_strict_bins_hold_k_and_nothing_else_is_published(spark):
    sizes = catalog.QUERIES["k_strict_sizes"](spark, "/root/testdata/sf0.01").collect()
    assert len(sizes) > 1 and all(r.n >= catalog.K // 10 for r in sizes if r.bin)
    for name in EMPTY:
        assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").collect() == []


def test_raw_rows_are_scanned_once_and_nothing_stays_in_memory(spark):
    df = catalog.QUERIES["st_dp_mean"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().toString()
    assert "Scan ExistingRDD" in plan and "FileScan" not in plan and "InMemoryRelation" not in plan
    df.collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_the_rest_works_without_the_training_half(tmp_path):
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache", ".hypothesis"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and not [k for k in q if k.startswith('op') or k == 'pipeline'], q; print(len(q))"
    ran = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path / "repo")})
    assert ran.returncode == 0 and int(ran.stdout) == len(catalog.QUERIES), ran.stderr
