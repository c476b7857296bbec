"""The driver's contract: registered queries against their SQL, and the rest without the corpus folders."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from sparrowlog.plans.oracle import ORACLE
from sparrowlog.plans.queries import REGISTRY

ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return c


def normal(rows):
    return sorted(tuple(repr(v + 0.0) if isinstance(v, float) else repr(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, sf, duck, name):
    df = REGISTRY[name](spark, sf)
    want = duck.sql(ORACLE[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got = normal(df.select(*columns).collect())
    assert got == normal(want.project(", ".join(f'"{c}"' for c in columns)).fetchall()) and got


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - set(ORACLE)))
def test_query_without_sql_gives_rows(spark, sf, name):
    assert REGISTRY[name](spark, sf).count() > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 1


def test_the_rest_works_without_the_corpus_folders(tmp_path):
    shutil.copytree(ROOT / "sparrowlog", tmp_path / "sparrowlog", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert said.stdout.split() == [str(len(REGISTRY)), "False"], said.stderr[-2000:]
