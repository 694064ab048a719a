import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from corpusloom.operators import queries as engine

ROOT = Path(__file__).resolve().parents[1]
TABLES = Path("/root/testdata/sf0.001")
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_tables = pytest.mark.skipif(not TABLES.exists(), reason="no tables")


def compare(spark, query, sql):
    con = duckdb.connect()
    for t in NAMES:
        con.execute(f"create view {t} as select * from '{TABLES}/{t}.parquet'")
    got = query(spark, str(TABLES))
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    plain = lambda v: round(v, 7) if isinstance(v, float) else v
    a = sorted(repr(tuple(plain(r[c]) for c in sorted(names))) for r in got.collect())
    b = sorted(repr(tuple(plain(v) for _, v in sorted(zip(names, r)))) for r in want.fetchall())
    assert a == b


@needs_tables
@pytest.mark.parametrize("name", sorted(engine.ORACLES))
def test_query_equals_its_sql(spark, name):
    compare(spark, engine.QUERIES[name], engine.ORACLES[name])


@needs_tables
@pytest.mark.parametrize("name", sorted(set(engine.QUERIES) - set(engine.ORACLES)))
def test_queries_without_sql_run(spark, name):
    assert engine.QUERIES[name](spark, str(TABLES)).count() > 0


@needs_tables
def test_entry_runs(spark):
    assert entry.entry(spark).count() == 10


def test_library_works_without_the_training_data_operators(tmp_path):
    shutil.copytree(ROOT / "corpusloom", tmp_path / "corpusloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'pagerank' in e.queries() and not any(k.startswith('op') and k[2].isdigit() for k in e.queries()); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert not any("llm" in p.read_text() for p in (tmp_path / "corpusloom").rglob("*.py"))
