"""The operators' queries that SQL can express, against that SQL; and the driver's contract with and without the subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from memlake.llm.queries import ORACLE_SQL, QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_agrees_with_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("embeddings", "pages", "documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    table = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in table.description]
    assert sorted(map(str, map(tuple, QUERIES[name](spark, sf_dir).select(*names).collect()))) == sorted(map(str, table.fetchall()))


def test_contract_without_the_subpackage(tmp_path):
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n.startswith('op') for n in q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"
    run = lambda at: subprocess.run([sys.executable, "-c", code], cwd=at, env=os.environ | {"PYTHONPATH": str(at)}, capture_output=True, text=True, check=True).stdout.split()
    assert run(ROOT)[1:] == ["13", "True", "True"]
    shutil.copytree(f"{ROOT}/memlake", tmp_path / "memlake", ignore=shutil.ignore_patterns("llm"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    assert run(tmp_path)[1:] == ["0", "False", "True"]


def test_the_rest_runs_without_both_folders(tmp_path):
    """A copy without the subpackage, its tests and the pipeline collects all other tests and passes some of them."""
    for name in ("memlake", "tests"):
        shutil.copytree(f"{ROOT}/{name}", tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    run = lambda *args: subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "-p", "no:cacheprovider", *args], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert run("--collect-only").returncode == 0
    done = run("-k", "test_text_functions or test_manifests or evidence_links")
    assert done.returncode == 0 and "3 passed" in done.stdout, done.stdout[-2000:]
