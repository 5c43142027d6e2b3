import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from corpusloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{SF}/{name}')")
    return con


def cell(x):
    if x is None or x != x:
        return "null"
    return repr(float(x)) if isinstance(x, float) else str(list(map(cell, x))) if isinstance(x, list) else str(x)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(spark, oracle, name):
    got = registry.queries()[name](spark, SF)
    want = oracle.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = lambda data: sorted(tuple(map(cell, r)) for r in data)
    assert rows(map(tuple, got.select(*(f"`{c}`" for c in columns)).collect())) == rows(want.fetchall())


def test_entry_imports_without_the_subpackage(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{root}/corpusloom", tmp_path / "corpusloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') for n in e.queries()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    n, m, any_of_them = done.stdout.split()
    assert int(n) == int(m) == len(registry.queries()) and any_of_them == "False" and "left out" not in done.stderr
