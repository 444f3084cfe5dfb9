"""The driver contract: names, and every query with SQL against DuckDB on the smallest tables."""

import glob
import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from flowquarry.plans import core

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def cells(row):
    out = []
    for v in row:
        if v is None or (isinstance(v, float) and v != v):
            out.append("~")
        elif isinstance(v, float):
            out.append(f"{v:.7g}")
        else:
            out.append(str(v))
    return tuple(out)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def test_names():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) >= 80
    assert {"p3_found", "p5_found", "p6_found"} <= set(q)


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_against_sql(name, spark, duck):
    got = core.QUERIES[name](spark, SF)
    want = duck.execute(core.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    mine = sorted(cells(r) for r in got.select(*[f"`{c}`" for c in order]).collect())
    at = [names.index(c) for c in order]
    theirs = sorted(cells([r[i] for i in at]) for r in want.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", ["p3_found", "p3_unified_schema", "p3_unified_rows", "p5_found", "p5_loaded_rows", "p5_failing_cells", "p5_load_balance", "p6_found", "p6_by_loads", "p6_profiles"])
def test_runs(name, spark):
    assert core.QUERIES[name](spark, SF).collect()


def test_loads_give_the_same_issues(spark):
    got = [sorted(map(tuple, core.QUERIES[n](spark, SF).collect())) for n in ("p6_found", "p6_by_loads")]
    assert got[0] == got[1]


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["decision", "n"] and len(df.collect()) == 3


def test_stored_tables_are_released(spark):
    from flowquarry import session

    df = session.stored(spark.range(3))
    assert df.count() == 3
    path = session._written[-1]
    held, session._written[:] = session._written[:-1], [path]
    session.release(spark)
    session._written[:] = held
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_nothing_outside_imports_the_optional_subpackage():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    found = subprocess.run(["grep", "-rnE", r"flowquarry\.llm|from flowquarry import llm", "--include=*.py", "flowquarry", "bench.py", "tests"], cwd=root, capture_output=True, text=True).stdout.splitlines()
    assert [x for x in found if not x.startswith(("flowquarry/llm/", "tests/llm/", "tests/test_entry.py"))] == []
    assert "flowquarry.llm" not in subprocess.run([sys.executable, "-c", "import sys, flowquarry.plans.core; print(*sys.modules)"], cwd=root, capture_output=True, text=True).stdout.split()
