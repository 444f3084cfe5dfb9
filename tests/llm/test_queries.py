"""The queries of the subpackage on the smallest tables: against SQL where there is some, else that they run."""

import glob
import os

import pytest

from flowquarry.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(name, spark):
    df = queries.QUERIES[name](spark, SF)
    got = sorted(map(tuple, df.collect()), key=str)
    if name not in queries.SQL:
        assert got or name.endswith("_found")
        return
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    want = con.execute(queries.SQL[name])
    assert [d[0] for d in want.description] == df.columns
    assert sorted(want.fetchall(), key=str) == got
