from pathlib import Path

import duckdb
import pytest
from medlattice.llm.oracle import ORACLE
from medlattice.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() >= 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    rel = con.execute(ORACLE[name])
    columns = [c[0] for c in rel.description]
    assert sorted(tuple(r[c] for c in columns) for r in QUERIES[name](spark, SMALL).collect()) == sorted(map(tuple, rel.fetchall()))
