"""The queries with SQL give DuckDB's rows, the others run, on the smallest data."""

from pathlib import Path

import duckdb
import pytest

from phyllon.llm.queries import oracle_sql, queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, name):
    df = queries()[name](spark, str(DATA))
    got = df.collect()
    if name not in oracle_sql():
        assert got
        return
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    cursor = con.execute(oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(str(tuple(r[c] for c in columns)) for r in got) == sorted(map(str, cursor.fetchall()))
