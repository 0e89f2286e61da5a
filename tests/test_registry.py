"""Every query with SQL gives DuckDB's rows, on the smallest data; those that rank, on more, too."""

import math
from pathlib import Path

import duckdb
import pytest

from phyllon.plans.registry import QUERIES, SQL

DATA, MORE = Path("/root/testdata/sf0.001"), Path("/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")
RANKED = [n for n in sorted(SQL) if n.startswith(("sort_products", "preset_", "train_val", "assign_", "orders_", "cart_", "resize_", "blur_"))]


@pytest.fixture(scope="module")
def ducks():
    out = {}
    for folder in (DATA, MORE):
        out[folder] = duckdb.connect()
        for p in folder.glob("*.parquet"):
            out[folder].execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return out


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in found)


@pytest.mark.parametrize(("name", "folder"), [*((n, DATA) for n in sorted(SQL)), *((n, MORE) for n in RANKED)])
def test_same_rows(spark, ducks, name, folder):
    df = QUERIES[name](spark, str(folder))
    cursor = ducks[folder].execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() > 0
