"""Maps an image a row against their long form, and searches by the index against the scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from phyllon.operators import catalog, explain
from phyllon.plans import fixtures as X

DATA = "/root/testdata/sf0.001"


def test_tensor_form_is_the_long_form(spark):
    long = explain.minmax_normalize(explain.cam(X.cam_maps(spark, DATA)))
    want = {(r["image_id"], r["cell"]): r["value"] for r in long.collect()}
    rows = explain.explain_maps(X.cam_tensors(spark, DATA), blur=False, threshold=None)
    got = {(r["image_id"], i): v for r in rows.collect() for i, v in enumerate(r["map"])}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    inside = long.select("image_id", "cell", F.expr("CASE WHEN cell % 8 >= 2 AND cell % 8 < 7 AND cell >= 8 THEN 1 ELSE 0 END AS mask"))
    want = {(r["image_id"], r["cell"]): r["value"] for r in explain.restrict_map(long, inside).collect()}
    boxed = X.cam_tensors(spark, DATA).withColumns({"x1": F.lit(2), "y1": F.lit(1), "x2": F.lit(7), "y2": F.lit(99)})
    rows = explain.explain_maps(boxed, blur=False)
    got = {(r["image_id"], i): v for r in rows.collect() for i, v in enumerate(r["map"])}
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert "Exchange" not in explain.explain_maps(spark.range(3).selectExpr("id AS image_id", "1 AS height", "2 AS width", "array(1D, 2D) AS acts", "array(1D, 1D) AS grads"))._jdf.queryExecution().executedPlan().toString()


def test_odd_maps(spark):
    schema = "image_id long, height int, width int, acts array<double>, grads array<double>, x1 int, y1 int, x2 int, y2 int"
    flat = [1.0] * 6
    rows = [(1, 2, 3, flat, flat, None, None, None, None), (2, 2, 3, None, flat, 0, 0, 1, 1), (3, 2, 3, flat, [-1.0] * 6, 0, 0, 1, 1), (4, 1, 2, [0.0, 4.0, 2.0, 0.0], [1.0, 1.0, 0.0, 0.0], 0, 0, 9, 9)]
    got = {r["image_id"]: r["map"] for r in explain.explain_maps(spark.createDataFrame(rows, schema), blur=False).collect()}
    assert got[1] == [0.0] * 6 and got[2] is None and got[3] == [0.0] * 6
    assert np.allclose(got[4], [0, 1])
    assert explain.explain_maps(spark.createDataFrame([], schema), (4, 4)).count() == 0


def products(spark):
    rows = [
        (1, "50% off_x", "Brand A", "spray", ["Leaf Blight"], ["new"]),
        (2, "Éclair été", "漢字漢字漢", None, ["Rust", None], None),
        (3, "ab", "", "xyz", None, ["banana"]),
        (4, "aaaa", "B", "aab", [], ["ban", "ana", "İb"]),
        (5, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, "med_id long, name string, brand string, category string, diseases array<string>, tags array<string>")


@pytest.mark.parametrize("query", ["", "a", "ab", "%", "off_", "OFF_X", "leaf b", "i̇b", "éTÉ", "漢字漢", "banana", "ana", "aaaaa", "aab", "rust", "nothing here", "50% off_x"])
def test_the_index_finds_what_the_scan_finds(spark, query):
    df = products(spark)
    find = lambda rows: sorted(r["med_id"] for r in rows.collect())
    assert find(catalog.search_indexed(df, catalog.search_index(df), query)) == find(catalog.search_products(df, query))


def test_a_search_reads_the_parts_of_its_pieces(spark, tmp_path):
    df = X.products(spark, DATA)
    catalog.write_search_index(catalog.search_index(df), f"{tmp_path}/index")
    index = spark.read.parquet(f"{tmp_path}/index")
    found = catalog.search_indexed(df, index, "bulk_p")
    want = catalog.search_products(df, "bulk_p")
    assert found.exceptAll(want).isEmpty() and want.exceptAll(found).isEmpty() and want.count() > 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "gram" in line)
    assert "PartitionFilters: [isnotnull(part" in scan or "PartitionFilters: [part" in scan
    assert "PushedFilters: [In(gram" in scan.replace("IsNotNull(gram), ", "")
    read = index.filter(F.col("part").isin([r["part"] for r in index.filter(F.col("gram").isin("bul", "ulk", "lk_", "k_p")).select("part").distinct().collect()]))
    assert read.select(F.input_file_name()).distinct().count() < len(index.inputFiles()) / 4
