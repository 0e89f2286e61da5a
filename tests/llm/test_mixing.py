import re

import pytest
from pyspark.sql import functions as F

from phyllon.llm.common import written
from phyllon.llm.mixing import mix_sources, repeated

SCHEMA = "doc_id long, text string, source string"


def shares(sizes):
    """The targets by repeated resharing of what is over the caps."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    cap, total = {s: 3 * sizes[s] for s in order}, sum(sizes.values())
    fixed = {}
    while True:
        left = total - sum(fixed.values())
        w = sum(weight[s] for s in order if s not in fixed)
        now = {s: left * weight[s] / w for s in order if s not in fixed}
        over = [s for s in now if now[s] > cap[s]]
        if not over:
            return fixed | now
        fixed |= {s: cap[s] for s in over}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "w " * (1 + i * 37 % 50), ("big", "mid", "tiny", "b", None)[0 if i % 3 == 0 else i % 5]) for i in range(900)]
    rows += [(5000, "x y", "alone"), (5001, None, "void"), (5002, "", "void"), (None, "a b c", "mid"), (7, "again again", "big"), (7, "again again", "big")]
    return spark.createDataFrame(rows, SCHEMA)


def test_targets_and_copies(docs):
    got = mix_sources(docs).collect()
    sizes = {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = shares(sizes)
    assert len(got) == docs.count()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["copies"] <= 3 and r["taken"] == r["size"] * r["copies"]
    for s in sizes:
        taken = sum(r["taken"] for r in got if r["source"] == s)
        assert abs(taken - want[s]) <= 1.5 * max(r["size"] for r in got if r["source"] == s)


def test_reruns_agree_in_any_partitioning(docs):
    key = lambda df: sorted((str(r["doc_id"]), r["text"] or "", r["taken"]) for r in df.collect())
    assert key(mix_sources(docs)) == key(mix_sources(docs.repartition(9)))
    assert key(mix_sources(docs)) != key(mix_sources(docs, seed=8))


def test_repeated_rows_and_clashing_columns(docs):
    mixed = mix_sources(docs.withColumn("size", F.lit("old")).withColumn("more", F.lit(1)))
    assert dict(mixed.dtypes)["size"] == "bigint" and "more" in mixed.columns
    assert repeated(mixed, ["doc_id"]).count() == mixed.agg(F.sum("copies")).first()[0]


def test_empty(spark):
    assert mix_sources(spark.createDataFrame([], SCHEMA)).collect() == []
    assert [r["taken"] for r in mix_sources(spark.createDataFrame([(1, None, None)], SCHEMA)).collect()] == [0]


def test_long_texts_do_not_move(spark):
    rows = [(1, "w " * 2_500_000, "a"), (2, "w", "a"), (3, "w " * 10, "b")]
    df = mix_sources(spark.createDataFrame(rows, SCHEMA))
    assert {r["doc_id"]: r["size"] for r in df.select("doc_id", "size", "copies").collect()} == {1: 2_500_000, 2: 1, 3: 10}
    narrow = mix_sources(written(spark.createDataFrame(rows, SCHEMA), "docs")).select("doc_id", "copies")
    plan = narrow._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and not re.search(r"[\[ ]text#\d+[,\]]", plan)  # no projection passes it on


def test_names_used_inside_clash_with_none(spark):
    rows = [(i, "w " * (i % 9), f"s{i % 3}") for i in range(60)]
    plain = spark.createDataFrame(rows, SCHEMA)
    names = ["_s", "_b", "_t", "_h", "_start", "_row", "_bucket", "_rate", "_u", "_own", "_n", "_words", "_bits"]
    wide = plain.withColumns({n: F.concat(F.lit(n), "doc_id") for n in names} | {"copies": F.lit("gone")})
    got = mix_sources(wide)
    assert set(got.columns) == {*wide.columns, "size", "source_size", "target", "copies", "taken"}
    want = {r["doc_id"]: r["copies"] for r in mix_sources(plain).collect()}
    for r in got.collect():
        assert r["copies"] == want[r["doc_id"]] and all(r[n] == f"{n}{r['doc_id']}" for n in names)
