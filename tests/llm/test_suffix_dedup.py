import hashlib
from pathlib import Path

import numpy as np
import pytest

from phyllon.llm.common import scratch, shared_dir
from phyllon.llm.suffix_dedup import NONE, refine, remove_repeats

SCHEMA = "doc_id long, text string"


def brute(rows, size=50):
    first = {}
    for i, text in rows:
        b = (text or "").encode()
        for s in range(len(b) - size + 1):
            w = b[s : s + size]
            first[w] = min(first.get(w, NONE), NONE if i is None else i)
    out = []
    for i, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - size + 1):
            if first[b[s : s + size]] < (NONE if i is None else i):
                gone[s : s + size] = True
        spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and gone[0]))
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(map(str, out))


def rows():
    rng = np.random.default_rng(3)
    words = ["lorem", "ipsum", "dolor", "é", "sit", "amet", "日本", "x"]
    texts = [" ".join(rng.choice(words, int(rng.integers(1, 120)))) for _ in range(60)]
    passage = " ".join(rng.choice(words, 40))
    out = [(i * 3, t) for i, t in enumerate(texts)]
    out += [(1000 + i, texts[i % 7] + passage + texts[(i * 5 + 1) % 60]) for i in range(25)]
    out += [(2000, None), (2001, ""), (2002, "ab" * 700), (2003, "ab" * 300), (None, texts[5]), (None, None), (15, texts[9]), (15, texts[9]), (2004, passage * 40), (2005, "a" * 49), (2006, "a" * 50), (2007, "a" * 50)]
    return out


@pytest.mark.parametrize("block, part", [(4 << 20, 8 << 20), (3000, 9000)])
def test_same_as_brute_force(spark, block, part):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(4)
    got = remove_repeats(df, block_bytes=block, part_bytes=part).drop("kept").collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows())


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_refinement():
    data = np.frombuffer(b"abcabcabcabcabcabc" * 9, np.uint8)
    stop = np.repeat([81, 162], 81)
    pointer = refine(data, stop, 50)
    text = data.tobytes()
    for i in range(len(data)):
        assert (pointer[i] < 0) == (stop[i] - i < 50)
        for j in range(i):
            if pointer[i] >= 0 and pointer[j] >= 0:
                assert (pointer[i] == pointer[j]) == (text[i : i + 50] == text[j : j + 50])


def test_a_frequent_line_is_not_one_group(spark):
    """A line of 90 bytes in all documents, with differing neighbours: its windows are dealt to all partitions."""
    rng = np.random.default_rng(5)
    noise = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), n))
    line = noise(90)
    rows = [(i, noise(60) + line + noise(60)) for i in range(1500)]
    folder = Path(shared_dir(spark).removeprefix("file://"))
    old = set(folder.glob("pieces-*"))
    got = remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(4), block_bytes=40_000, part_bytes=20_000).drop("kept").collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows)
    back = spark.read.parquet(*(f"file://{p}" for p in set(folder.glob("pieces-*")) - old)).selectExpr("p", "length(bits) AS n").groupBy("p").sum("n").collect()
    windows = [r[1] for r in back]
    assert len(windows) > 12 and max(windows) < 0.3 * sum(windows)


def test_long_texts_and_nothing_left_behind(spark):
    rng = np.random.default_rng(8)
    long = "".join(rng.choice(list("abcdefgh "), 5_000_000))
    folder = Path(shared_dir(spark).removeprefix("file://"))
    tables, files = spark.catalog.listTables(), set(folder.iterdir())
    with scratch(spark):
        got = {r["doc_id"]: r for r in remove_repeats(spark.createDataFrame([(1, long), (2, "x" + long[100:] + "y"), (3, "short"), (2, "x" + long[100:] + "y")], SCHEMA)).drop("kept").collect()}
    assert {i: r["n_removed"] for i, r in got.items()} == {1: 0, 2: len(long) - 100, 3: 0}
    assert spark.catalog.listTables() == tables and set(folder.iterdir()) == files


def test_blocks_are_in_the_shared_folder_and_more_than_the_buckets(spark):
    """Spark's limit of buckets ends no run, and nothing is written to the warehouse."""
    line = "a line of fifty bytes or more that many documents share, all of them "
    rows = [(i, line + f"{i} own words " * 5) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(str, remove_repeats(df).drop("kept").collect()))
    before = spark.conf.get("spark.sql.sources.bucketing.maxBuckets")
    spark.conf.set("spark.sql.sources.bucketing.maxBuckets", 3)
    try:
        with scratch(spark):
            out = remove_repeats(df, block_bytes=200)
            assert sorted(map(str, out.drop("kept").collect())) == want
            places = [r["name"] for r in spark.sql("SHOW TABLES").selectExpr("tableName AS name").collect() if r["name"].startswith("blocks_")]
            found = {spark.sql(f"DESCRIBE FORMATTED {n}").filter("col_name = 'Location'").first()["data_type"] for n in places}
            assert found and all(shared_dir(spark).removeprefix("file://") in x for x in found)
    finally:
        spark.conf.set("spark.sql.sources.bucketing.maxBuckets", before)
