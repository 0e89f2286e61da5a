import re

import numpy as np
from pyspark.sql import functions as F

from phyllon.llm.jaccard_join import _placed, jaccard_join, prefix_depth

SCHEMA = "doc_id long, text string"


def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    k = min(n, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def brute(rows, similarity=0.8):
    sets = [shingles(t) for _, t in rows]
    links = {i: set() for i in range(len(rows))}
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9:
                links[i].add(j)
                links[j].add(i)
    root = {i: rows[i][0] for i in links}
    while True:
        new = {i: min([root[i], *(root[j] for j in links[i])]) for i in links}
        if new == root:
            return sorted((rows[i][0], root[i], len(links[i])) for i in links)
        root = new


def corpus():
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(400)]
    base = [list(rng.choice(words, int(rng.integers(30, 200)))) for _ in range(40)]
    texts = [" ".join(b) for b in base]
    for k in range(120):
        b = list(base[k % 12])
        for _ in range(int(rng.integers(0, 4))):
            b[int(rng.integers(len(b)))] = str(rng.choice(words))
        texts.append(" ".join(b))
    texts += [texts[3]] * 9 + [texts[3].upper()] + ["one two", "one  two", "two one", "x"]
    return [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts)]


def test_same_as_brute_force(spark):
    rows = corpus()
    want = brute(rows)
    more = [(7000, None), (7001, ""), (7002, " \n "), (None, rows[0][1])]
    df = spark.createDataFrame(rows + more, SCHEMA).withColumn("class_id", F.lit("clash")).repartition(3)
    for block in (384, 8):
        got = jaccard_join(df, block=block).collect()
        assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in got if r["doc_id"] is not None and r["doc_id"] < 7000) == want
        assert sorted((r["doc_id"], r["class_id"], r["n_links"], r["kept"]) for r in got if (r["doc_id"] or 0) >= 7000) == [(i, i, 0, True) for i in (7000, 7001, 7002)]
        assert [(r["class_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)]


def test_empty(spark):
    assert jaccard_join(spark.createDataFrame([], SCHEMA)).count() == 0


def test_prefixes_shorten_until_the_recall_is_met():
    assert prefix_depth(0.8, 24, 8, 0.0) == 8
    p = prefix_depth(0.8, 24, 8, 0.9995)
    assert 1 - (1 - 0.8**p) ** 24 >= 0.9995 > 1 - (1 - 0.8 ** (p + 1)) ** 24


def test_one_id_with_different_texts_loses_no_link(spark):
    rng = np.random.default_rng(3)
    t, u = (" ".join(f"w{x}" for x in rng.integers(0, 900, 60)) for _ in range(2))
    rows = [(1, t), (1, u), (2, t + " end"), (3, u + " end"), (4, t + " end"), (4, t + " end")]
    got = jaccard_join(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == brute(rows)
    assert [r["n_links"] for r in got if r["doc_id"] == 3] == [1]


def chained(n, rng):
    """Texts whose neighbours have a similarity of about 0.5, far below the threshold, and a few true copies."""
    words = [f"w{x}" for x in rng.integers(0, 50_000, 20 * n + 60)]
    texts = [" ".join(words[20 * i : 20 * i + 60]) for i in range(n)]
    return texts + [texts[0] + " end", texts[n // 2] + " more"]


def test_a_long_chain_of_candidates(spark):
    rows = list(enumerate(chained(600, np.random.default_rng(6))))
    got = jaccard_join(spark.createDataFrame(rows, SCHEMA), block=16).collect()
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == brute(rows)


def compared(spark, nodes, block):
    """How many comparisons _placed deals out, and whether the groups are whole, for nodes as lists of vertices."""
    rows = [(v, k << 5, len(vs), min(vs)) for k, vs in enumerate(nodes) for v in vs]
    near = spark.createDataFrame(rows, "v long, node long, n long, root long")
    members, placed = _placed(near, near.select("node", "root", "n").distinct(), 24, block)
    sizes = [r["count"] for r in placed.groupBy("cell").count().collect()]
    return sum(n * n for n in sizes), max(sizes), {r["whole"] for r in members.collect()}


def test_what_is_compared_grows_with_the_nodes_of_a_chain(spark):
    for n in (300, 600):
        work, _, whole = compared(spark, [[i, i + 1] for i in range(n)], 16)
        assert whole == {False} and work == 4 * n
    work, most, whole = compared(spark, [list(range(100))] * 3, 16)
    assert whole == {True} and work < 4 * 100**2 and most <= 60


def test_tight_clusters_settle_and_others_shorten(spark):
    rng = np.random.default_rng(8)
    base = [f"w{x}" for x in rng.integers(0, 900, 400)]
    texts = []
    for k in range(90):
        b = list(base)
        b[k * 4] = "x"
        texts.append(" ".join(b))
    far = list(base)  # at about 0.82 to each of the cluster
    for k in (37, 99, 160, 222, 281, 333, 351):
        far[k] = "y"
    texts.append(" ".join(far))
    rows = [(i, t) for i, t in enumerate(texts)]
    for block in (384, 16):
        got = jaccard_join(spark.createDataFrame(rows, SCHEMA), block=block).collect()
        assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == brute(rows)


def test_recall_near_the_threshold(spark):
    rng = np.random.default_rng(12)
    rows = []
    for i in range(700):  # pairs at 0.8 to 0.85
        words = [f"w{x}" for x in rng.integers(0, 10**6, 100)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[int(rng.integers(8, 11)) :] + [f"z{x}" for x in rng.integers(0, 10**6, 8)]))]
    want = sum(n for _, _, n in brute_pairs(rows))
    got = jaccard_join(spark.createDataFrame(rows, SCHEMA)).agg(F.sum("n_links")).first()[0]
    assert want > 400 and 0.995 * want <= got <= want


def brute_pairs(rows):
    """As brute, but only neighbours in the list can be linked."""
    out = []
    for (i, a), (j, b) in zip(rows[::2], rows[1::2]):
        x, y = shingles(a), shingles(b)
        n = int(len(x & y) >= 0.8 * len(x | y) - 1e-9)
        out += [(i, i, n), (j, i if n else j, n)]
    return out


def test_texts_of_megabytes(spark):
    rng = np.random.default_rng(1)
    long = " ".join(f"w{x}" for x in rng.integers(0, 10**6, 700_000))
    rows = [(1, long), (2, long + " end"), (3, "short text"), (4, long)]
    got = jaccard_join(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(long) > 4_000_000 and sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == [(1, 1, 2), (2, 1, 2), (3, 3, 0), (4, 1, 2)]
