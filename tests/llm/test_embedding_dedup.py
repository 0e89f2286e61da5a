import numpy as np

from phyllon.llm import embedding_dedup
from phyllon.llm.common import local_roots
from phyllon.llm.embedding_dedup import _labels, group_roots, key_plan, merged_cells, near_duplicates

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, cosine=0.95):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and None not in v and len(v) == 16]
    good = [(i, v / np.linalg.norm(v)) for i, v in good if np.isfinite(v).all() and v.any()]
    x = np.stack([v for _, v in good])
    close = x @ x.T >= cosine
    np.fill_diagonal(close, False)
    ids = np.array([i for i, _ in good])
    root = ids.copy()
    while True:
        new = np.array([min(root[k], *root[close[k]]) if close[k].any() else root[k] for k in range(len(ids))])
        if (new == root).all():
            break
        root = new
    return {int(i): (int(n), int(r)) for i, n, r in zip(ids, close.sum(1), root)}


def test_same_as_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(60, 16))
    vectors = [base[k % 60] + rng.normal(0, (0.05, 0.12, 0.5)[k % 3], 16) for k in range(700)]
    vectors += [vectors[3]] * 20 + [vectors[3] + rng.normal(0, 0.01, 16) for _ in range(60)]
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(vectors)), vectors)]
    want = brute(rows)
    rows += [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] * 16), (9003, [None] + [1.0] * 15), (9004, [1.0, 2.0]), (None, rows[0][1]), (9005, [float("inf")] + [1.0] * 15), (9006, [])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for options in ({"probes": 64}, {"per_cell": 20, "block": 16, "sample": 100, "probes": 64}):
        got = near_duplicates(df, **options).collect()
        assert len(got) == len(rows)
        assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got if r["vec_id"] in want} == want
        for r in got:
            assert r["kept"] == (r["vec_id"] is None or r["vec_id"] == r["component_id"])
            if r["vec_id"] not in want:
                assert (r["n_links"], r["component_id"]) == (0, r["vec_id"])


def test_recall_with_few_probes(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(200, 64))
    rows = [(k, (base[k % 200] + rng.normal(0, (0.05, 0.15, 0.22)[k % 3], 64)).tolist()) for k in range(1500)] + [(5000 + k, rng.normal(size=64).tolist()) for k in range(1500)]
    x = np.array([np.array(v, np.float32) for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.95).sum(1) - 1
    got = {r["vec_id"]: r["n_links"] for r in near_duplicates(spark.createDataFrame(rows, SCHEMA), per_cell=30, probes=6).collect()}
    found = np.array([got[i] for i, _ in rows])
    assert (found <= want).all() and found.sum() >= 0.98 * want.sum() > 1000


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert near_duplicates(spark.createDataFrame([(1, None)], SCHEMA)).collect() == [(1, 0, 1, True)]


def test_no_link_is_lost_in_a_large_group(spark):
    """A third of the vectors are near copies of one centre and draw many centroids: more than `probes` cells are allowed."""
    rng = np.random.default_rng(2)
    n, centre = 24_000, rng.normal(size=64)
    x = np.vstack([centre + rng.normal(0, 0.17, (n // 3, 64)), rng.normal(size=(n - n // 3, 64))]).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA).repartition(4)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = np.concatenate([(x[a : a + 1000] @ x.T >= 0.95).sum(1) for a in range(0, n, 1000)]) - 1
    assert want.sum() > 1_000_000
    got = {r["vec_id"]: r["n_links"] for r in near_duplicates(df).collect()}
    assert np.array_equal([got[i] for i in range(n)], want)


def test_cells_of_a_blur_are_merged():
    """Groups that no vector lies between keep cells of their own; centroids that all vectors of a group may meet at don't."""
    allowed = np.zeros((300, 30), bool)
    for g in range(3):
        allowed[g * 100 : g * 100 + 100, g * 10 : g * 10 + 10] = True
    assert np.array_equal(merged_cells(allowed, 8), np.repeat([0, 1, 2], 10))
    assert not merged_cells(np.ones((50, 20), bool), 64).any()


def test_equal_ids_of_different_vectors(spark):
    e = np.eye(16)
    rows = [(1, e[0]), (1, e[1]), (2, e[0] + 0.01 * e[5]), (3, e[1] + 0.01 * e[6]), (4, e[2]), (4, e[2]), (5, e[2] * 3 + 0.01 * e[7])]
    got = near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in rows], SCHEMA)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 2, 4), (4, 2, 4), (5, 2, 4)]


def test_very_large_and_very_small_components(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(40, 16))
    plain = [base[k % 40] + rng.normal(0, 0.08, 16) for k in range(240)]
    scaled = [v * (1e200, 1e-200, 1.0, 1e305, 1e-300)[k % 5] for k, v in enumerate(plain)]
    schema = "vec_id long, embedding array<double>"
    want = near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(plain)], schema)).collect()
    got = near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(scaled)], schema)).collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in want}
    assert max(r["n_links"] for r in got) > 0


def test_large_cells_compare_candidate_groups_only(spark, monkeypatch):
    """Pairs at the bound, a dense group, a chain, exact copies and 0.0 against -0.0, among vectors that have no near copy and are compared with none."""
    rng = np.random.default_rng(21)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)

    def beside(x, cosine):
        d = rng.normal(size=x.shape)
        d = unit(d - (d * x).sum(-1, keepdims=True) * x)
        return cosine * x + np.sqrt(1 - cosine**2) * d

    lone, ends = unit(rng.normal(size=(2500, 16))), unit(rng.normal(size=(300, 16)))
    others = beside(ends, rng.uniform(0.94, 0.96, (300, 1)))
    dense = unit(unit(rng.normal(size=16)) + rng.normal(0, 0.03, (600, 16)))
    chain = [unit(rng.normal(size=16))]
    for _ in range(30):
        chain.append(beside(chain[-1], 0.951))
    zero = np.eye(16)[:1] + 0.0
    vectors = np.vstack([lone, ends, others, dense, chain, dense[:5], zero, np.where(zero == 0, -0.0, zero)])
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(vectors)), vectors)]
    want, sent = brute(rows), []
    whole = embedding_dedup.cells
    monkeypatch.setattr(embedding_dedup, "cells", lambda members, *a: sent.append(members.select("id").distinct().count()) or whole(members, *a))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for options in ({}, {"per_cell": 200, "probes": 64, "sample": 500}):
        got = near_duplicates(df, key_cost=0, **options).collect()
        assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want
    assert len(got) == len(rows) and max(sent) < 1300


def test_key_plan_counts_on_pairs_at_the_bound():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(20_000, 24))
    d = rng.normal(size=x.shape)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d -= (d * x).sum(1, keepdims=True) * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * d / np.linalg.norm(d, axis=1, keepdims=True)
    g, keys = key_plan(0.95, 200_000, 1e-12, 3)
    for number in range(3):
        same = [_labels(x, g, number, part) == _labels(y, g, number, part) for part in range(4)]
        met = (same[0] & (same[1] | same[2] | same[3])).mean()
        assert (1 - met) ** keys < 1e-12


def test_group_roots_same_as_all_pairs():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 32))
    x = np.vstack([centres[rng.integers(0, 30, 900)] + rng.normal(0, 0.2, (900, 32)), rng.normal(size=(600, 32))])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True))[rng.permutation(1500)].astype(np.float32)
    a, b = np.nonzero(x @ x.T >= 0.95)
    want = local_roots(1500, a, b)
    assert 100 < len(set(want)) < 1400
    for options in ({}, {"step": 64, "columns": 100}, {"step": 2000}):
        assert np.array_equal(group_roots(x, 0.95, **options), want)


def test_cells_that_many_vectors_share_end_in_few_rounds(monkeypatch):
    """All pairs of cells are counted anew in each round, so merging must not take a round for each of a thousand cells."""
    rng, rounds, diag = np.random.default_rng(6), [], np.diag
    monkeypatch.setattr(np, "diag", lambda m: rounds.append(len(m)) or diag(m))
    assert not merged_cells(rng.random((2000, 300)) < 0.15, 8).any()
    groups = np.kron(np.eye(20, dtype=bool), rng.random((100, 20)) < 0.6)
    assert merged_cells(groups, 1).max() > 0
    assert len(rounds) < 60
