import numpy as np
from pyspark.sql import functions as F

from phyllon.llm.toxicity import _threshold, features_of, label_categories, score_toxicity, train_chain

BAD = ["clod", "dolt", "oaf"]


def corpus(n=1200, seed=0):
    rng = np.random.default_rng(seed)
    words = [f"{a}{b}" for a in "bcdfgklmnprst" for b in ("ala", "ebe", "imi", "oro", "unu")]
    rows = []
    for i in range(n):
        text = list(rng.choice(words, int(rng.integers(5, 300))))
        toxic, low = i % 6 == 0, i % 5 == 0
        if toxic:
            for _ in range(int(rng.integers(1, 4))):
                text.insert(int(rng.integers(len(text))), str(rng.choice(BAD)))
        if low:
            text += ["buy", "now"] * 3
        rows.append((i, " ".join(text).capitalize() + ".", int(not low), int(toxic)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in rows if i < 800] + [(None, 1, 1), (3, None, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    chain = train_chain(docs, label_categories(labels), ("low_quality", "toxic"))
    got = {r["doc_id"]: r for r in score_toxicity(docs, chain).collect()}
    held = [r for r in rows if r[0] >= 800]
    assert np.mean([got[i]["rejected"] == bool(t) for i, _, _, t in held]) > 0.98
    assert np.mean([(got[i]["p_low_quality"] > 0.5) == (not q) for i, _, q, _ in held]) > 0.98
    again = train_chain(docs.repartition(5), label_categories(labels), ("low_quality", "toxic"))
    assert again.words == chain.words and all(np.array_equal(a, b) for a, b in zip(again.weights, chain.weights))


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", None), (None, "x " * 50_000, 1), (1, None, 5)], "doc_id long, text string, extra int").withColumn("rejected", F.lit("old"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    chain = train_chain(docs, label_categories(none), ("low_quality", "toxic"))
    got = score_toxicity(docs, chain).collect()
    assert len(got) == 4 and not any(r["rejected"] for r in got) and [r["extra"] for r in got] == [5, None, 1, 5]
    assert score_toxicity(docs.limit(0), chain).collect() == []
    one = spark.createDataFrame([(7, 1, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(7, "a b"), (8, "c")], "doc_id long, text string")
    chain = train_chain(some, label_categories(one), ("low_quality", "toxic"))
    assert not any(r["rejected"] for r in score_toxicity(some, chain).collect())


def dense_fit(x, y, ridge=0.5):
    """Logistic regression by plain Newton steps until they stand still."""
    x = np.column_stack([x, np.ones(len(x))])
    held = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + held, x.T @ (p - y) + held @ w)
        w -= step / max(1, np.abs(step).max() / 2)
    return lambda z: 1 / (1 + np.exp(-np.column_stack([z, np.ones(len(z))]) @ w))


def test_same_as_a_plain_chain(spark):
    rows = corpus(300, seed=4)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in rows], "doc_id long, quality int, toxic int")
    chain = train_chain(docs, label_categories(labels), ("low_quality", "toxic"))
    # The features whose share of a class is six deviations off.
    sets = [features_of(t) for _, t, _, _ in rows]
    y = np.array([[1 - q, t] for _, _, q, t in rows])
    every = sorted(set().union(*sets))
    x = np.array([[f in s for f in every] for s in sets], float)
    df, share = x.sum(0), y.mean(0)
    off = np.stack([np.abs(x.T @ y[:, k] - df * p) / np.sqrt(df * p * (1 - p) + 1) for k, p in enumerate(share)]).max(0)
    assert list(chain.words) == [f for f, o in zip(every, off) if o >= 6]
    x = x[:, off >= 6]
    # Each category's model sees the earlier one's out-of-fold probabilities in training, and its own model's in scoring.
    hashes = {r[0]: r[1] for r in docs.selectExpr("doc_id", "xxhash64(doc_id)").collect()}
    fold, seen, scored = np.argsort(np.argsort([hashes[i] for i, *_ in rows])) % 3, np.zeros((len(rows), 0)), np.zeros((len(rows), 0))
    for k in range(2):
        out = np.zeros(len(rows))
        for f in range(3):
            a = np.column_stack([x, seen])
            out[fold == f] = dense_fit(a[fold != f], y[fold != f, k])(a[fold == f])
        scored = np.column_stack([scored, dense_fit(np.column_stack([x, seen]), y[:, k])(np.column_stack([x, scored]))])
        seen = np.column_stack([seen, out])
    got = {r["doc_id"]: r for r in score_toxicity(docs, chain).collect()}
    for k, c in enumerate(("p_low_quality", "p_toxic")):
        assert np.abs(scored[:, k] - np.array([got[i][c] for i, *_ in rows])).max() < 1e-3
    best = max(sorted(set(seen[:, 1])), key=lambda t: 2 * (y[seen[:, 1] >= t, 1]).sum() / ((seen[:, 1] >= t).sum() + y[:, 1].sum()))
    assert np.array_equal(np.array([got[i]["rejected"] for i, *_ in rows]), scored[:, 1] > chain.thresholds[1]) and chain.thresholds[1] <= best + 1e-3


def test_contradicting_labels_and_repeated_ids(spark):
    rows = corpus(240, seed=5)
    docs = spark.createDataFrame([r[:2] for r in rows] + [r[:2] for r in rows[:50]] + [(0, "zzz other text")], "doc_id long, text string")
    given = [(i, q, t) for i, _, q, t in rows] + [(i, 1, 0) for i, *_ in rows[:100]] + [(10**6 + i, 1, 1) for i in range(900)]
    one, two = (train_chain(docs.repartition(n), label_categories(spark.createDataFrame(given[::s], "doc_id long, quality int, toxic int").repartition(n)), ("low_quality", "toxic"), sample=200) for n, s in ((1, 1), (5, -1)))
    assert one.words == two.words and one.thresholds == two.thresholds and all(np.array_equal(a, b) for a, b in zip(one.weights, two.weights))
    assert set(BAD) & set(one.words)  # labels without a document don't take the sample's places


def test_thresholds():
    p = np.array([0.9, 0.8, 0.3, 0.2, 0.1])
    assert _threshold(p, np.array([1, 1, 1, 0, 0])) == 0.25
    assert _threshold(p, np.array([0, 0, 0, 0, 1])) == 0.5  # no gap has most rows of the class above it
    assert _threshold(np.full(5, 0.2), np.array([1, 0, 0, 0, 0])) == 0.5  # equal probabilities have no gap but the last
    assert _threshold(p, np.zeros(5)) == _threshold(p, np.ones(5)) == 0.5


def test_features_that_do_not_tell_reject_nothing(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(["ala", "bebe", "coco", "didi"], 9)), 1, int(i % 6 == 0)) for i in range(120)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in rows], "doc_id long, quality int, toxic int")
    assert score_toxicity(docs, train_chain(docs, label_categories(labels), ("low_quality", "toxic"))).filter("rejected").count() == 0
