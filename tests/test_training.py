"""Training of heads against plain NumPy, its jobs, its isolation, and what comes out of it."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from phyllon.operators import dataset, scoring, training
from phyllon.sources import images, models

SCHEMA = "sample_id long, crop string, features array<double>, class_idx int, n_classes int, split string"


def samples(spark, crops=("rice", "onion"), n=90, parts=4):
    rng = np.random.default_rng(7)
    rows = []
    for c, crop in enumerate(crops):
        middles = rng.normal(size=(3, 5)) * 2
        for i in range(n):
            k = int(rng.integers(2 + c))
            rows.append((c * 1000 + i, crop, (middles[k] + rng.normal(size=5)).tolist(), k, 2 + c, "val" if i % 5 == 0 else "train"))
    return spark.createDataFrame(rows, SCHEMA).repartition(parts, "sample_id")


def arrays(df, crop, split, *order):
    rows = df.filter((F.col("crop") == crop) & (F.col("split") == split)).orderBy(*order or ["sample_id"]).collect()
    return np.array([r["features"] for r in rows]), np.array([r["class_idx"] for r in rows]), rows


def loss_and_gradient(w, x, y, eps=0.1):
    z = x @ w[:-1] + w[-1]
    lp = z - np.log(np.exp(z).sum(1, keepdims=True))
    goal = (1 - eps) * np.eye(w.shape[1])[y] + eps / w.shape[1]
    err = (np.exp(lp) - goal) / len(y)
    return -(goal * lp).sum() / len(y), np.vstack([x.T @ err, err.sum(0)])


def adamw(w, m, v, t, grad, rate, decay=1e-4):
    m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
    return w * (1 - rate * decay) - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8), m, v


def rate(epoch, n, high, low=1e-6):
    return low + (high - low) * (1 + math.cos(math.pi * (epoch - 1) / n)) / 2


def accuracy(w, x, y):
    return int(((x @ w[:-1] + w[-1]).argmax(1) == y).sum())


def plain_training(df, crop, epochs, high, size=None):
    """Weights of the best epoch and losses of the epochs, by NumPy alone; with size by mini-batches."""
    x, y, rows = arrays(df, crop, "train")
    vx, vy, _ = arrays(df, crop, "val")
    k = rows[0]["n_classes"]
    w, m, v, t = np.zeros((6, k)), 0.0, 0.0, 0
    losses, best, found = [], 0, None
    for epoch in range(1, epochs + 1):
        if size is None:
            steps = [np.arange(len(y))]
        else:
            batch = np.array([r["batch"] for r in rows])
            names = sorted(set(batch.tolist()), key=lambda b: hashlib.md5(f"{b}:{epoch}".encode()).hexdigest())
            steps = [np.flatnonzero(batch == b) for b in names]
        total = 0.0
        for at in steps:
            loss, grad = loss_and_gradient(w, x[at], y[at])
            total, t = total + loss * len(at), t + 1
            w, m, v = adamw(w, m, v, t, grad, rate(epoch, epochs, high))
        losses.append(total / len(y))
        if accuracy(w, vx, vy) > best:
            best, found = accuracy(w, vx, vy), w
    return found, losses


def losses_of(history, crop):
    return [h["loss"] for h in sorted(history, key=lambda h: h["epoch"]) if h["crop"] == crop and h["phase"] == "train"]


@pytest.mark.parametrize("parts", [1, 7])
def test_full_batch_is_numpy_s_in_any_partitioning(spark, parts):
    df = samples(spark, parts=parts)
    heads, history = training.train_heads(df, {"rice": 4, "onion": 6}, high=0.1)
    for crop, epochs in (("rice", 4), ("onion", 6)):
        want, losses = plain_training(df, crop, epochs, 0.1)
        assert np.allclose(np.vstack(heads[crop]), want, atol=1e-9)
        assert np.allclose(losses_of(history, crop), losses, atol=1e-9)
    assert {(h["crop"], h["phase"]): h["n"] for h in history} == {(c, p): n for c in ("rice", "onion") for p, n in (("train", 72), ("val", 18))}


def test_mini_batches_on_one_partition_are_numpy_s(spark):
    df = dataset.assign_batches(samples(spark), 16).coalesce(1).persist()
    heads, history = training.train_heads(df, 3, high=0.05, batches=True)
    for crop in ("rice", "onion"):
        want, losses = plain_training(df, crop, 3, 0.05, size=16)
        assert np.allclose(np.vstack(heads[crop]), want, atol=1e-9)
        assert np.allclose(losses_of(history, crop), losses, atol=1e-9)
    df.unpersist()


def test_mini_batches_lower_the_loss_faster(spark):
    df = samples(spark, n=400)
    _, full = training.train_heads(df, 3, high=0.01)
    batched = training.prepare_batches(df, 16).persist()
    _, local = training.train_heads(batched, 3, high=0.01, batches=True)
    again = training.train_heads(batched, 3, high=0.01, batches=True)[1]
    batched.unpersist()
    for crop in ("rice", "onion"):
        assert losses_of(local, crop)[-1] < losses_of(full, crop)[-1] - 0.05
    assert local == again


def test_batches_stay_whole_in_a_partition(spark):
    held = training.prepare_batches(samples(spark, n=300), 16).withColumn("p", F.spark_partition_id())
    assert held.groupBy("crop", "split", "batch").agg(F.count_distinct("p").alias("n")).filter("n > 1").count() == 0


def test_a_pass_is_as_many_jobs_for_any_number_of_partitions(spark):
    sc, jobs = spark.sparkContext, {}
    for parts in (2, 24):
        df = samples(spark, parts=parts).persist()
        df.count()
        sc.setJobGroup(f"pass{parts}", "")
        training.train_heads(df, 1)
        jobs[parts] = len(sc.statusTracker().getJobIdsForGroup(f"pass{parts}"))
        df.unpersist()
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[2] == jobs[24]


BAD = {
    "null features": ("f", None, 0, 2, "features missing or not finite"),
    "a null in features": ("f", [1.0, None], 0, 2, "features missing or not finite"),
    "nan in features": ("f", [1.0, math.nan], 0, 2, "features missing or not finite"),
    "infinity in features": ("f", [-math.inf, 1.0], 0, 2, "features missing or not finite"),
    "shorter features": ("f", [1.0], 0, 2, "features differ in length"),
    "null class": ("f", [1.0, 0.0], None, 2, "class missing"),
    "null number of classes": ("f", [1.0, 0.0], 1, None, "class missing"),
    "negative class": ("f", [1.0, 0.0], -1, 2, "class index out of range"),
    "class beyond": ("f", [1.0, 0.0], 2, 2, "class index out of range"),
    "other number of classes": ("f", [1.0, 0.0], 2, 3, "classes differ in number"),
}


def test_a_bad_crop_stops_no_other(spark):
    rows, config = [], []
    for name, (_, features, k, n, _) in BAD.items():
        rows += [(i, name, [float(i), 1.0], i % 2, 2, "train") for i in range(4)] + [(9, name, features, k, n, "train")]
        config.append((name, 2))
    huge = [(i, "huge", [1.7e308, 1.0], int(i == 0), 2, "train") for i in range(9)]
    rows += [(i, "good", [float(i % 2), 1.0], i % 2, 2, "val" if i > 6 else "train") for i in range(9)] + huge + [(5, "good", [1.0, 1.0], 1, 2, None), (1, None, [1.0], 0, 2, "train")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    status = {r["crop"]: r for r in training.train_all(df, spark.createDataFrame([*config, ("good", 2), ("huge", 3), ("absent", 1)], "crop string, epochs int"), high=0.1).collect()}
    assert {c: status[c]["error"] for c in BAD} == {c: b[-1] for c, b in BAD.items()}
    assert (status["good"]["status"], status["good"]["epochs"]) == ("ok", 2) and status["good"]["best_val_acc"] > 0
    assert (status["huge"]["status"], status["huge"]["error"]) == ("failed", "loss not finite")
    assert status["absent"]["error"] == "no training rows"
    clean = training.train_heads(df.filter("crop = 'good'"), 2, high=0.1)[0]["good"]
    both = training.train_models(df, spark.createDataFrame([*config, ("good", 2)], "crop string, epochs int"), high=0.1).heads.collect()
    assert [r["crop"] for r in both] == ["good"] and np.allclose(both[0]["weights"], clean[0].ravel())


def test_no_crop_to_train(spark):
    out = training.train_models(samples(spark).limit(0), spark.createDataFrame([("rice", 3)], "crop string, epochs int"))
    assert [tuple(r) for r in out.status.collect()] == [("rice", "failed", "no training rows", None, None)]
    assert out.history.count() == out.heads.count() == 0


def test_from_training_to_models_and_metadata(spark, tmp_path):
    df = samples(spark, n=200)
    config = spark.createDataFrame([("rice", ["healthy", "blast"], 4), ("onion", ["healthy", "blotch", "rot"], 3), ("wheat", ["rust"], 2)], "crop string, classes array<string>, epochs int")
    out = training.train_models(df, config, batch_size=16, high=0.05)
    assert {(r["crop"], r["status"]) for r in out.status.collect()} == {("rice", "ok"), ("onion", "ok"), ("wheat", "failed")}

    models.write_heads(out.heads, f"{tmp_path}/heads")
    scored = scoring.predictions(scoring.score(df, models.load_heads(spark, f"{tmp_path}/heads")), config)
    right = scored.withColumn("ok", F.col("disease") == F.get("classes", F.col("class_idx"))).filter("split = 'val'").groupBy("crop").agg(F.avg(F.col("ok").cast("int")) * 100)
    best = {r["crop"]: r["best_val_acc"] for r in out.status.collect()}
    assert {c: pytest.approx(best[c]) for c in ("rice", "onion")} == {r[0]: r[1] for r in right.collect()}
    unknown = scoring.score(spark.createDataFrame([("wheat", [0.0] * 5)], "crop string, features array<double>"), models.load_heads(spark, f"{tmp_path}/heads"))
    assert unknown.first()["logits"] is None

    named = df.withColumn("label", F.concat(F.lit("c"), "class_idx"))
    meta = training.model_meta(training.epoch_table(training.epoch_metrics(out.history)), dataset.class_report(config, named))
    images.write_model_meta(meta, f"{tmp_path}/meta")
    back = {r["crop"]: r for r in spark.read.json(f"{tmp_path}/meta").collect()}
    assert [len(back[c]["history"]) for c in ("rice", "onion")] == [4, 3]
    assert back["rice"]["best_val_acc"] == pytest.approx(best["rice"], abs=0.01)
