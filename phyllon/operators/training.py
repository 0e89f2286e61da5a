"""Training of per-crop heads, losses and epoch metrics."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from phyllon.functions.columns import is_correct, smoothed_cross_entropy
from phyllon.operators.dataset import assign_batches


def cosine_lr(config: DataFrame, high: float = 3e-4, low: float = 1e-6) -> DataFrame:
    """(crop, epoch, lr) for each epoch from 1 of each crop (crop, epochs)."""
    rows = config.select("crop", "epochs", F.explode(F.sequence(F.lit(1), F.col("epochs"))).alias("epoch"))
    return rows.select("crop", "epoch", (low + (high - low) * (1 + F.cos(F.lit(math.pi) * (F.col("epoch") - 1) / F.col("epochs"))) / 2).alias("lr"))


def sample_losses(samples: DataFrame, eps: float = 0.1) -> DataFrame:
    """samples (logits, class_idx, ...) with loss and correct."""
    return samples.withColumn("loss", smoothed_cross_entropy("logits", "class_idx", eps)).withColumn("correct", is_correct("logits", "class_idx"))


def epoch_metrics(batches: DataFrame) -> DataFrame:
    """Per (crop, epoch, phase) of batches (n, loss, n_ok): the row-weighted mean loss and accuracy in percent; null for no rows."""
    n = F.nullif(F.sum("n"), F.lit(0))
    return batches.groupBy("crop", "epoch", "phase").agg((F.sum(F.col("loss") * F.col("n")) / n).alias("loss"), (F.sum("n_ok") * 100.0 / n).alias("acc"))


def epoch_table(metrics: DataFrame) -> DataFrame:
    """A row an epoch: train_loss, train_acc, val_loss, val_acc."""
    pick = lambda phase, c: F.max(F.when(F.col("phase") == phase, F.col(c)))
    return metrics.groupBy("crop", "epoch").agg(*(pick(p, c).alias(f"{p}_{c}") for p in ("train", "val") for c in ("loss", "acc")))


def mark_best(metrics: DataFrame) -> DataFrame:
    """metrics (crop, epoch, val_acc) with is_best: over all earlier epochs' val_acc, and over 0."""
    earlier = W.partitionBy("crop").orderBy("epoch").rowsBetween(W.unboundedPreceding, -1)
    return metrics.withColumn("is_best", F.coalesce(F.col("val_acc") > F.greatest(F.lit(0.0), F.coalesce(F.max("val_acc").over(earlier), F.lit(0.0))), F.lit(False)))


def best_epoch(metrics: DataFrame) -> DataFrame:
    """Per crop the epoch of the highest val_acc, the earliest of equal ones; no row if it's never over 0."""
    best = metrics.filter("val_acc > 0").groupBy("crop").agg(F.max(F.struct("val_acc", (-F.col("epoch")).alias("neg"))).alias("b"))
    return best.select("crop", (-F.col("b.neg")).alias("epoch"), F.col("b.val_acc").alias("val_acc"))


def model_meta(metrics: DataFrame, report: DataFrame) -> DataFrame:
    """Per crop its history (rounded), its best epoch and what the report says."""
    r = lambda c, n: F.round(c, n).alias(c)
    entry = F.struct("epoch", r("train_loss", 4), r("train_acc", 2), r("val_loss", 4), r("val_acc", 2))
    history = metrics.groupBy("crop").agg(F.array_sort(F.collect_list(entry)).alias("history"))  # an entry an epoch
    best = best_epoch(metrics).select("crop", F.col("epoch").alias("best_epoch"), F.round("val_acc", 2).alias("best_val_acc"))
    return history.join(best, "crop", "left").join(report, "crop", "left")


#: What a partition adds for a crop and split: rows, correct ones, steps taken and a packed vector, whose first value is the loss.
SUMS = "crop string, split string, part int, n long, ok long, steps long, sums binary"
#: Partitions whose sums meet in one task of the first merge.
FAN_IN = 256

Head = tuple[np.ndarray, np.ndarray]


class Adam:
    """AdamW's state of one head: weights with the bias as last row, both moments and the steps taken."""

    def __init__(self, d: int, k: int) -> None:
        self.w, self.m, self.v, self.steps = np.zeros((d + 1, k)), np.zeros((d + 1, k)), np.zeros((d + 1, k)), 0

    def step(self, grad: np.ndarray, rate: float, decay: float) -> None:
        self.steps += 1
        self.m = self.m + 0.1 * (grad - self.m)
        self.v = self.v + 0.001 * (grad**2 - self.v)
        self.w = self.w * (1 - rate * decay) - rate * (self.m / (1 - 0.9**self.steps)) / (np.sqrt(self.v / (1 - 0.999**self.steps)) + 1e-8)

    def packed(self) -> np.ndarray:
        return np.concatenate([self.w.ravel(), self.m.ravel(), self.v.ravel()])

    def unpacked(self, flat: np.ndarray, steps: int) -> "Adam":
        out = Adam(self.w.shape[0] - 1, self.w.shape[1])
        out.w, out.m, out.v = (x.reshape(self.w.shape) for x in np.split(flat, 3))
        out.steps = steps
        return out

    def head(self) -> Head:
        return self.w[:-1], self.w[-1]


def prepare_batches(samples: DataFrame, size: int = 32) -> DataFrame:
    """samples (sample_id, crop, split, ...) with their mini-batch, each batch whole in one partition. The features move once, not in each epoch."""
    return assign_batches(samples, size).repartition("crop", "split", "batch")


def train_heads(
    samples: DataFrame, epochs: int | dict[str, int] = 15, high: float = 3e-4, low: float = 1e-6, decay: float = 1e-4, eps: float = 0.1, batches: bool = False
) -> tuple[dict[str, Head], list[dict]]:
    """A linear head for each crop of samples (crop, features, class_idx, n_classes, split): weights and bias, and the epoch history.

    AdamW with label smoothing and a rate that is cosine-annealed over the crop's epochs (one number, or one a crop). Each epoch is one pass over all
    crops, all partitions at once: it trains on split `train` and gives the metrics of the other splits after the epoch before. Partitions add up their own
    sums, tasks merge the sums of up to 256 partitions and then those, and the driver gets a row for each crop and split. A crop that is finished
    drops out of later passes. samples should be a stored table.

    Without batches an epoch is one step along the gradient of all rows; the result doesn't depend on the partitions but by rounding. With batches, samples
    come from prepare_batches (sample_id, batch): each partition takes a step for each of its batches, in an order that is shuffled for each epoch, from the
    epoch's common start, and the heads and moments of all partitions are averaged by their rows. On one partition that is plain mini-batch AdamW; on many it's
    local steps with averaging, and the epoch's train metrics are those of the batches before their steps.

    The weights are those after the epoch of the highest accuracy on `val`, the earliest of equal ones; the last epoch's if it's never over 0.
    """
    dims = samples.groupBy("crop").agg(F.max("n_classes").alias("k"), F.max(F.size("features")).alias("d")).collect()  # a row a crop
    states = {r["crop"]: Adam(r["d"], r["k"]) for r in dims}
    last = {c: epochs[c] if isinstance(epochs, dict) else epochs for c in states}
    best: dict[str, tuple[float, Head]] = {}
    history: list[dict] = []
    for epoch in range(1, max(last.values(), default=0) + 2):
        rates = {c: low + (high - low) * (1 + math.cos(math.pi * (epoch - 1) / n)) / 2 for c, n in last.items() if n}
        now = samples.sparkSession.sparkContext.broadcast((states, rates))
        training = F.col("crop").isin([c for c, n in last.items() if epoch <= n])
        judged = F.col("crop").isin([c for c, n in last.items() if 1 < epoch <= n + 1])
        rows = samples.filter(F.col("split").isNotNull() & F.when(F.col("split") == "train", training).otherwise(judged))
        if batches:
            order = F.md5(F.concat("batch", F.lit(f":{epoch}")))
            rows = rows.select("crop", "split", "batch", "features", "class_idx", "sample_id").sortWithinPartitions("crop", "split", order, "batch", "sample_id")
        else:
            rows = rows.select("crop", "split", F.lit(0).alias("batch"), "features", "class_idx")
        sums = _merged(rows.mapInPandas(_epoch(now, eps, decay, batches), SUMS)).collect()  # a row for each crop and split
        now.destroy()
        before, states = states, dict(states)
        for r in sorted(sums, key=lambda r: (r["crop"], r["split"])):
            crop, split, n, total = r["crop"], r["split"], r["n"], np.frombuffer(bytes(r["sums"]))
            history.append({"crop": crop, "epoch": epoch if split == "train" else epoch - 1, "phase": split, "n": n, "loss": float(total[0]) / n, "n_ok": r["ok"]})
            if split == "val" and r["ok"] / n > best.get(crop, (0.0,))[0]:
                best[crop] = r["ok"] / n, before[crop].head()
            if split == "train" and batches:
                states[crop] = before[crop].unpacked(total[1:] / n, r["steps"])
            elif split == "train":
                states[crop] = before[crop].unpacked(before[crop].packed(), before[crop].steps)
                states[crop].step(total[1:].reshape(states[crop].w.shape) / n, rates[crop], decay)
    return {c: best[c][1] if c in best else state.head() for c, state in states.items()}, history


def _merged(rows: DataFrame) -> DataFrame:
    """Sums of partitions to one row for each crop and split, in two levels, always in order of the partitions' numbers."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        total = sum(np.frombuffer(x) for x in pdf["sums"])
        return pd.DataFrame([(*pdf[["crop", "split", "part"]].iloc[0], pdf["n"].sum(), pdf["ok"].sum(), pdf["steps"].max(), total.tobytes())], columns=list(pdf.columns[:7]))

    first = rows.withColumn("salt", F.floor(F.col("part") / FAN_IN)).groupBy("crop", "split", "salt").applyInPandas(lambda pdf: add(pdf.drop(columns="salt")), SUMS)
    return first.groupBy("crop", "split").applyInPandas(add, SUMS)


def _gradient(w: np.ndarray, part: pd.DataFrame, eps: float) -> tuple[np.ndarray, float, int]:
    """Of the smoothed loss, summed over the rows: gradient, loss and correct rows."""
    x, y = np.stack(part["features"].to_numpy()), part["class_idx"].to_numpy()
    z = x @ w[:-1] + w[-1]
    z = z - z.max(1, keepdims=True)
    lp = z - np.log(np.exp(z).sum(1, keepdims=True))
    goal = np.full(lp.shape, eps / lp.shape[1])
    goal[np.arange(len(y)), y] += 1 - eps
    err = np.exp(lp) - goal
    return np.vstack([x.T @ err, err.sum(0)]), float(-(goal * lp).sum()), int((lp.argmax(1) == y).sum())


def _stretches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one crop, split and batch that stand together, also over the ends of Arrow batches."""
    rest = None
    for pdf in parts:
        keys = pdf[["crop", "split", "batch"]].ne(pdf[["crop", "split", "batch"]].shift()).any(axis=1).cumsum()
        for _, part in pdf.groupby(keys, sort=False):
            if rest is not None and tuple(rest[["crop", "split", "batch"]].iloc[-1]) == tuple(part[["crop", "split", "batch"]].iloc[0]):
                rest = pd.concat([rest, part])
            else:
                if rest is not None:
                    yield rest
                rest = part
    if rest is not None:
        yield rest


def _epoch(now, eps: float, decay: float, batches: bool):
    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states, rates = now.value
        total: dict[tuple[str, str], list] = {}
        own: dict[str, Adam] = {}
        groups = _stretches(parts) if batches else (g for pdf in parts for _, g in pdf.groupby(["crop", "split"]))
        for part in groups:
            crop, split = part["crop"].iloc[0], part["split"].iloc[0]
            stepping = batches and split == "train"
            state = own.setdefault(crop, states[crop].unpacked(states[crop].packed(), states[crop].steps)) if stepping else states[crop]
            grad, loss, ok = _gradient(state.w, part, eps)
            t = total.setdefault((crop, split), [0, 0, 0.0, np.zeros_like(grad)])
            t[0], t[1], t[2] = t[0] + len(part), t[1] + ok, t[2] + loss
            if stepping:
                state.step(grad / len(part), rates[crop], decay)
            elif split == "train":
                t[3] += grad
        task = TaskContext.get().partitionId()
        out = []
        for (crop, split), (n, ok, loss, grad) in total.items():
            rest = np.empty(0) if split != "train" else n * own[crop].packed() if batches else grad.ravel()
            out.append((crop, split, task, n, ok, own[crop].steps if crop in own and split == "train" else 0, np.concatenate([[loss], rest]).tobytes()))
        if out:
            yield pd.DataFrame(out, columns=["crop", "split", "part", "n", "ok", "steps", "sums"])

    return each


def trainable_crops(samples: DataFrame, config: DataFrame, epochs: int | None = None) -> DataFrame:
    """(crop, status, error, wanted) of every configured crop: wanted epochs, and what keeps it from being trained.

    A crop fails if it has no training rows or no epochs; if features are null, hold nulls, NaN or infinity, or differ in length; if a class is null or not one of
    its classes, or their number is null or differs. Nothing else than such rows could stop a pass, so a crop without them can't be stopped by others.
    """
    unsound = F.coalesce(F.exists("features", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))
    lost = F.col("class_idx").isNull() | F.col("n_classes").isNull()
    beyond = (F.col("class_idx") < 0) | (F.col("class_idx") >= F.col("n_classes"))
    found = (
        F.when(F.bool_or(unsound), "features missing or not finite")
        .when(F.min(F.size("features")) != F.max(F.size("features")), "features differ in length")
        .when(F.bool_or(lost), "class missing")
        .when(F.min("n_classes") != F.max("n_classes"), "classes differ in number")
        .when(F.bool_or(beyond), "class index out of range")
    )
    checked = samples.groupBy("crop").agg(F.sum(F.coalesce((F.col("split") == "train").cast("int"), F.lit(0))).alias("n"), found.alias("error"))
    rows = config.select("crop", (F.col("epochs") if epochs is None else F.lit(epochs)).alias("wanted")).join(checked, "crop", "left")
    none = F.when(F.coalesce("n", F.lit(0)) == 0, "no training rows").when(F.coalesce("wanted", F.lit(0)) < 1, "no epochs")
    rows = rows.withColumn("error", none.otherwise(F.col("error")))
    return rows.select("crop", F.when(F.col("error").isNull(), "ok").otherwise("failed").alias("status"), "error", "wanted")


class Trained(NamedTuple):
    """status (crop, status, error, epochs, best_val_acc), history (crop, epoch, phase, n, loss, n_ok) and heads (crop, weights, bias) of a training run."""

    status: DataFrame
    history: DataFrame
    heads: DataFrame


def train_models(samples: DataFrame, config: DataFrame, epochs: int | None = None, batch_size: int | None = None, **options) -> Trained:
    """Trains every configured crop that can be (see trainable_crops), each for its epochs of config (crop, epochs), or all for those given.

    With batch_size by mini-batches (samples need sample_id). A crop whose loss doesn't stay finite fails alone: it has a history, but no head. samples are
    read again in each pass, so they are kept in Spark's cache meanwhile. weights are rows a feature, one after another. history feeds
    epoch_metrics, epoch_table and model_meta; heads feed write_heads.
    """
    spark = config.sparkSession
    held = (prepare_batches(samples, batch_size) if batch_size else samples).persist()
    try:
        rows = trainable_crops(held, config, epochs).collect()  # a row a crop
        wanted = {r["crop"]: r["wanted"] for r in rows if r["status"] == "ok"}
        heads, history = train_heads(held.filter(F.col("crop").isin(list(wanted))), wanted, batches=bool(batch_size), **options) if wanted else ({}, [])
    finally:
        held.unpersist()
    lost = {h["crop"] for h in history if not math.isfinite(h["loss"])}
    best: dict[str, float] = {}
    for h in history:
        if h["phase"] == "val":
            best[h["crop"]] = max(best.get(h["crop"], 0.0), h["n_ok"] * 100.0 / h["n"])
    status = []
    for r in rows:
        error = r["error"] or ("loss not finite" if r["crop"] in lost else None)
        status.append((r["crop"], "failed" if error else "ok", error, None if r["error"] else r["wanted"], None if error else best.get(r["crop"])))
    return Trained(
        spark.createDataFrame(status, "crop string, status string, error string, epochs int, best_val_acc double"),
        spark.createDataFrame([tuple(h.values()) for h in history], "crop string, epoch int, phase string, n long, loss double, n_ok long"),
        spark.createDataFrame([(c, w.ravel().tolist(), b.tolist()) for c, (w, b) in heads.items() if c not in lost], "crop string, weights array<double>, bias array<double>"),
    )


def train_all(samples: DataFrame, config: DataFrame, epochs: int | None = None, **options) -> DataFrame:
    """(crop, status, error, epochs, best_val_acc) of every configured crop; a bad crop doesn't stop the others. See train_models."""
    return train_models(samples, config, epochs, **options).status
