"""Toxicity: a classifier chain over word features, trained on a bounded sample of labelled rows."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, slices, written

_letters = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Chain:
    """categories in order; words (features) with their column; weights[k] has a column for each feature, one for each earlier category, and the bias; thresholds[k] is where a row counts as one of the category."""

    categories: tuple[str, ...]
    words: dict[str, int]
    weights: tuple[np.ndarray, ...]
    thresholds: tuple[float, ...]

    def probabilities(self, at: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """(n, categories) from the pairs (row, column) of the words that occur."""
        out = np.zeros((n, len(self.categories)))
        for k, w in enumerate(self.weights):
            z = np.bincount(row, w[at], n) + out[:, :k] @ w[len(self.words) : -1] + w[-1]
            out[:, k] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return out


def parts_of(word: str) -> list[str]:
    """A word's features: the word, and its first 3 to 8 letters (with a dash) where it's longer."""
    return [word, *(f"{word[:k]}-" for k in range(3, min(9, len(word))))]


def features_of(text: str) -> set[str]:
    """The distinct features of a text, in training and in scoring."""
    return {x for w in set(_letters.findall(text.lower())) for x in parts_of(w)}


def _occurring(texts: list[str | None], words: dict[str, int], known: dict[str, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (column, row) of the features that occur. known remembers words' columns, for speed; it's emptied when it's large."""
    at, row = [], []
    for i, text in enumerate(texts):
        if text:
            if len(known) > 100_000:
                known.clear()
            found: set[int] = set()
            for w in set(_letters.findall(text.lower())):
                ids = known.get(w)
                if ids is None:
                    ids = known[w] = tuple(words[x] for x in parts_of(w) if x in words)
                if ids:
                    found.update(ids)
            at += found
            row += [i] * len(found)
    return np.array(at, np.int64), np.array(row, np.int64)


def _row_sums(x: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Sums of x by row; the rows follow each other in x and have lens entries."""
    out, some = np.zeros(len(lens)), lens > 0
    if some.any():
        out[some] = np.add.reduceat(x, (np.cumsum(lens) - lens)[some])
    return out


def _fit(at: np.ndarray, lens: np.ndarray, extra: np.ndarray, y: np.ndarray, width: int, ridge: float, steps: int = 8, inner: int = 12) -> np.ndarray:
    """Logistic regression with a ridge (not on the bias), by Newton steps that conjugate gradients solve. at: the columns of each row, lens: how many."""
    n, k = extra.shape
    w = np.zeros(width + k + 1)
    if not n:
        w[-1] = -40.0
        return w
    held = np.full(width + k + 1, ridge)
    held[-1] = 1e-6
    into = lambda v: _row_sums(v[at], lens) + extra @ v[width:-1] + v[-1]
    back = lambda g: np.r_[np.bincount(at, np.repeat(g, lens), width), extra.T @ g, g.sum()]
    cost = lambda z, v: np.logaddexp(0, z).sum() - z @ y + (held * v * v).sum() / 2
    pi = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w[-1] = math.log(pi / (1 - pi))
    z = into(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        grad = back(p - y) + held * w
        curve = p * (1 - p)
        scale = np.r_[np.bincount(at, np.repeat(curve, lens), width), (extra**2).T @ curve, curve.sum()] + held
        d, r = np.zeros_like(w), -grad
        q = r / scale
        s, rq = q.copy(), r @ q
        goal = rq * 1e-4
        for _ in range(inner):
            hs = back(curve * into(s)) + held * s
            a = rq / (s @ hs)
            d += a * s
            r -= a * hs
            q = r / scale
            new = r @ q
            if new < goal:
                break
            s, rq = q + new / rq * s, new
        dz, now, step = into(d), cost(z, w), 1.0
        while step > 1e-4 and cost(z + step * dz, w + step * d) > now + 1e-4 * step * (grad @ d):
            step /= 2
        w, z = w + step * d, z + step * dz
        if -(grad @ d) < 1e-6 * n:
            break
    return w


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Where probabilities that didn't see their row part the classes best: in the middle of the gap with the best F1 above which most rows are of the class.

    0.5 where there's no such gap (the features don't tell) or where all rows are of one class.
    """
    order = np.argsort(-p, kind="stable")
    at, hit = np.append(p[order], 0.0), np.cumsum(y[order])
    n = np.arange(1, len(p) + 1)
    f1 = np.where((at[:-1] > at[1:]) & (2 * hit >= n), 2 * hit / (n + y.sum()), 0)
    if not 0 < y.sum() < len(y) or not f1.any():
        return 0.5
    k = int(f1.argmax())
    return float((at[k] + at[k + 1]) / 2)


def train_chain(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], sample: int = 20_000, apart: float = 4.0, folds: int = 3, ridge: float = 0.5) -> Chain:
    """A chain over the 0/1 columns `categories` of labels (doc_id, ...).

    Trained on at most `sample` labelled documents, the first in order of a hash of doc_id. The features are the words and word beginnings
    (parts_of) whose share of some category's documents in that sample lies at least `apart` standard deviations off (counts by Spark). Each
    category's model is a logistic regression on these and on the earlier categories' probabilities, which come from models
    that didn't see the row (out-of-fold); the models used later are fitted on all rows of the sample.

    Rows with a null id, text or category are left out. Where labels contradict each other, a document is of each category that one of them gives;
    of documents with one id, the least text counts. Without labelled rows, or with one class, a category has the
    constant probability of its class (0 for no rows). A category's threshold is the best one for the out-of-fold probabilities.
    """
    bounded_batches(docs.sparkSession)
    ys = [f"_y{k}" for k in range(len(categories))]
    rows = labels.select("doc_id", *(F.col(c).cast("int").alias(y) for c, y in zip(categories, ys))).dropna().groupBy("doc_id").agg(*(F.max(y).alias(y) for y in ys))
    # Ids without a document must not take a place in the sample.
    rows = rows.join(docs.filter("text is not null").select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    @F.pandas_udf("array<string>")
    def features(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted(features_of(t)))

    # The sample is broadcast: it has at most `sample` rows of an id and a few integers.
    held = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(rows), "doc_id").groupBy("doc_id", *ys).agg(F.min("text").alias("text"))
    held = written(held.select("doc_id", *ys, features("text").alias("words")), "sample")
    totals = held.agg(F.count("*"), *(F.sum(y) for y in ys)).first()
    n = totals[0]
    if not n:
        return Chain(categories, {}, tuple(np.r_[np.zeros(k), -40.0] for k in range(len(categories))), (0.5,) * len(categories))
    counts = held.select(*ys, F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"), *(F.sum(y).alias(y) for y in ys))

    def off(y: str, total: int) -> Column:
        # How many standard deviations the word's share of the class lies from the class's share of all rows.
        p = min(max((total or 0) / n, 1e-6), 1 - 1e-6)
        return F.abs(F.col(y) - F.col("df") * p) / F.sqrt(F.col("df") * p * (1 - p) + 1)

    telling = counts.filter(F.greatest(*(off(y, totals[k + 1]) for k, y in enumerate(ys)), F.lit(0.0)) >= apart)
    words = {r[0]: k for k, r in enumerate(telling.select("word").orderBy("word").collect())}  # bounded by the sample's words

    @F.pandas_udf("binary")
    def columns(parts: pd.Series) -> pd.Series:
        return parts.map(lambda ws: np.array([words[w] for w in ws if w in words], np.int32).tobytes())

    # Bounded by `sample` rows of the features that tell.
    data = held.select(F.xxhash64("doc_id").alias("h"), "doc_id", *ys, columns("words").alias("at")).toPandas()
    # In hashed order, so that folds don't follow a pattern of the ids.
    data = data.sort_values(["h", "doc_id"], kind="stable", ignore_index=True)
    each = [np.frombuffer(x, np.int32) for x in data.pop("at")]
    lens = np.array([len(x) for x in each], np.int64)
    at = np.concatenate(each).astype(np.int64)
    del each
    fold = np.arange(len(data)) % folds
    earlier, weights = np.zeros((len(data), 0)), []
    for y in ys:
        target = data[y].to_numpy(float)
        out = np.zeros(len(data))
        for f in range(folds if len(data) >= folds else 0):
            train = fold != f
            w = _fit(at[np.repeat(train, lens)], lens[train], earlier[train], target[train], len(words), ridge)
            z = _row_sums(w[at], lens) + earlier @ w[len(words) : -1] + w[-1]
            out[~train] = (1 / (1 + np.exp(-np.clip(z, -40, 40))))[~train]
        weights.append(_fit(at, lens, earlier, target, len(words), ridge))
        earlier = np.column_stack([earlier, out])
    return Chain(categories, words, tuple(weights), tuple(_threshold(earlier[:, k], data[y].to_numpy()) for k, y in enumerate(ys)))


def score_toxicity(docs: DataFrame, chain: Chain, threshold: float | None = None) -> DataFrame:
    """docs with p_<category> for each category of the chain (double) and rejected (p_toxic over the threshold, the chain's own if none is given).

    The model is broadcast; it's bounded by the vocabulary. Null and empty texts are scored as texts without any
    known word. Columns of docs with a name that this adds are replaced; an empty table gives an empty result.
    """
    added = [*(f"p_{c}" for c in chain.categories), "rejected"]
    docs = docs.drop(*added)
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    @F.pandas_udf("array<double>")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, tuple[int, ...]] = {}
        for part in slices(texts):
            yield pd.Series(list(shared.value.probabilities(*_occurring(part.tolist(), shared.value.words, known), len(part))))

    scored = docs.withColumn("_p", score("text"))
    for k, c in enumerate(chain.categories):
        scored = scored.withColumn(f"p_{c}", F.col("_p")[k])
    return scored.drop("_p").withColumn("rejected", F.col("p_toxic") > (chain.thresholds[chain.categories.index("toxic")] if threshold is None else threshold))


def label_categories(labels: DataFrame) -> DataFrame:
    """The categories that the labels table gives: low_quality, then toxic."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), F.col("toxic"))
