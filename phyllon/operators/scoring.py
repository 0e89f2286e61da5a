"""Batch scoring with a model for each crop, and verdicts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phyllon.functions.columns import capitalize, clean_label, one_decimal, softmax, top_k
from phyllon.operators.dataset import normalize_crop

Predict = Callable[[np.ndarray], np.ndarray]


def linear_head(weights: np.ndarray, bias: np.ndarray) -> Predict:
    return lambda x: x @ weights + bias


def score(df: DataFrame, make_predict_fn: Callable[[str], Predict], features: str = "features") -> DataFrame:
    """df with logits, array<double>, of each row's crop's model; null where make_predict_fn has no model (KeyError) or features are null.

    Each worker makes a crop's model once and keeps it. Rows aren't moved by crop: nine crops would be nine tasks.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models: dict[str, Predict | None] = {}
        for pdf in batches:
            out = np.empty(len(pdf), object)
            some = np.flatnonzero(pdf[features].notna().to_numpy())
            for crop, at in pdf.iloc[some].groupby("crop", sort=False).indices.items():
                at = some[at]
                if crop not in models:
                    try:
                        models[crop] = make_predict_fn(crop)
                    except KeyError:
                        models[crop] = None
                if models[crop] is not None:
                    x = np.stack(pdf[features].to_numpy()[at])
                    out[at] = [*np.asarray(models[crop](x), np.float64)]
            yield pdf.assign(logits=out)

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c != "logits")
    return df.drop("logits").mapInPandas(each, f"{schema}, logits array<double>")


def predictions(scored: DataFrame, config: DataFrame, k: int = 3) -> DataFrame:
    """scored (crop, logits) with probs, top_predictions, disease and confidence of the best one. Array functions only."""
    rows = scored.join(F.broadcast(config.select("crop", "classes")), "crop", "left")
    rows = rows.withColumn("probs", softmax("logits")).withColumn("top_predictions", top_k("probs", "classes", k))
    return rows.withColumn("disease", F.col("top_predictions")[0]["label"]).withColumn("confidence", F.col("top_predictions")[0]["confidence"])


def is_healthy_label(c: Column | str) -> Column:
    return F.lower(clean_label(c)) == "healthy"


def healthy_guard(df: DataFrame, above: float = 88.0) -> DataFrame:
    """df with guarded: the best label is healthy with a confidence over the bound."""
    return df.withColumn("guarded", F.coalesce(is_healthy_label("disease") & (F.col("confidence") > above), F.lit(False)))


def low_message() -> Column:
    return F.concat(F.lit("Low confidence ("), one_decimal("confidence"), F.lit("%). Take a clearer picture."))


def confidence_gate(df: DataFrame, least: float = 60.0) -> DataFrame:
    """df with status (rejected below the bound, else success) and message."""
    low = F.col("confidence") < least
    return df.withColumn("status", F.when(low, "rejected").otherwise("success")).withColumn("message", F.when(low, low_message()))


def verdicts(requests: DataFrame, config: DataFrame, least: float = 60.0, guard: float = 88.0) -> DataFrame:
    """A verdict for each of requests (any id columns, crop, is_leaf, logits).

    In order: a crop that isn't configured is an error; no leaf is rejected; a sure healthy one is a success with
    is_healthy; a low confidence is rejected; all else is a success, a less sure healthy one with is_healthy false.
    """
    rows = healthy_guard(predictions(normalize_crop(requests), config), guard)
    unknown, no_leaf, low = F.col("classes").isNull(), ~F.coalesce("is_leaf", F.lit(False)), F.coalesce(F.col("confidence") < least, F.lit(True))
    status = F.when(unknown, "error").when(no_leaf, "rejected").when(F.col("guarded"), "success").when(low, "rejected").otherwise("success")
    message = F.when(unknown, "Unsupported crop").when(no_leaf, "No leaf found").when(~F.col("guarded") & low, low_message())
    rows = rows.withColumn("status", status).withColumn("message", message)
    good = F.col("status") == "success"
    shown = ~unknown & ~no_leaf
    return rows.select(
        *[c for c in requests.columns if c not in ("crop", "logits", "is_leaf", "features")],
        "status",
        "message",
        capitalize("crop").alias("crop"),
        F.when(good, F.when(F.col("guarded"), F.lit("Healthy")).otherwise(F.col("disease"))).alias("disease"),
        F.when(shown, F.col("confidence")).alias("confidence"),
        F.when(shown, F.col("top_predictions")).alias("top_predictions"),
        F.when(good, F.col("guarded")).alias("is_healthy"),
    )
