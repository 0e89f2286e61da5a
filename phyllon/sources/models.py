"""Trained heads as tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def write_heads(heads: DataFrame, path: str) -> None:
    """heads (crop, weights, bias), a row a crop."""
    heads.write.mode("overwrite").parquet(path)


def load_heads(spark: SparkSession, path: str) -> Callable[[str], Callable[[np.ndarray], np.ndarray]]:
    """What score() takes for a model: makes the linear head of a crop; KeyError for a crop that has none. The driver reads a row a crop."""
    found = {}
    for r in spark.read.parquet(path).collect():
        bias = np.array(r["bias"])
        found[r["crop"]] = np.array(r["weights"]).reshape(-1, len(bias)), bias

    def make(crop: str) -> Callable[[np.ndarray], np.ndarray]:
        weights, bias = found[crop]
        return lambda x: x @ weights + bias

    return make
