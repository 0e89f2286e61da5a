"""Activation maps from stored activations and gradients."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from phyllon.operators.pixels import resize_array

#: The 7-tap kernel.
KERNEL = np.array([1, 3.5, 7, 9, 7, 3.5, 1]) / 32


def channel_weights(maps: DataFrame) -> DataFrame:
    """(image_id, channel, weight): the mean gradient over a channel's cells."""
    return maps.groupBy("image_id", "channel").agg(F.avg("grad").alias("weight"))


def cam(maps: DataFrame) -> DataFrame:
    """(image_id, cell, value): activations weighted by channel, summed, not below 0."""
    weight = channel_weights(maps)
    rows = maps.select("image_id", "channel", "cell", "act").join(weight, ["image_id", "channel"])
    return rows.groupBy("image_id", "cell").agg(F.greatest(F.lit(0.0), F.sum(F.col("weight") * F.col("act"))).alias("value"))


def minmax_normalize(df: DataFrame, column: str = "value", eps: float = 1e-8) -> DataFrame:
    """(x - min) / (max(x - min) + eps) over each image."""
    own = W.partitionBy("image_id")
    low, high = F.min(column).over(own), F.max(column).over(own)
    return df.withColumn(column, (F.col(column) - low) / (high - low + eps))


def restrict_map(cam_map: DataFrame, inside: DataFrame, threshold: float = 0.35) -> DataFrame:
    """cam_map (image_id, cell, value) times the mask inside (image_id, cell, mask 0 or 1); values up to the threshold become 0; normalised again."""
    rows = cam_map.join(inside.select("image_id", "cell", "mask"), ["image_id", "cell"])
    value = F.col("value") * F.col("mask")
    return minmax_normalize(rows.withColumn("value", F.when(value > threshold, value).otherwise(0.0)).drop("mask"))


def overlay(pixels: DataFrame, cam_map: DataFrame, lut: DataFrame, image: float = 0.75, heat: float = 0.35) -> DataFrame:
    """pixels (image_id, cell, r, g, b) blended with the colours of their map values; lut (level 0-255, lr, lg, lb) is broadcast, it has 256 rows."""
    rows = pixels.join(cam_map.select("image_id", "cell", "value"), ["image_id", "cell"])
    rows = rows.withColumn("level", F.floor(F.col("value") * 255).cast("int")).join(F.broadcast(lut), "level")
    blend = lambda c: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.round(image * F.col(c) + heat * F.col(f"l{c}"), 6) + 0.5))).cast("int")
    return rows.select("image_id", "cell", blend("r").alias("r"), blend("g").alias("g"), blend("b").alias("b"))


def blur_array(x: np.ndarray) -> np.ndarray:
    """Both ways by the kernel; borders are mirrored without repeating the edge."""
    for axis in (0, 1):
        n = x.shape[axis]
        if n == 1:
            continue
        at = np.abs(np.arange(-3, n + 3)) % (2 * n - 2)
        at = np.where(at >= n, 2 * n - 2 - at, at)
        wide = np.take(x, at, axis)
        x = sum(k * np.take(wide, np.arange(i, i + n), axis) for i, k in enumerate(KERNEL))
    return x


def _maps(df: DataFrame, fn) -> DataFrame:
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [fn(np.asarray(v, float).reshape(h, w)) for h, w, v in zip(pdf["height"], pdf["width"], pdf["map"])]
            yield pdf.assign(map=[x.ravel() for x in out], height=[x.shape[0] for x in out], width=[x.shape[1] for x in out])

    return df.mapInPandas(each, df.schema)


def blur_map(df: DataFrame) -> DataFrame:
    """df (height, width, map array<double>) with blurred maps."""
    return _maps(df, blur_array)


def resize_map(df: DataFrame, height: int, width: int) -> DataFrame:
    return _maps(df, lambda x: resize_array(x, height, width))


def map_rows(cells: DataFrame, width: int) -> DataFrame:
    """Long cells (image_id, cell, value) to one array a map; a map has a fixed small number of cells."""
    rows = cells.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("cell", "value"))).alias("c"))
    return rows.select("image_id", (F.size("c") / width).cast("int").alias("height"), F.lit(width).alias("width"), F.transform("c", lambda x: x["value"]).alias("map"))


def _scaled(x: np.ndarray, eps: float = 1e-8) -> np.ndarray:
    return (x - x.min()) / (x.max() - x.min() + eps)


def explain_array(acts: np.ndarray, grads: np.ndarray, size: tuple[int, int] | None = None, region: tuple | None = None, blur: bool = True, threshold: float | None = 0.35) -> np.ndarray:
    """The map of an image (activations and gradients: channels x height x width): channels weighted by their mean gradient and summed, not below 0, scaled to 0-1, blurred,
    resized, cut to the region (x1, y1, x2, y2 of the resized map, ends exclusive; all of it where a corner is null), values up to the threshold 0, and scaled again."""
    out = _scaled(np.maximum(0, np.tensordot(grads.mean((1, 2)), acts, 1)))
    if blur:
        out = blur_array(out)
    if size:
        out = resize_array(out, *size)
    if threshold is None:
        return out
    if region is not None and not any(v is None or v != v for v in region):
        x1, y1, x2, y2 = (max(0, int(v)) for v in region)
        mask = np.zeros_like(out)
        mask[y1:y2, x1:x2] = 1
        out = out * mask
    return _scaled(np.where(out > threshold, out, 0.0))


def explain_maps(df: DataFrame, size: tuple[int, int] | None = None, blur: bool = True, threshold: float | None = 0.35) -> DataFrame:
    """df (height, width, acts and grads: array<double>, channel by channel, row by row) with map instead of acts and grads, see explain_array.

    The tensor form of cam, minmax_normalize, blur_map, resize_map and restrict_map: one pass over the rows, nothing is moved. Where df has x1, y1, x2, y2 (nulls are
    the whole image), these are the region and go. A null acts or grads gives a null map; other columns stay.
    """
    boxed = {"x1", "y1", "x2", "y2"} <= set(df.columns)
    gone = ["acts", "grads", *(("x1", "y1", "x2", "y2") if boxed else ())]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            regions = pdf[["x1", "y1", "x2", "y2"]].itertuples(index=False, name=None) if boxed else (None for _ in range(len(pdf)))
            maps = []
            for h, w, acts, grads, region in zip(pdf["height"], pdf["width"], pdf["acts"], pdf["grads"], regions):
                some = acts is not None and grads is not None
                maps.append(explain_array(*(np.asarray(v, float).reshape(-1, h, w) for v in (acts, grads)), size, region, blur, threshold) if some else None)
            h, w = ([m.shape[i] if m is not None else n for m, n in zip(maps, pdf[c])] for i, c in enumerate(("height", "width")))
            yield pdf.drop(columns=gone).assign(height=h, width=w, map=[None if m is None else m.ravel() for m in maps])

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c not in (*gone, "map"))
    return df.drop("map").mapInPandas(each, f"{schema}, map array<double>")
