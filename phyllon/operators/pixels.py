"""Pixel work: in long form (a row a pixel) as columns, in tensor form by NumPy over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the usual image normalisation.
MEAN, STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
LEAF = (18, 95, 30)
MASK = (25, 85, 40)


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """8-bit HSV: hue in 0-179 (degrees / 2), saturation and value in 0-255, rounded half up; grey has hue and saturation 0."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    spread = (top - low).cast("double")
    s = F.when(top == 0, F.lit(0)).otherwise(F.floor(spread * 255 / top + 0.5))
    deg = F.when(spread == 0, F.lit(0.0)).when(top == r, (g - b) * 60 / spread).when(top == g, (b - r) * 60 / spread + 120).otherwise((r - g) * 60 / spread + 240)
    deg = F.when(deg < 0, deg + 360).otherwise(deg)
    return F.floor(deg / 2 + 0.5) % 180, s, top


def in_range(bounds: tuple[int, int, int], channel_order: str = "rgb") -> Column:
    """Hue between the first two bounds and saturation and value at least the third, all inclusive."""
    r, b = ("r", "b") if channel_order == "rgb" else ("b", "r")
    h, s, v = hsv(F.col(r), F.col("g"), F.col(b))
    return h.between(bounds[0], bounds[1]) & (s >= bounds[2]) & (v >= bounds[2])


def normalize_pixels(pixels: DataFrame) -> DataFrame:
    """pixels with r, g, b scaled to 0-1, less the mean, over the standard deviation."""
    return pixels.withColumns({c: (F.col(c) / 255.0 - m) / s for c, m, s in zip("rgb", MEAN, STD)})


def green_ratio(pixels: DataFrame) -> DataFrame:
    """(image_id, ratio): the share of pixels in the leaf's range."""
    return pixels.groupBy("image_id").agg(F.avg(in_range(LEAF).cast("double")).alias("ratio"))


def is_leaf(pixels: DataFrame, above: float = 0.04) -> DataFrame:
    return green_ratio(pixels).withColumn("is_leaf", F.col("ratio") > above)


def mask_background(pixels: DataFrame, channel_order: str = "rgb") -> DataFrame:
    """pixels with those out of the mask's range set to 0. channel_order "bgr" reads r as b and b as r."""
    keep = in_range(MASK, channel_order)
    masked = pixels.withColumn("_keep", keep)
    return masked.withColumns({c: F.when(F.col("_keep"), F.col(c)).otherwise(0) for c in "rgb"}).drop("_keep")


# Tensor form: columns height, width and data (bytes, row by row, three a pixel).


def _hsv_array(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    r, g, b = x[..., 0], x[..., 1], x[..., 2]
    top, spread = x.max(-1), x.max(-1) - x.min(-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        s = np.where(top == 0, 0, np.floor(spread * 255 / top + 0.5))
        deg = np.select([spread == 0, top == r, top == g], [0, (g - b) * 60 / spread, (b - r) * 60 / spread + 120], (r - g) * 60 / spread + 240)
    deg = np.where(deg < 0, deg + 360, deg)
    return np.stack([np.floor(deg / 2 + 0.5) % 180, s, top], -1)


def in_range_array(x: np.ndarray, bounds: tuple[int, int, int]) -> np.ndarray:
    h = _hsv_array(x)
    return (h[..., 0] >= bounds[0]) & (h[..., 0] <= bounds[1]) & (h[..., 1] >= bounds[2]) & (h[..., 2] >= bounds[2])


def resize_array(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear with antialias: a triangle filter that widens as the image shrinks, as two matrix products."""

    def weights(n: int, m: int) -> np.ndarray:
        scale = n / m
        wide = max(scale, 1.0)
        mid = (np.arange(m) + 0.5) * scale - 0.5
        k = np.maximum(0, 1 - np.abs(np.arange(n)[None, :] - mid[:, None]) / wide)
        return k / k.sum(1, keepdims=True)

    y = np.tensordot(weights(x.shape[0], h), x.astype(np.float64), (1, 0))
    return np.moveaxis(np.tensordot(weights(x.shape[1], w), y, (1, 1)), 0, 1)


def _arrays(pdf: pd.DataFrame) -> Iterator[np.ndarray]:
    for h, w, data in zip(pdf["height"], pdf["width"], pdf["data"]):
        yield np.frombuffer(data, np.uint8).reshape(h, w, -1)


def _with_data(df: DataFrame, fn) -> DataFrame:
    """df with data, height and width replaced by fn(array, row)'s 8-bit image."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [np.clip(np.floor(np.round(fn(x, row), 6) + 0.5), 0, 255).astype(np.uint8) for x, row in zip(_arrays(pdf), pdf.itertuples())]
            yield pdf.assign(data=[x.tobytes() for x in out], height=[x.shape[0] for x in out], width=[x.shape[1] for x in out])

    return df.mapInPandas(each, df.schema)


def to_rgb(images: DataFrame) -> DataFrame:
    """(image_id or path columns, height, width, data) from Spark's image struct: BGR becomes RGB, alpha goes, grey is repeated. Data of unreadable images is null."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for h, w, n, data in zip(pdf["height"], pdf["width"], pdf["nChannels"], pdf["data"]):
                if data is None or not h > 0:
                    out.append(None)
                    continue
                x = np.frombuffer(data, np.uint8).reshape(int(h), int(w), int(n))
                out.append((np.repeat(x, 3, 2) if n == 1 else x[..., 2::-1]).tobytes())
            yield pdf.assign(data=out).drop(columns="nChannels")

    flat = images.select("*", "image.height", "image.width", "image.nChannels", "image.data").drop("image")
    schema = ", ".join(f"`{c}` {t}" for c, t in flat.dtypes if c != "nChannels")
    return flat.mapInPandas(each, schema)


def resize_images(df: DataFrame, height: int, width: int) -> DataFrame:
    return _with_data(df, lambda x, _: resize_array(x, height, width))


def mask_images(df: DataFrame) -> DataFrame:
    return _with_data(df, lambda x, _: np.where(in_range_array(x, MASK)[..., None], x, 0).astype(float))


def leaf_ratio(df: DataFrame) -> DataFrame:
    """df without data, with ratio: the tensor form of green_ratio."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.drop(columns="data").assign(ratio=[float(in_range_array(x, LEAF).mean()) for x in _arrays(pdf)])

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c != "data")
    return df.mapInPandas(each, f"{schema}, ratio double")


def image_tensor(df: DataFrame) -> DataFrame:
    """df with tensor instead of data: channels first, normalised, as array<float>."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [np.moveaxis((x / 255.0 - MEAN) / STD, 2, 0).astype(np.float32).ravel() for x in _arrays(pdf)]
            yield pdf.drop(columns="data").assign(tensor=out)

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c != "data")
    return df.mapInPandas(each, f"{schema}, tensor array<float>")


REGION = ("x1", "y1", "x2", "y2")


def crop_array(x: np.ndarray, region: tuple) -> np.ndarray:
    """x cut to its region (x1, y1, x2, y2, ends exclusive), which is clamped to the image; all of x where a corner is null or nothing is left."""
    if any(v is None or v != v for v in region):
        return x
    x1, y1, x2, y2 = (max(0, int(v)) for v in region)
    return part if (part := x[y1:y2, x1:x2]).size else x


def _tensor(x: np.ndarray, height: int, width: int) -> np.ndarray:
    level = np.clip(np.floor(np.round(resize_array(x, height, width), 6) + 0.5), 0, 255)
    return np.moveaxis((level / 255.0 - MEAN) / STD, 2, 0).astype(np.float32).ravel()


def crop_images(df: DataFrame) -> DataFrame:
    """df (height, width, data, x1, y1, x2, y2) with images cut to their regions, see crop_array; the tensor form of crop_to_region."""
    return _with_data(df, lambda x, row: crop_array(x, tuple(getattr(row, c) for c in REGION)).astype(float))


def prepare(df: DataFrame, height: int = 224, width: int = 224, above: float = 0.04) -> DataFrame:
    """df (height, width, data) to is_leaf and features (the normalised tensor of the resized image) instead, in one pass; data is dropped.

    Null data gives nulls. Where df has x1, y1, x2, y2, the leaf gate is of the whole image and the tensor of its region (see crop_array); these columns go, too.
    """
    boxed = set(REGION) <= set(df.columns)
    gone = ["height", "width", "data", *(REGION if boxed else ())]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), 64):  # tensors are large
                part = pdf.iloc[a : a + 64]
                regions = part[[*REGION]].astype(object).where(part[[*REGION]].notna(), None).itertuples(index=False, name=None) if boxed else ((None,) for _ in range(len(part)))
                leaf, out = [], []
                for h, w, data, region in zip(part["height"], part["width"], part["data"], regions):
                    if data is None:
                        leaf.append(None)
                        out.append(None)
                        continue
                    x = np.frombuffer(data, np.uint8).reshape(int(h), int(w), -1)
                    leaf.append(bool(in_range_array(x, LEAF).mean() > above))
                    out.append(_tensor(crop_array(x, region), height, width))
                yield part.drop(columns=gone).assign(is_leaf=leaf, features=out)

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c not in gone)
    return df.mapInPandas(each, f"{schema}, is_leaf boolean, features array<float>")


def _shift_hue(x: np.ndarray, turn: float) -> np.ndarray:
    """x with each pixel's hue turned by that part of a circle; value and saturation stay."""
    top, spread = x.max(-1), x.max(-1) - x.min(-1)
    r, g, b = np.moveaxis(x, -1, 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        sixth = np.select([spread == 0, top == r, top == g], [0, (g - b) / spread, (b - r) / spread + 2], (r - g) / spread + 4)
    sixth = (sixth + 6 * turn) % 6
    # A channel is at the top within a sixth of its own hue on both sides, and falls to the bottom over the next one.
    near = lambda at: np.clip(2 - np.abs((sixth - at + 3) % 6 - 3), 0, 1)
    return (top - spread)[..., None] + spread[..., None] * np.stack([near(0), near(2), near(4)], -1)


def augment_array(
    x: np.ndarray, rng: np.random.Generator, crop: int, flip: float = 0.5, upside: float = 0.2, turn: float = 30, brightness: float = 0.3, contrast: float = 0.3, saturation: float = 0.25, hue: float = 0.05, grey: float = 0.05
) -> np.ndarray:
    """Random crop, flips (their probabilities), rotation of up to `turn` degrees (nearest pixel, black outside), then jitter, sometimes grey.

    Jitter is in the order brightness, contrast, saturation (factors between 1 - range and 1 + range) and hue (a turn of up to its range);
    levels are clipped after each.
    """
    crop = min(crop, *x.shape[:2])
    top, left = (int(rng.integers(0, n - crop + 1)) for n in x.shape[:2])
    x = x[top : top + crop, left : left + crop].astype(np.float64)
    if rng.random() < flip:
        x = x[:, ::-1]
    if rng.random() < upside:
        x = x[::-1]
    a = np.deg2rad(rng.uniform(-turn, turn))
    mid = (crop - 1) / 2
    yy, xx = np.mgrid[:crop, :crop] - mid
    sy, sx = np.rint(np.cos(a) * yy + np.sin(a) * xx + mid).astype(int), np.rint(np.cos(a) * xx - np.sin(a) * yy + mid).astype(int)
    ok = (sy >= 0) & (sy < crop) & (sx >= 0) & (sx < crop)
    x = np.where(ok[..., None], x[np.clip(sy, 0, crop - 1), np.clip(sx, 0, crop - 1)], 0)
    luma = np.array([0.299, 0.587, 0.114])
    bright, steep, colour = (rng.uniform(1 - r, 1 + r) for r in (brightness, contrast, saturation))
    x = np.clip(x * bright, 0, 255)
    mean = (x @ luma).mean()
    x = np.clip((x - mean) * steep + mean, 0, 255)
    own = (x @ luma)[..., None]
    x = np.clip((x - own) * colour + own, 0, 255)
    x = np.clip(_shift_hue(x, rng.uniform(-hue, hue)), 0, 255)
    return np.repeat((x @ luma)[..., None], 3, 2) if rng.random() < grey else x


def augment(df: DataFrame, epoch: int, seed: int = 42, crop: int = 224, **ranges: float) -> DataFrame:
    """Seeded by (image_id, epoch, seed), so a task that runs again gives the same images. ranges: see augment_array."""
    return _with_data(df, lambda x, row: augment_array(x, np.random.default_rng([int(row.image_id) & 0xFFFFFFFF, epoch, seed]), crop, **ranges))
