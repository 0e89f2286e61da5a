"""The leaf's region in an image, from detector boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filter_boxes(boxes: DataFrame, conf: float = 0.25) -> DataFrame:
    return boxes.filter(F.col("conf") >= conf)


def largest_box(boxes: DataFrame, key: str = "image_id") -> DataFrame:
    """Per image the box of the largest area after its corners are cut to integers; of equal ones the smallest box_id. Areas of 0 or less don't count,
    nor do boxes with a corner that is null, NaN or beyond integers.

    An aggregate of structs, so it combines before the shuffle.
    """
    cut = boxes.withColumns({c: F.col(c).try_cast("int") for c in ("x1", "y1", "x2", "y2")})
    wide, high = (F.col(b).cast("long") - F.col(a) for a, b in (("x1", "x2"), ("y1", "y2")))
    cut = cut.withColumn("area", F.try_multiply(wide, high)).filter("area > 0")
    best = cut.groupBy(key).agg(F.max(F.struct("area", (-F.col("box_id")).alias("neg"), "box_id", "x1", "y1", "x2", "y2")).alias("b"))
    return best.select(key, "b.box_id", "b.area", "b.x1", "b.y1", "b.x2", "b.y2")


def padded_boxes(boxes: DataFrame, conf: float = 0.25, pad: int = 20, key: str = "image_id") -> DataFrame:
    """Per image that has a box its largest one, wider by pad on each side (x1, y1, x2, y2, long); not clamped, as the image's size isn't known here."""
    best = largest_box(filter_boxes(boxes, conf), key)
    return best.select(key, *((F.col(c).cast("long") + (pad if c[1] == "2" else -pad)).alias(c) for c in ("x1", "y1", "x2", "y2")))


def pad_and_clamp(boxes: DataFrame, images: DataFrame, pad: int = 20) -> DataFrame:
    """boxes, wider by pad on each side but not beyond their image (image_id, height, width)."""
    rows = boxes.join(images.select("image_id", "height", "width"), "image_id")
    return rows.withColumns(
        {
            "x1": F.greatest(F.lit(0), F.try_subtract("x1", F.lit(pad))),
            "y1": F.greatest(F.lit(0), F.try_subtract("y1", F.lit(pad))),
            "x2": F.least(F.col("width"), F.try_add("x2", F.lit(pad))),
            "y2": F.least(F.col("height"), F.try_add("y2", F.lit(pad))),
        }
    )


def leaf_region(images: DataFrame, boxes: DataFrame, conf: float = 0.25, pad: int = 20) -> DataFrame:
    """Per image (image_id, height, width) its region x1, y1, x2, y2 and whether a box was found; the whole image where there's none."""
    best = largest_box(filter_boxes(boxes, conf)).select("image_id", "x1", "y1", "x2", "y2")
    rows = images.select("image_id", "height", "width").join(best, "image_id", "left").withColumn("found", F.col("x1").isNotNull())
    return rows.select(
        "image_id",
        F.when(F.col("found"), F.greatest(F.lit(0), F.try_subtract("x1", F.lit(pad)))).otherwise(0).alias("x1"),
        F.when(F.col("found"), F.greatest(F.lit(0), F.try_subtract("y1", F.lit(pad)))).otherwise(0).alias("y1"),
        F.when(F.col("found"), F.least(F.col("width"), F.try_add("x2", F.lit(pad)))).otherwise(F.col("width")).alias("x2"),
        F.when(F.col("found"), F.least(F.col("height"), F.try_add("y2", F.lit(pad)))).otherwise(F.col("height")).alias("y2"),
        "found",
    )


def crop_to_region(pixels: DataFrame, region: DataFrame) -> DataFrame:
    """pixels with in_region, for the images that have a region; ends are exclusive."""
    rows = pixels.join(region.select("image_id", "x1", "y1", "x2", "y2"), "image_id")
    inside = (F.col("x") >= F.col("x1")) & (F.col("x") < F.col("x2")) & (F.col("y") >= F.col("y1")) & (F.col("y") < F.col("y2"))
    return rows.withColumn("in_region", inside).drop("x1", "y1", "x2", "y2")
