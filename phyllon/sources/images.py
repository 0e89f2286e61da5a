"""Reading labelled images and uploads, writing verdicts and training metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def file_path(origin: Column | str) -> Column:
    """The path that the image source writes as a URI, with blanks, % and letters beyond ASCII as they are."""
    return F.url_decode(F.replace(F.col(origin) if isinstance(origin, str) else origin, F.lit("+"), F.lit("%2B")))


def folder_of(path: Column | str) -> Column:
    """The name of the folder that a file is in."""
    return F.element_at(F.split(path, "/"), -2)


def read_labeled_images(spark: SparkSession, root: str, crop: str) -> DataFrame:
    """(crop, path, label, image) of all images under root; the label is the folder's name. Broken files have height -1."""
    images = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", False).load(root)
    path = file_path("image.origin")
    return images.select(F.lit(crop).alias("crop"), path.alias("path"), folder_of(path).alias("label"), "image")


def _starts(hex_: Column, *magic: str) -> Column:
    out = F.lit(False)
    for m in magic:
        out = out | hex_.startswith(m)
    return out


def check_image_type(df: DataFrame) -> DataFrame:
    """df (content binary) with image_type (jpeg, png, webp or null) and reject_reason, by the first bytes."""
    head = F.hex(F.substring("content", 1, 12))
    webp = head.startswith("52494646") & F.substring(head, 17, 8).eqNullSafe("57454250")
    kind = F.when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("89504E470D0A1A0A"), "png").when(webp, "webp")
    return df.withColumn("image_type", kind).withColumn("reject_reason", F.when(F.col("image_type").isNull(), "not a JPEG, PNG or WebP image"))


def split_decodable(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Images that could be read, and those that could not."""
    bad = F.col("image.height") < 0
    return images.filter(~bad), images.filter(bad)


def encode_base64(df: DataFrame, column: str) -> DataFrame:
    """df with column as base64 text; null stays null."""
    return df.withColumn(column, F.replace(F.base64(column), F.lit("\r\n"), F.lit("")))


def write_verdicts(df: DataFrame, path: str, fmt: str = "json") -> None:
    df.write.mode("append").partitionBy("crop").format(fmt).save(path)


def write_model_meta(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("crop").json(path)
