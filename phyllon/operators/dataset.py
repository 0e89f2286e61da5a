"""Checks of labelled image sets, class indices, exact splits and mini-batches."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from phyllon.functions.columns import capitalize, normalize_key


def class_index(samples: DataFrame) -> DataFrame:
    """(crop, label, class_idx): the 0-based rank of each label of a crop. Only distinct labels reach the window."""
    labels = samples.select("crop", "label").distinct()
    return labels.withColumn("class_idx", F.row_number().over(W.partitionBy("crop").orderBy("label")) - 1)


def configured_classes(config: DataFrame) -> DataFrame:
    return config.select("crop", F.posexplode("classes").alias("class_idx", "label"))


def missing_classes(config: DataFrame, samples: DataFrame) -> DataFrame:
    """Configured classes without a sample."""
    return configured_classes(config).select("crop", "label").join(samples.select("crop", "label").distinct(), ["crop", "label"], "left_anti")


def extra_classes(config: DataFrame, samples: DataFrame) -> DataFrame:
    """Labels of samples that are not configured."""
    return samples.select("crop", "label").distinct().join(configured_classes(config), ["crop", "label"], "left_anti")


def class_report(config: DataFrame, samples: DataFrame) -> DataFrame:
    """Per configured crop: n_classes found, missing and extra (sorted arrays) and verified (neither)."""
    found = samples.groupBy("crop").agg(F.array_sort(F.collect_set("label")).alias("found"))
    none = F.array().cast("array<string>")
    rows = config.select("crop", "classes").join(found, "crop", "left").withColumn("found", F.coalesce("found", none))
    rows = rows.withColumn("missing", F.array_sort(F.array_except("classes", "found"))).withColumn("extra", F.array_sort(F.array_except("found", "classes")))
    return rows.select("crop", F.size("found").alias("n_classes"), "missing", "extra", ((F.size("missing") == 0) & (F.size("extra") == 0)).alias("verified"))


def dataset_counts(config: DataFrame, samples: DataFrame) -> DataFrame:
    """Per configured crop the number of samples, also where it's 0, and a status."""
    counts = samples.groupBy("crop").agg(F.count("*").alias("n"))
    rows = config.select("crop").join(counts, "crop", "left").select("crop", F.coalesce("n", F.lit(0)).alias("n"))
    return rows.withColumn("status", F.when(F.col("n") == 0, "empty").otherwise("ok"))


def class_order_mismatch(config: DataFrame, samples: DataFrame) -> DataFrame:
    """(crop, class_idx, trained, served) where the sorted label differs from the configured one at the same index."""
    trained = class_index(samples).withColumnRenamed("label", "trained")
    served = configured_classes(config).withColumnRenamed("label", "served")
    return trained.join(served, ["crop", "class_idx"]).filter("trained <> served")


def normalize_crop(df: DataFrame) -> DataFrame:
    return df.withColumn("crop", normalize_key("crop"))


def route_unsupported(requests: DataFrame, config: DataFrame) -> DataFrame:
    """requests with status (null if supported, else error) and message, which lists the supported crops."""
    crops = config.agg(F.array_join(F.array_sort(F.collect_set("crop")), ", ").alias("supported"))
    known = config.select(F.col("crop").alias("_known"))
    rows = normalize_crop(requests).join(F.broadcast(known), F.col("crop") == F.col("_known"), "left").crossJoin(F.broadcast(crops))  # one row
    bad = F.col("_known").isNull()
    message = F.concat(F.lit("Unsupported crop. Supported: "), F.col("supported"))
    return rows.withColumn("status", F.when(bad, "error")).withColumn("message", F.when(bad, message)).drop("_known", "supported")


def crop_summary(config: DataFrame, samples: DataFrame) -> DataFrame:
    """Per crop its display name, classes, number of diseases (classes that aren't healthy) and number of samples."""
    diseases = F.size(F.filter("classes", lambda c: F.lower(c) != "healthy"))
    counts = samples.groupBy("crop").agg(F.count("*").alias("n_samples"))
    rows = config.join(counts, "crop", "left")
    return rows.select("crop", capitalize("crop").alias("name"), F.size("classes").alias("n_classes"), diseases.alias("n_diseases"), F.coalesce("n_samples", F.lit(0)).alias("n_samples"))


def _order_key(salt: object) -> Column:
    return F.md5(F.concat(F.col("sample_id").cast("string"), F.lit(f":{salt}")))


def train_val_split(samples: DataFrame, frac: float = 0.2, seed: int = 42) -> DataFrame:
    """samples (sample_id, crop, ...) with split: exactly max(1, int(frac * n)) of a crop's n are val, the first by a seeded hash.

    Nine crops would be nine tasks that sort everything, so ids are first counted by hash bucket: buckets wholly below the
    cut are val, those above are train, and only the bucket of the cut is ranked. Counts move, not pixels.
    """
    n_all = samples.count()
    digits = min(7, max(1, math.ceil(math.log(max(n_all, 2), 16) / 2)))
    keyed = samples.withColumn("_h", _order_key(seed)).withColumn("_b", F.substring("_h", 1, digits))
    counts = keyed.groupBy("crop", "_b").agg(F.count("*").alias("_n"))
    own, upto = W.partitionBy("crop"), W.partitionBy("crop").orderBy("_b")
    cuts = counts.withColumn("_end", F.sum("_n").over(upto)).withColumn("_val", F.greatest(F.lit(1), F.floor(F.sum("_n").over(own) * frac + 1e-9)))
    cuts = cuts.select(F.col("crop").alias("_crop"), F.col("_b").alias("_bucket"), (F.col("_end") - F.col("_n")).alias("_start"), "_end", "_val")
    rows = keyed.join(cuts, F.col("crop").eqNullSafe(F.col("_crop")) & (F.col("_b") == F.col("_bucket")))
    open_ = (F.col("_start") < F.col("_val")) & (F.col("_end") > F.col("_val"))
    sure = rows.filter(~open_).withColumn("split", F.when(F.col("_end") <= F.col("_val"), "val").otherwise("train"))
    rank = F.col("_start") + F.row_number().over(W.partitionBy("crop", "_b").orderBy("_h", "sample_id"))
    border = rows.filter(open_).withColumn("split", F.when(rank <= F.col("_val"), "val").otherwise("train"))
    return sure.unionByName(border).drop("_h", "_b", "_crop", "_bucket", "_start", "_end", "_val")


def assign_batches(samples: DataFrame, size: int = 32, epoch: int = 1) -> DataFrame:
    """samples (sample_id, crop, split) with batch: 0-based, per crop and split; train is shuffled anew each epoch, val keeps its order.

    The running number has two levels, counts of hash buckets and row numbers in one.
    """
    n_all = samples.count()
    digits = min(7, max(1, math.ceil(math.log(max(n_all, 2), 16) / 2)))
    key = F.when(F.col("split") == "train", _order_key(epoch)).otherwise(_order_key("val"))
    keyed = samples.withColumn("_h", key).withColumn("_b", F.substring("_h", 1, digits))
    counts = keyed.groupBy("crop", "split", "_b").agg(F.count("*").alias("_n"))
    before = W.partitionBy("crop", "split").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(F.col("crop").alias("_c"), F.col("split").alias("_s"), F.col("_b").alias("_k"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    rows = keyed.join(starts, F.col("crop").eqNullSafe(F.col("_c")) & (F.col("split") == F.col("_s")) & (F.col("_b") == F.col("_k")))
    number = F.col("_start") + F.row_number().over(W.partitionBy("crop", "split", "_b").orderBy("_h", "sample_id")) - 1
    return rows.withColumn("batch", F.floor(number / size)).drop("_h", "_b", "_c", "_s", "_k", "_start")
