"""Mixing sources to target weights by systematic sampling, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, written


def unit(text: Column, seed: int) -> Column:
    """A fixed number in [0, 1) for a string."""
    return F.conv(F.substring(F.md5(F.concat(text, F.lit(f":{seed}"))), 1, 8), 16, 10).cast("long") / F.lit(2.0**32)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """The target of each source of sizes (source, source_size).

    Sources by code point, null last, have the weights in turn and share the sum of all sizes; a target stops at
    max_repeat times its source's size and the excess is reshared by weight. Adds target (double). Where all sizes
    are 0 the targets are 0. The window has one row a source, not one a document.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = sizes.withColumn("_i", rank).withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("_i") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", F.col("source_size") * max_repeat)
    # In order of cap to weight, the sources that stop at their cap come first: the level is what the rest share.
    by_ratio = W.orderBy(F.col("_cap") / F.col("_w"), "_i")
    before, all_ = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total, weight = F.sum("source_size").over(all_), F.sum("_w").over(all_)
    level = (total - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / (weight - F.coalesce(F.sum("_w").over(before), F.lit(0)))
    levels = ranked.withColumn("_level", level).withColumn("_stops", F.col("_cap") < F.col("_level") * F.col("_w"))
    shared = F.first(F.when(~F.col("_stops"), F.col("_level")), ignorenulls=True).over(all_)
    target = F.when(F.col("_stops"), F.col("_cap").cast("double")).otherwise(shared * F.col("_w"))
    return levels.withColumn("target", F.coalesce(target, F.lit(0.0))).drop("_i", "_w", "_cap", "_level", "_stops")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3, seed: int = 7) -> DataFrame:
    """docs (doc_id, text, source and any others) with size, source_size, target, copies and taken.

    Every document of a source is expected target / source_size times. The running sum of these within the source plus
    one random offset of the source crosses integers; a document is taken once for each one it crosses. So a source's
    total is exact to one document. Documents are in order of size (in steps of an eighth of a power of two, each dealt to
    hashed buckets), which keeps words near the target too. The running sum has two levels: counts of buckets and
    row numbers within one, so a source with a third of all rows is still dealt to many tasks. There are more buckets with
    the square root of the number of rows, so that neither level grows in proportion.

    A null text has size 0; null sources are one source, the last; null ids and equal rows are sampled like any
    other; an empty table gives an empty result. Other columns of docs stay, also where their names are used inside; those named as one that this adds
    are replaced.
    """
    # All but the text in a struct, so that no name clashes.
    own = ["size", "source_size", "target", "copies", "taken"]
    kept = [c for c in docs.columns if c not in own and c != "text"]
    packed = docs.select(F.struct(*kept).alias("_own"), "doc_id", "text", "source")
    n = docs.count()
    buckets = max(1, (math.isqrt(max(0, n - 1)) + 1) // 32)
    hashed = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("long")
    sized = packed.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    # The length of size + 8 in bits and the three bits after its first: grows with size.
    sized = sized.withColumn("_h", hashed).withColumn("_t", F.xxhash64("text")).withColumn("_bits", F.length(F.bin(F.col("size") + 8)))
    step = F.col("_bits") * 8 + F.expr("shiftright(size + 8, _bits - 4)") % 8
    sized = sized.withColumn("_bucket", step * buckets + F.col("_h") % buckets).drop("_bits")
    # Written, as the words of a text would be counted again for each use; a few rows for each source and hashed bucket.
    counts = written(sized.groupBy("source", "_bucket").agg(F.count("*").alias("_n"), F.sum("size").alias("_words")), "counts")
    of_bucket = W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(of_bucket), F.lit(0)))
    targets = source_targets(counts.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, max_repeat)
    named = lambda df, own: df.withColumnRenamed("source", own)
    starts = named(starts, "_s").join(named(targets, "_t"), F.col("_s").eqNullSafe(F.col("_t"))).select(F.col("_s"), F.col("_bucket").alias("_b"), "_start", "source_size", "target")
    joined = sized.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    row = F.row_number().over(W.partitionBy("source", "_bucket").orderBy("size", "_h", "doc_id", "_t"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = unit(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null")), seed)
    out = joined.withColumn("_row", F.col("_start") + row).withColumn("_rate", rate).withColumn("_u", offset)
    crossed = F.floor(F.col("_u") + F.col("_row") * F.col("_rate")) - F.floor(F.col("_u") + (F.col("_row") - 1) * F.col("_rate"))
    out = out.withColumn("copies", F.least(crossed, F.lit(max_repeat)).cast("long")).withColumn("taken", F.col("size") * F.col("copies"))
    columns = [F.col("text") if c == "text" else F.col("_own").getField(c).alias(c) for c in docs.columns if c not in own]
    return out.select(*columns, *own)


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each document as often as it is taken."""
    return mixed.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(columns)
