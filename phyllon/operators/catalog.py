"""Search, filters, orders and cards of a product catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from phyllon.functions.columns import discount_pct, stars

#: Orders by name; the catalog's own order (ord) breaks ties, and is the order for other names.
ORDERS = {
    "featured": ("featured desc", "effectiveness desc"),
    "price_asc": ("price asc",),
    "price_desc": ("price desc",),
    "rating": ("rating desc",),
    "effectiveness": ("effectiveness desc",),
}

#: Presets by name: type, disease and order; None leaves a setting as it is. The price and effectiveness presets only order.
PRESETS: dict[str, tuple[str | None, str | None, str]] = {
    "all_products": (None, None, "featured"),
    "fungicides": ("chemical", None, "featured"),
    "bactericides": (None, "Bacterial Spot", "featured"),
    "organic": ("organic", None, "featured"),
    "budget": (None, None, "price_asc"),
    "premium": (None, None, "effectiveness"),
}


def search_products(df: DataFrame, query: str) -> DataFrame:
    """Products with the query in name, brand, category, a disease or a tag, without case and taken literally; an empty query finds all."""
    if not query:
        return df
    return df.filter(F.exists(_texts(), lambda x: F.coalesce(F.contains(F.lower(x), F.lit(query.lower())), F.lit(False))))


def _texts() -> Column:
    none = F.array().cast("array<string>")
    return F.concat(F.array("name", "brand", "category"), F.coalesce("diseases", none), F.coalesce("tags", none))


def search_index(products: DataFrame, key: str = "med_id", parts: int = 64) -> DataFrame:
    """(part, gram, key): the three-letter pieces of each product's searched texts in lower case, each once; part is a hash of the piece."""
    grams = F.transform(F.filter(_texts(), lambda x: F.length(F.lower(x)) >= 3), lambda x: F.transform(F.sequence(F.lit(1), F.length(F.lower(x)) - 2), lambda i: F.substring(F.lower(x), i, F.lit(3))))
    rows = products.select(F.explode(F.array_distinct(F.flatten(grams))).alias("gram"), key)
    return rows.select(F.pmod(F.xxhash64("gram"), F.lit(parts)).cast("int").alias("part"), "gram", key).distinct()


def write_search_index(index: DataFrame, path: str) -> None:
    """A folder for each part, sorted by piece: a search opens the folders of its pieces only, and of those the row groups that hold them."""
    index.repartition("part").sortWithinPartitions("part", "gram").write.mode("overwrite").partitionBy("part").parquet(path)


def search_indexed(products: DataFrame, index: DataFrame, query: str, key: str = "med_id", parts: int = 64) -> DataFrame:
    """search_products by an index: products that have all pieces of the query, then the search itself on these. Queries under three letters scan.

    parts must be those of the index. The postings of rare and of common pieces are counted alike, summed before they move.
    """
    text = query.lower()
    grams = sorted({text[i : i + 3] for i in range(len(text) - 2)})
    if not grams:
        return search_products(products, query)
    lits = [F.lit(g) for g in grams]
    # The pieces' parts are computed by Spark, so they are those of the index; a row.
    wanted = products.sparkSession.range(1).select(F.array(*(F.pmod(F.xxhash64(g), F.lit(parts)).cast("int") for g in lits))).first()[0]
    some = index.filter(F.col("part").isin(sorted(set(wanted))) & F.col("gram").isin(grams))
    found = some.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") == len(grams)).select(key)
    return search_products(products.join(found, key, "left_semi"), query)


def filter_type(df: DataFrame, kind: str | None) -> DataFrame:
    """organic also admits organic-approved; None admits all."""
    if kind is None:
        return df
    return df.filter(F.col("type").isin("organic", "organic-approved") if kind == "organic" else F.col("type") == kind)


def filter_disease(df: DataFrame, disease: str | None) -> DataFrame:
    return df if disease is None else df.filter(F.array_contains("diseases", disease))


def filter_crop(df: DataFrame, crop: str | None) -> DataFrame:
    return df if crop is None else df.filter(F.array_contains("crops", crop))


def order_of(mode: str) -> list[Column]:
    keys = [F.col(c).desc() if way == "desc" else F.col(c).asc() for c, way in map(str.split, ORDERS.get(mode, ()))]
    return [*keys, F.col("ord").asc()]


def sort_products(df: DataFrame, mode: str, page: int | None = None) -> DataFrame:
    """df in that order; with page only so many rows, which Spark finds without a full sort."""
    out = df.orderBy(*order_of(mode))
    return out if page is None else out.limit(page)


def _order_struct(mode: str) -> Column:
    """order_of as one struct that grows: nulls where order_of has them, descending numbers negated."""
    parts = []
    for k, (c, way) in enumerate([*map(str.split, ORDERS.get(mode, ())), ("ord", "asc")]):
        down = way == "desc"
        parts += [(F.col(c).isNull() if down else F.col(c).isNotNull()).alias(f"n{k}"), (-F.col(c).cast("double") if down else F.col(c)).alias(f"k{k}")]
    return F.struct(*parts)


def _range_of(key: Column, bounds: list[Column]) -> Column:
    """How many of the sorted bounds are at most key, by bisection: about log2 of their number of comparisons a row."""
    if not bounds:
        return F.lit(0)
    rows, n = F.array(*bounds), len(bounds)
    widths = F.array(*(F.lit(1 << k) for k in reversed(range(n.bit_length()))))
    return F.aggregate(widths, F.lit(0), lambda lo, w: F.when((lo + w <= n) & (F.get(rows, lo + w - 1) <= key), lo + w).otherwise(lo))


def with_rank(df: DataFrame, mode: str) -> DataFrame:
    """df with rank (from 1) in that order: ranges are sorted apart and numbered from their counts, so no task sorts all.

    The ranges' bounds are keys of a sample of about 64 rows a shuffle partition. They are fixed before rows are dealt, so rows and
    counts always mean the same ranges; the sample decides how even the ranges are, never the ranks.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("_key", _order_struct(mode))
    keys = keyed.select("_key").sample(min(1.0, 64 * parts / max(1, df.count())), seed=7).orderBy("_key")
    kinds = keys.schema["_key"].dataType.fields
    sample = [r[0] for r in keys.collect()]  # bounded by the number of partitions
    every = max(1, len(sample) // parts)
    bounds = [F.struct(*(F.lit(x).cast(f.dataType).alias(f.name) for x, f in zip(key, kinds))) for key in sample[every::every]]
    ranged = keyed.withColumn("_part", _range_of(F.col("_key"), bounds))
    ranged = ranged.withColumn("_row", F.row_number().over(W.partitionBy("_part").orderBy("_key")))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # a row a range
    return ranged.join(F.broadcast(before), "_part").withColumn("rank", F.col("_before") + F.col("_row")).drop("_part", "_row", "_before", "_key")


def disease_facet(df: DataFrame) -> DataFrame:
    return df.select(F.explode("diseases").alias("disease")).distinct().orderBy("disease")


def result_summary(df: DataFrame, filtered: DataFrame) -> DataFrame:
    """One row: shown, total, and whether any of the shown is out of stock."""
    shown = filtered.agg(F.count("*").alias("shown"), F.coalesce(F.bool_or(~F.col("in_stock")), F.lit(False)).alias("any_out"))
    return shown.join(df.agg(F.count("*").alias("total")), how="cross")  # one row by one row


def with_discount(df: DataFrame) -> DataFrame:
    """df with discount_pct and strike_mrp (the list price where it's over the price)."""
    return df.withColumn("discount_pct", discount_pct("price", "mrp")).withColumn("strike_mrp", F.when(F.col("mrp") > F.col("price"), F.col("mrp")))


def with_stars(df: DataFrame) -> DataFrame:
    return df.withColumn("stars", stars("rating"))


def shelf(ids: list[int], products: DataFrame) -> DataFrame:
    """The products of a hand-ordered list, with position; unknown ids are left out."""
    order = F.array_position(F.array(*map(F.lit, ids)), F.col("med_id"))
    return products.filter(F.col("med_id").isin(ids)).withColumn("position", order)


def apply_preset(df: DataFrame, name: str, presets: dict[str, tuple[str | None, str | None, str]] = PRESETS) -> DataFrame:
    """The preset's rows with their rank in its order; presets are (type, disease, order) by name."""
    kind, disease, mode = presets[name]
    return with_rank(filter_disease(filter_type(df, kind), disease), mode)


def crop_catalog(groups: DataFrame) -> DataFrame:
    """(label, key, name, diseases) of every crop of the groups."""
    return groups.select("label", F.explode("crops").alias("c")).select("label", "c.key", "c.name", "c.diseases")


def disease_preview(df: DataFrame, n: int = 3) -> DataFrame:
    return df.withColumn("preview", F.slice("diseases", 1, n))


def effectiveness_band(df: DataFrame) -> DataFrame:
    return df.withColumn("band", F.when(F.col("effectiveness") >= 90, "high").otherwise("normal"))


def buyable(df: DataFrame) -> DataFrame:
    return df.filter("in_stock")
