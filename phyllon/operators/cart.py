"""Carts from their events, and what they cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def clamp_qty(df: DataFrame) -> DataFrame:
    return df.withColumn("qty", F.greatest(F.lit(1), F.coalesce("qty", F.lit(1))))


def session_lines(events: DataFrame, span: int = 1 << 16) -> DataFrame:
    """(cart_id, order_no, med_id, qty, first_seq, n_clears): what each cart held at each of its clears (order_no, from 0), and what it holds now (order_no = n_clears).

    events are (cart_id, seq, action, med_id, qty). An add merges its quantity (at least 1), a remove drops the item, a clear empties the cart; of equal seq, clears and
    removes come last; events without seq are left out. Events move once, by cart and stretch of `span` values of seq, so one cart of very many events is many groups. A stretch becomes a summary:
    for each item and each clear within the stretch whether it was removed, and the adds since. Summaries merge in any order: an item's quantity is the sum of those from
    its last stretch with a remove on. Only summaries meet by cart: a row for each stretch and item.
    """
    rows = events.filter("seq is not null").select("cart_id", "seq", "action", "med_id", "qty", F.floor(F.col("seq") / span).alias("at"), (F.col("action") == "clear").cast("long").alias("clear"))
    before = W.partitionBy("cart_id", "at").orderBy("seq", "clear").rowsBetween(W.unboundedPreceding, -1)
    numbered = rows.withColumn("own", F.coalesce(F.sum("clear").over(before), F.lit(0)))
    of_item = W.partitionBy("cart_id", "at", "own", "med_id")
    gone = F.max(F.when(F.col("action") == "remove", F.col("seq"))).over(of_item)
    live = (F.col("action") == "add") & (gone.isNull() | (F.col("seq") > gone))
    marked = numbered.withColumn("live", live).withColumn("removed", F.col("action") == "remove")
    qty = F.greatest(F.lit(1), F.coalesce("qty", F.lit(1)))
    summaries = marked.groupBy("cart_id", "at", "own", "med_id").agg(
        F.sum(F.when(F.col("live"), qty)).alias("qty"), F.min(F.when(F.col("live"), F.col("seq"))).alias("first_seq"), F.bool_or("removed").alias("removed")
    )
    of_cart = W.partitionBy("cart_id")
    upto = of_cart.orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    clears = rows.groupBy("cart_id", "at").agg(F.sum("clear").alias("n"))  # summed before it moves
    clears = clears.select("cart_id", "at", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("earlier"), F.sum("n").over(of_cart).alias("n_clears"))
    ordered = summaries.join(clears, ["cart_id", "at"]).withColumn("order_no", F.col("earlier") + F.col("own"))
    since = F.max(F.when(F.col("removed"), F.col("at"))).over(W.partitionBy("cart_id", "order_no", "med_id"))
    kept = ordered.withColumn("since", since).filter("qty is not null and (since is null or at >= since)")
    return kept.groupBy("cart_id", "order_no", "med_id").agg(F.sum("qty").alias("qty"), F.min("first_seq").alias("first_seq"), F.max("n_clears").alias("n_clears"))


def cart_state(events: DataFrame, span: int = 1 << 16) -> DataFrame:
    """(cart_id, med_id, qty, first_seq): what each cart holds after its events, see session_lines. first_seq gives the order of a cart's lines."""
    return session_lines(events, span).filter("order_no = n_clears").select("cart_id", "med_id", "qty", "first_seq")


def line_totals(cart: DataFrame, products: DataFrame) -> DataFrame:
    """cart with the product's price, total and mrp_total (null unless the list price is over the price)."""
    rows = cart.join(products.select("med_id", "price", "mrp"), "med_id")
    return rows.withColumn("total", F.col("price") * F.col("qty")).withColumn("mrp_total", F.when(F.col("mrp") > F.col("price"), F.col("mrp") * F.col("qty")))


def cart_totals(lines: DataFrame) -> DataFrame:
    return lines.groupBy("cart_id").agg(F.sum("total").alias("total"), F.sum("qty").alias("items"))


def delivery(total: Column, free_from: float = 500, fee: float = 49) -> Column:
    return F.when(total >= free_from, F.lit(0.0)).otherwise(F.lit(float(fee)))


def checkout(totals: DataFrame) -> DataFrame:
    """totals with delivery and grand_total. Empty carts have no row in totals."""
    return totals.withColumn("delivery", delivery(F.col("total"))).withColumn("grand_total", F.col("total") + F.col("delivery"))


def orders_from_events(events: DataFrame, products: DataFrame, span: int = 1 << 16) -> DataFrame:
    """A row for each clear of a cart that wasn't empty: cart_id, order_no (clears before), items and grand_total at that moment."""
    lines = line_totals(session_lines(events, span).filter("order_no < n_clears"), products)
    totals = lines.groupBy("cart_id", "order_no").agg(F.sum("total").alias("total"), F.sum("qty").alias("items"))
    return checkout(totals)
