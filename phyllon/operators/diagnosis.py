"""From verdicts to disease knowledge and ranked treatments.

Facts are large, the joined tables mostly small. None is broadcast by a hint: Spark broadcasts those whose size it knows to be under
spark.sql.autoBroadcastJoinThreshold, from their files' statistics or, for results, at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from phyllon.functions.columns import clean_label, one_decimal

def normalize_disease(df: DataFrame, knowledge: DataFrame) -> DataFrame:
    """df with disease as the knowledge table writes it: an exact match of the cleaned name, else the first that matches without case, else the cleaned name. Null stays null."""
    exact = knowledge.select(F.col("disease").alias("_exact")).distinct()
    lower = knowledge.groupBy(F.lower("disease").alias("_key")).agg(F.min_by("disease", "ord").alias("_any"))
    rows = df.withColumn("_clean", clean_label("disease"))
    rows = rows.join(exact, F.col("_clean") == F.col("_exact"), "left").join(lower, F.lower("_clean") == F.col("_key"), "left")
    return rows.withColumn("disease", F.coalesce("_exact", "_any", "_clean")).drop("_clean", "_exact", "_key", "_any")


def unmapped_labels(labels: DataFrame, knowledge: DataFrame) -> DataFrame:
    """The distinct labels (label) whose name isn't in the knowledge table."""
    rows = labels.select("label").distinct().withColumn("disease", F.col("label"))
    return normalize_disease(rows, knowledge).join(knowledge.select("disease").distinct(), "disease", "left_anti").select("label", "disease")


def attach_knowledge(df: DataFrame, knowledge: DataFrame, severity: DataFrame) -> DataFrame:
    """df (disease) with description, causes, remedies, severity ("moderate" where unknown), severity_label and known."""
    know = knowledge.select("disease", F.col("severity").alias("_sev"), "description", "causes", "remedies", F.lit(True).alias("known"))
    rows = df.join(know, "disease", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    levels = severity.select(F.col("severity").alias("_s"), "severity_label")
    default = severity.filter("severity = 'moderate'").select(F.col("severity_label").alias("_default")).limit(1)
    rows = rows.join(levels, F.col("_sev") == F.col("_s"), "left").join(F.broadcast(default), F.lit(True), "left")  # one row
    rows = rows.withColumn("severity", F.when(F.col("_s").isNotNull(), F.col("_sev")).otherwise("moderate"))
    return rows.withColumn("severity_label", F.coalesce("severity_label", "_default")).drop("_sev", "_s", "_default")


def severe_alerts(df: DataFrame) -> DataFrame:
    return df.filter("severity = 'severe'")


def remedies(df: DataFrame, kind: str) -> DataFrame:
    """A row for each remedy (kind, step, remedy) of the asked kind; where a disease has none of it, of its first kind."""
    rows = df.filter(F.size("remedies") > 0)
    asked = F.when(F.coalesce(F.size(F.try_element_at("remedies", F.lit(kind))), F.lit(0)) > 0, F.lit(kind)).otherwise(F.map_keys("remedies")[0])
    rows = rows.withColumn("kind", asked).withColumn("_list", F.try_element_at("remedies", F.col("kind")))
    return rows.select("*", F.posexplode("_list").alias("step", "remedy")).drop("_list", "remedies")


def match_products(bridge: DataFrame, products: DataFrame) -> DataFrame:
    """(disease, ord and the product's columns) of the curated ids; ids without a product are dropped."""
    return products.drop("ord").join(bridge.select("disease", "ord", "med_id"), "med_id")


def top_products(diagnoses: DataFrame, bridge: DataFrame, products: DataFrame, n: int = 4) -> DataFrame:
    """diagnoses (disease, ...) with their n most effective products and rank; of equal ones the curated order counts. Ranked once a disease, then joined."""
    rank = F.row_number().over(W.partitionBy("disease").orderBy(F.col("effectiveness").desc(), "ord"))
    best = match_products(bridge, products).withColumn("rank", rank).filter(F.col("rank") <= n).select("disease", "rank", "med_id", "effectiveness")
    return diagnoses.join(best, "disease")


def overflow_count(bridge: DataFrame, products: DataFrame, n: int = 4) -> DataFrame:
    """(disease, more): how many products beyond n, where there are."""
    return match_products(bridge, products).groupBy("disease").agg((F.count("*") - n).alias("more")).filter("more > 0")


def fallback_advice(df: DataFrame, knowledge: DataFrame) -> DataFrame:
    """Rows whose disease has no knowledge and isn't healthy, with advice."""
    rows = df.filter(F.col("disease").isNotNull() & (F.lower("disease") != "healthy"))
    rows = rows.join(knowledge.select("disease").distinct(), "disease", "left_anti")
    return rows.withColumn("advice", F.concat("disease", F.lit(" found with "), one_decimal("confidence"), F.lit("% confidence. Ask an expert for treatment.")))

