"""A training corpus from raw documents: five stages, each on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phyllon.llm.bpe import encode_column
from phyllon.llm.common import scratch, table, written
from phyllon.llm.jaccard_join import jaccard_classes
from phyllon.llm.mixing import mix_sources, repeated
from phyllon.llm.queries import vocabulary
from phyllon.llm.secret_scan import redact
from phyllon.llm.toxicity import label_categories, score_toxicity, train_chain

#: Other columns of the documents don't go on.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain takes for toxic go. Null and empty texts stay; each of repeated rows is judged by its text."""
    chain = train_chain(docs, label_categories(table(spark, sf_dir, "labels")), ("low_quality", "toxic"))
    return score_toxicity(docs.select(COLUMNS), chain).filter(~F.col("rejected")).select(COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays. Of rows with the same id and text the one with the least other columns stays.

    Rows with one id and different texts are documents of their own; of near-duplicates among them one stays. Documents with a null id and
    those without words are in no group.
    """
    rows = docs.select(COLUMNS).withColumn("text_hash", F.xxhash64("text"))
    classes = jaccard_classes(rows.select("doc_id", "text"))
    own = (F.col("doc_id") == F.col("class_id")) & (F.col("text_hash") == F.col("class_hash"))
    gone = classes.filter(F.col("doc_id").isNotNull() & ~own).select("doc_id", "text_hash").distinct()
    # Which of these rows stays must not depend on the order in which they come.
    least = rows.groupBy("doc_id", "text_hash").agg(F.min(F.struct("lang", "source", "n_chars", "text")).alias("r")).select("doc_id", "text_hash", "r.*")
    return least.join(gone, ["doc_id", "text_hash"], "left_anti").select(COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each secret in a text is replaced by the name of its kind in brackets. Null and empty texts stay as they are."""
    return redact(docs.select(COLUMNS))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it; a null text has no words, null sources are one source."""
    return repeated(mix_sources(docs.select(COLUMNS)), COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, token ids and their number; none for a null or empty text. Repeated rows stay."""
    ids = docs.withColumn("ids", encode_column(docs, vocabulary()))
    return ids.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("toxicity", reject_toxic),
    ("jaccard_join", one_of_each_group),
    ("secret_scan", redact_secrets),
    ("mixing", mix_to_weights),
    ("bpe", tokenize),
]

#: SQL can't express the first two stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents. Their outputs stay in the shared folder; what a stage wrote only for itself goes."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), name, keep=True)
    return docs
