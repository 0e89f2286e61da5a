"""Millions of small files packed into Parquet once, and tables whose joins on a key need no shuffle."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "path string, modificationTime timestamp, length long, run string"
KEYS = ["path", "modificationTime", "length"]


@contextmanager
def _setting(spark: SparkSession, **values: object) -> Iterator[None]:
    keys = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _files(spark: SparkSession, roots: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots)


def manifest(spark: SparkSession, store: str) -> DataFrame:
    """(path, modificationTime, length, run) of every file that a finished run packed."""
    return spark.read.schema(MANIFEST).parquet(f"{store}/manifest")


def pack_files(spark: SparkSession, roots: str | list[str], store: str, task_bytes: int = 128 << 20) -> int:
    """Copies files under roots that the store doesn't have yet, or has with another time or length, into its Parquet; returns their number.

    Files are listed without being read (empty ones aren't listed by Spark). Spark's file source deals them to tasks of about `task_bytes`, so a task reads thousands of small
    files and writes one. The manifest is added to when the data is there: what a broken run left has no manifest and is never read. A later
    run reads the contents of files with a time from its oldest new one on only, and of these those that the manifest lacks.
    """
    spark.createDataFrame([], MANIFEST).write.mode("ignore").parquet(f"{store}/manifest")
    known = manifest(spark, store).select(KEYS)
    # A row. Contents aren't among the columns, so no file is opened.
    fresh = _files(spark, roots).select(KEYS).join(known, KEYS, "left_anti").agg(F.count("*").alias("n"), F.min("modificationTime").alias("since")).first()
    if not fresh["n"]:
        return 0
    run, since = uuid.uuid4().hex, F.col("modificationTime") >= F.lit(fresh["since"])
    with _setting(spark, spark__sql__files__maxPartitionBytes=task_bytes, spark__sql__files__openCostInBytes=4096):
        # The manifest's part since then is small, so it's sent to the contents, not they to it.
        rows = _files(spark, roots).filter(since).join(known.filter(since), KEYS, "left_anti")
        rows.select(*KEYS, "content").write.parquet(f"{store}/data/run={run}")
    done = spark.read.parquet(f"{store}/data/run={run}").select(*KEYS, F.lit(run).alias("run"))
    done.write.mode("append").parquet(f"{store}/manifest")
    return done.count()


def packed_files(spark: SparkSession, store: str) -> DataFrame:
    """(path, modificationTime, length, content) of the newest version of every packed file. Files that were deleted from their folders stay."""
    known = manifest(spark, store)
    runs = F.broadcast(known.select("run").distinct())  # a row a run
    newest = known.groupBy("path").agg(F.max(F.struct("modificationTime", "run")).alias("m"), F.count("*").alias("n")).filter("n > 1")
    older = known.join(newest, "path").filter("struct(modificationTime, run) < m").select("path", "modificationTime", "run")
    data = spark.read.schema("path string, modificationTime timestamp, length long, content binary, run string").parquet(f"{store}/data")
    return data.join(runs, "run", "left_semi").join(older, ["path", "modificationTime", "run"], "left_anti").drop("run")


def decode_files(packed: DataFrame, decode: Callable[[bytes], np.ndarray]) -> DataFrame:
    """packed files with height, width, data (as the operators of pixels take them) and decode_error instead of content. decode gives an 8-bit RGB array of an image's
    bytes; what it raises for one file is that file's decode_error, with nulls beside it, and stops no other. A null content is an error, too."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), 64):  # pixels are large
                part, rows = pdf.iloc[a : a + 64], []
                for content in part["content"]:
                    try:
                        x = np.ascontiguousarray(decode(bytes(content)), np.uint8)
                        rows.append((*x.shape[:2], x.tobytes(), None))
                    except Exception as error:  # whatever a decoder makes of broken bytes
                        rows.append((None, None, None, f"{type(error).__name__}: {error}"))
                h, w, data, errors = zip(*rows)
                yield part.drop(columns="content").assign(height=pd.array(h, "Int32"), width=pd.array(w, "Int32"), data=data, decode_error=errors)

    schema = ", ".join(f"`{c}` {t}" for c, t in packed.dtypes if c != "content")
    return packed.mapInPandas(each, f"{schema}, height int, width int, data binary, decode_error string")


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """df as a table in `buckets` buckets of key, sorted by it, one file a bucket; read back. Two tables with as many buckets of their keys
    join, and are grouped, without moving a row. With path the table's files are there instead of the warehouse."""
    out = df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    if path:
        out = out.option("path", path)
    out.saveAsTable(table)
    return df.sparkSession.table(table)
