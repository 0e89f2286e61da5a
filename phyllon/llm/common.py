"""Shared by the operators of this subpackage: shared-folder tables, run-wise batches, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Has Spark hand texts to Python in batches of at most so many rows: the usual 10,000 take much memory in executors and workers.

    Sets an option of the session, as Spark reads it when a lazy result runs; a lower setting is kept.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def slices(parts: Iterator[pd.Series], rows: int = 250) -> Iterator[pd.Series]:
    """Arrow batches in slices, so that what a UDF makes of one is small."""
    for part in parts:
        for a in range(0, len(part), rows):
            yield part.iloc[a : a + rows]


_local_dirs: dict[str, str] = {}
#: Folders and tables that operators wrote and scratch() may delete.
_written: list[tuple[str, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a temporary one on a local master, as in tests; on a cluster executors would not see it, so RuntimeError.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        app, master = spark.sparkContext.applicationId, spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if app not in _local_dirs:
            _local_dirs[app] = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        found = _local_dirs[app]
    return found.rstrip("/")


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df, written to a new Parquet table in the shared folder and read again: cuts the lineage and survives lost executors.

    With keep, scratch() leaves it.
    """
    spark = df.sparkSession
    path = new_folder(spark, name, keep)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession, name: str, keep: bool = False) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not keep:
        _written.append(("folder", path))
    return path


def new_table(name: str) -> str:
    name = f"{name}_{uuid.uuid4().hex}"
    _written.append(("table", name))
    return name


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what operators wrote inside as intermediate tables. Their results are lazy: write or collect them inside."""
    before = len(_written)
    try:
        yield
    finally:
        for kind, place in _written[before:]:
            if kind == "table":
                spark.sql(f"DROP TABLE IF EXISTS {place}")
            else:
                delete(spark, place)
        del _written[before:]


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder by Hadoop's file systems, whatever store it is in."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def runs(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """The groups of batches that are sorted by key, one at a time, also where a group goes over the end of a batch."""
    rest: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        at = pdf[key].to_numpy()
        cuts = np.flatnonzero(at[1:] != at[:-1]) + 1
        if rest and rest[-1][key].iloc[-1] != at[0]:
            yield pd.concat(rest) if len(rest) > 1 else rest[0]
            rest = []
        edges = [0, *cuts.tolist(), len(pdf)]
        for a, b in zip(edges[:-2], edges[1:-1]):
            yield pd.concat([*rest, pdf.iloc[a:b]]) if rest else pdf.iloc[a:b]
            rest = []
        rest.append(pdf.iloc[edges[-2] :])
    if rest:
        yield pd.concat(rest) if len(rest) > 1 else rest[0]


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For the vertices 0..n-1 with edges a-b, the smallest vertex of each one's component."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(jump := new[new], new):
            new = jump
        root = new[root]
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, root) for each vertex of edges (a, b): root is the smallest id that links reach.

    Alternates large-star and small-star steps until the links no longer change; each round is written to
    the shared folder. Minima are pre-aggregated before their shuffle and joined back from a table, so a vertex with very many links isn't
    gathered in one task (Spark splits the skewed join).
    """

    def star(links: DataFrame, large: bool) -> DataFrame:
        # links hold a > b. Large: every larger neighbour goes to the least neighbour; small: every smaller one does.
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionAll(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # Written, so that the join below has plain shuffles on both sides and Spark can split a vertex with very many links.
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        out = both.join(low, "u")
        if large:
            out = out.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = out.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.filter("a <> b").distinct()

    links = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    mark = None
    for _ in range(rounds):
        seen = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
        links = written(star(star(links, True), False), "links")
    else:
        raise RuntimeError("the components have not settled")
    return links.select(F.col("a").alias("id"), F.col("b").alias("root")).unionAll(links.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def cells(members: DataFrame, group: str, size: str, item: str, block: int) -> DataFrame:
    """members, each sent to the cells in which it meets all others of its group.

    A group of up to `block` members is one cell. A larger one is split in blocks by a hash of the item; there's a
    cell for each pair of blocks, so no task holds a whole group. Adds cell (string), part (0 or 1: its block
    is the first or second of the pair) and diagonal (both are the same block).
    """
    n = F.ceil(F.col(size) / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(item), n).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda other: F.struct(F.least(own, other).alias("i"), F.greatest(own, other).alias("j"), F.when(own <= other, 0).otherwise(1).alias("part")),
    )
    return (
        members.withColumn("_p", F.explode(pairs))
        .withColumn("cell", F.concat_ws(":", F.col(group), F.col("_p.i"), F.col("_p.j")))
        .withColumn("part", F.col("_p.part"))
        .withColumn("diagonal", F.col("_p.i") == F.col("_p.j"))
        .drop("_p")
    )


def by_cell(members: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, partitions: int) -> DataFrame:
    """fn over each cell's rows; many small cells share a task and none is collected beyond its own rows."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, n = [], 0
        for pdf in runs(batches, "cell"):
            out.append(fn(pdf))
            n += len(out[-1])
            if n > 5000:
                yield pd.concat(out)
                out, n = [], 0
        if n:
            yield pd.concat(out)

    return members.repartition(partitions, "cell").sortWithinPartitions("cell").mapInPandas(each, schema)
