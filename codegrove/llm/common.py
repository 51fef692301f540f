"""Pieces shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from codegrove.session import shared_dir


#: Spark deletes the shuffle files of an execution when that ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends here and a lost executor costs no recomputation. options: of the writer."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/codegrove-{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(_CLEAN, before) if before is not None else spark.conf.unset(_CLEAN)
    return spark.read.schema(df.schema).parquet(path)


def trimmed(run):
    """run, a function for mapInArrow, that hands free memory back to the system at the end of a partition: workers live on, and what they keep is missing elsewhere."""

    @functools.wraps(run)
    def out(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)

    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a DataFrame that materialize returned and nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def dealt(df: DataFrame) -> DataFrame:
    """df, or where it is read from fewer files than there are cores, df dealt out among them: a small file is often a single task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() > 4 * cores or len(df.inputFiles()) >= cores else df.repartition(2 * cores)


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph given as (u, v) long pairs.

    Returns (node, component) for every node that has an edge; component is the
    smallest node reachable. Alternates large-star and small-star steps until every node
    that is not a root has one parent and that is a root, so rounds grow with the logarithm of the graph's size.
    Each round is written to the shared folder. No edges: an empty result.
    """
    current = materialize(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = materialize(small.union(least).distinct(), "small-star")
        roots = current.select(F.col("v").alias("u"), F.lit(True).alias("root")).distinct()
        if current.groupBy("u").count().join(roots, "u", "left").where("count > 1 or root").isEmpty():
            break
    nodes = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
