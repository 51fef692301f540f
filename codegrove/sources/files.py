"""Source corpora from files. Decoding is strict and happens in the parser, so a broken file is a row, not a failure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_sources(spark: SparkSession, path: str, glob: str = "*.py") -> DataFrame:
    """(path, content) of all files below path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """One row: the whole text of a file."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")
