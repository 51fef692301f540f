"""Extension: the same per-file metrics over a folder that grows. Stateless: each file is its own unit of work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from codegrove.api import Corpus


def stream_sources(spark: SparkSession, path: str, glob: str = "*.py") -> DataFrame:
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).load(path).select("path", "content")


def write_tags(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append the tags of new files below path to Parquet files in out; start() with what is there and stop."""
    rows = Corpus(stream_sources(spark, path)).tags()
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
