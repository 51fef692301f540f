"""Clean a corpus and pack it for training: toxicity, line and near-duplicate removal, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read
again as the next stage's docs. All stages but the last return the columns of documents.
Rows with null texts stay until packing, where they count as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codegrove.llm.common import materialize
from codegrove.llm.decontaminate import drop_contaminated
from codegrove.llm.line_dedup import dedup_lines
from codegrove.llm.near_dedup import near_copies
from codegrove.llm.packing import pack
from codegrove.llm.toxicity import drop_toxic


def _free_name(docs: DataFrame, name: str) -> str:
    """name, or a longer one that no column of docs has in any case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts; n_chars follows the text."""
    removed = _free_name(docs, "n_removed")
    out = dedup_lines(docs, n_lines=_free_name(docs, "n_lines"), n_removed=removed)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(removed) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity of 0.8) the document with the smallest doc_id stays; rows without an id or a text stay."""
    copies = near_copies(docs).where("component_id < doc_id").select(F.col("doc_id").alias("copy_id"), "text_hash").distinct()
    copy = (F.col("doc_id").cast("long") == F.col("copy_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("text_hash")) & F.col("text").isNotNull()
    return docs.join(copies, copy, "left_anti").select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its place in a sequence."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Learnt scores, Jaccard joins and the tokenizer cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
