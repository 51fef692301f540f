"""Toxicity classifier: non-negative positive-unlabelled learning from confirmed toxic texts and unlabelled text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codegrove.llm import pu

#: Weight decay times the number of positives, chosen on rows inside the learning fold.
STRENGTH = 0.25
FOLDS, HELD, THRESHOLD = 4, 2, 0.3


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = pu.SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted): the chance that labels.toxic is 1. Cases of nulls and ties: pu.classify."""
    return pu.classify(docs, labels, "toxic", FOLDS, HELD, THRESHOLD, sample, STRENGTH)


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = pu.SAMPLE) -> DataFrame:
    """The rows of docs, all columns unchanged, whose text is not predicted toxic."""
    model = pu.fit(docs, labels, "toxic", FOLDS, HELD, sample, strength=STRENGTH)
    return docs.where(pu.score(F.col("text"), model) < THRESHOLD)
