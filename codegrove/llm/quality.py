"""Quality classifier: positive-unlabelled learning from trusted good texts and unlabelled web text."""

from __future__ import annotations

from pyspark.sql import DataFrame

from codegrove.llm import pu

#: Weight decay times the number of positives, chosen on rows inside the learning fold.
STRENGTH = 0.02
FOLDS, HELD, THRESHOLD = 5, 0, 0.3


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = pu.SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted): the chance that labels.quality is 1. Cases of nulls and ties: pu.classify."""
    return pu.classify(docs, labels, "quality", FOLDS, HELD, THRESHOLD, sample, STRENGTH)
