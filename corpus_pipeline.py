"""Clean a corpus and pack it for training: toxicity, line and near-duplicate removal, decontamination, packing.

The stages are in codegrove.llm.pipeline. STAGES: (name, function) in order; run(spark, sf_dir)
applies them to documents; ORACLE_SQL: None, as learnt scores and the tokenizer cannot be stated in SQL.
"""

from codegrove.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
