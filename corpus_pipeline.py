"""The training-text pipeline: language ID, near duplicates, PII, mixing to target weights, byte-level BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import bpe, jaccard, langid, mixing, pii
from tickloom.llm.common import documents, stored

#: Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
STAGES = [
    ("language_id", langid.stage),
    ("jaccard_join", jaccard.stage),
    ("pii_pseudonyms", pii.stage),
    ("mix_sources", mixing.stage),
    ("byte_bpe", bpe.stage),
]

#: No SQL: the trained model, the keyed permutations and the merges can't be said in it; tests/llm/test_pipeline.py has the brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written and read again as the next one's input."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
