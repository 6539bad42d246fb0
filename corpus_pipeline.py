"""Raw documents to packed training sequences: the corpus operators in a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomtext.llm import minhash, mixing, packing, pu_quality, quality_rules
from loomtext.llm.common import between_stages, table

STAGES = [
    ("quality rules", quality_rules.stage),
    ("quality classifier", pu_quality.stage),
    ("near-duplicates", minhash.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]
#: The classifier's fit and near-duplicates can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; what one stage keeps is written once, and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = between_stages(docs)
    return docs
