"""A training corpus in five stages: toxic, copied, nearly copied and leaked documents go, the rest is mixed.

``run(spark, sf_dir)`` applies ``STAGES`` to the table ``documents``. Each stage is written as
Parquet to the shared folder and read again as the next one's input, so a lost executor costs tasks
of one stage. All stages but the last return the columns of documents; the last returns the
documents of the mixture, once for each time they are taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapeledger.llm.common import read, written
from tapeledger.llm.decontaminate import decontamination_stage
from tapeledger.llm.exact_dedup import exact_dedup_stage
from tapeledger.llm.jaccard_join import jaccard_stage
from tapeledger.llm.mixing import mixing_stage
from tapeledger.llm.toxicity import toxicity_stage

STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("jaccard_join", jaccard_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

# The scores of the first stage come from a fitted machine, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
