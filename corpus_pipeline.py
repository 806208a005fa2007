"""A training corpus from the documents table, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Models are fitted
on the label table of sf_dir; a stage is judged on its own input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenfold.llm.common import durable
from lumenfold.llm.mixing import mix_stage
from lumenfold.llm.pieces import encode_stage
from lumenfold.llm.quality_model import keep_good
from lumenfold.llm.simhash import keep_one
from lumenfold.llm.toxicity import reject_toxic

STAGES = [
    ("toxicity", reject_toxic),
    ("quality", keep_good),
    ("near_duplicates", keep_one),
    ("mixing", mix_stage),
    ("sentencepiece", encode_stage),
]

#: Fitted models, components and segmentations are not SQL; tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else durable(docs), sf_dir)
    return docs
