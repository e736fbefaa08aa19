"""A corpus pipeline of five of the training-data operators (their stages are in docloom/llm/stages.py). STAGES lists (name, function); a function
takes (spark, docs, sf_dir) and returns what its stage keeps. run() applies them in order, each on the written result of the one before."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import stages
from docloom.llm.common import shared_folder, table

COLUMNS = stages.COLUMNS

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("line dedup", stages.drop_repeated_runs),
    ("SimHash near-dedup", stages.drop_near_copies),
    ("mixing sources", stages.mix_sources),
    ("SentencePiece", stages.encode_pieces),
]

#: SQL can express neither the classifier nor the index; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
