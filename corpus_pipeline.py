"""A training-data pipeline over the documents table: quality rules, language, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all rows that the stage before kept, and all but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cartulary.llm.jaccard_join import keep_one_each
from cartulary.llm.language_id import keep_identified
from cartulary.llm.packing import pack_stage
from cartulary.llm.quality import keep_quality
from cartulary.llm.secret_scan import mask_secrets
from cartulary.scratch import cut

STAGES = [
    ("quality_rules", keep_quality),
    ("language_id", keep_identified),
    ("near_duplicates", keep_one_each),
    ("secret_scan", mask_secrets),
    ("packing", pack_stage),
]

#: Hashing, automata, layered decoding and a tokenizer are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the packed corpus. Each stage's rows are written as Parquet in the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
