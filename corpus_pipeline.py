"""A corpus pipeline: language ID, line dedup, near-duplicate join, decontamination, packing.

Each stage takes the rows that its predecessor kept, written as Parquet, and returns the columns of ``documents``; the
last returns the packed pieces. Defined results: rows without a letter, null and empty texts among them, go with the first
stage; a row that loses all its words goes with the second; of equal or linked texts the row of the least id stays, ids before
null; a row that holds a test item goes, whatever its id. Empty tables give an empty result. Further columns are carried as
they are up to the packing, which leaves them out.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import decontaminate, jaccard_join, language_id, line_dedup, packing
from tidewell.llm.common import materialise, table


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.keep_new_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify),
    ("line_dedup", dedup_lines),
    ("jaccard_join", dedup_documents),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL can't express trained language ID, nor packing; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
