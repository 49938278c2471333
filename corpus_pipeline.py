"""The corpus pipeline: quality, lines, near copies, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on every row of ``docs`` and, but
for the last, returns the columns of ``docs``, extra ones included whatever
their names.  Null ids, null or empty texts, repeated rows and empty tables have
the results that the operators' docstrings state: a null text is scored like an
empty one, loses no line, is no one's copy, holds no secret and stays null until
it is packed as an empty document of one token.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.llm import lines, neardup, packing, quality, secrets
from sparkwright.llm.shared import fresh, written


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` brought up to date, where the column is there."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier rejects (a score below 0.3).  Null and empty texts
    are scored alike; rows of a repeated id are scored each; an empty table stays
    empty."""
    model = quality.learnt(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (score,) = fresh(docs, "score")
    return quality.scored(docs, model, score_col=score).filter(F.col(score) >= quality.THRESHOLD).drop(score)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that three documents or more hold, but for the last holder."""
    return _counted(lines.without_repeated_lines(docs))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return neardup.one_of_each(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in place of each secret."""
    return _counted(secrets.redacted(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality_stage), ("lines", line_stage), ("near_copies", near_stage), ("secrets", secret_stage), ("packing", packing_stage)]

#: The classifier and the token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each one's rows written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
