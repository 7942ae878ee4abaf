"""The corpus pipeline: documents of good quality, free of toxic texts, near copies and benchmark passages, as piece ids.

Each stage takes what its predecessor kept, as a table written and read again, and all but the last
return the columns of ``documents``, whatever their names. Models are trained on the labelled rows of
the data folder. Decisions are taken by row, so null and repeated ids are no matter; an empty table
gives an empty one at each stage; texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import containment, near_dups, quality_gam, toxicity_fm
from brindle.llm.queries import piece_digest
from brindle.llm.texts import fresh_name
from brindle.session import materialize, table

#: Rows that a stage holds by the probability of its model.
THRESHOLD = 0.5
#: Words of a shingle: five, as for all near-duplicate stages without a contract of their own.
NEAR_DUP_WIDTH = 5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model finds good (probability of 0.5 or more).

    A null text scores like an empty one; equal texts are judged alike; without labels all stay.
    """
    model = quality_gam.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    name = fresh_name("probability", docs.columns)
    return quality_gam.score(docs, model, docs.columns, name).where(F.col(name) >= THRESHOLD).drop(name)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model finds clean (probability under 0.5).

    A null text scores like an empty one; equal texts are judged alike; a model without labels scores
    0.5 and rejects all, rather than let unjudged texts pass.
    """
    model = toxicity_fm.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    name = fresh_name("probability", docs.columns)
    return toxicity_fm.score(docs, model, docs.columns, name).where(F.col(name) < THRESHOLD).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of least doc_id (null ids last).

    Of rows that repeat an id and a text one stays; rows that share an id but not enough of their
    texts all stay, as do rows without words (null, empty or blank texts).
    """
    return near_dups.one_of_each(docs, NEAR_DUP_WIDTH)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item. Null and empty texts contain none; rows are judged one by one."""
    return containment.without_items(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its piece ids, their number, and what they decode to; null and empty texts have no ids. One row for each row."""
    return piece_digest(docs)


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("encoding", encoding)]

#: No SQL: the stages train models.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
