"""A corpus pipeline of five stages, each one operator of folioforge.llm: documents in, token ids out.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame with the columns of
documents, except for the last one. run() writes each stage's result as Parquet into the shared folder and rereads it.

Null texts count as empty and are never dropped for it; rows without id are judged by their text alone; of rows that
repeat an id and the words near_duplicates keeps one; columns of any name pass through all stages but the last; an
empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioforge.llm import op1_sentencepiece, op4_jaccard, op7_decontaminate, op8_toxicity, op9_substrings
from folioforge.llm.common import given_back, table, written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go. It learns from all labels, and an example is judged by the others, never by its own label."""
    model = op8_toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return op8_toxicity.keep_clean(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the one of the smallest id. Rows without id stay."""
    return op4_jaccard.keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that repeat an earlier document's window are cut out; a document that loses its last word goes."""
    return op9_substrings.cut_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, rows without id too."""
    return op7_decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it."""
    return op1_sentencepiece.sentencepiece_round_trip(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: The model fits, the similarity classes and the tokens can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage has written for itself is deleted once its result is there, and results but the last one when all is done."""
    docs = table(spark, sf_dir, "documents")
    with given_back(spark) as last:
        for _, stage in STAGES:
            with given_back(spark) as result:
                docs, folder = written(stage(spark, docs, sf_dir))
                result.append(folder)
        last.append(folder)
    return docs
