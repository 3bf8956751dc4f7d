"""The corpus pipeline: toxicity, line dedup, near-dedup, mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
documents. run() writes every stage's result to the shared folder, so a lost executor never repeats an earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, lines, minhash, mixing, queries, toxicity
from quarry.llm.common import DOCUMENT_COLUMNS, materialize, table

#: Scores and random draws can't be said in SQL for the whole chain; tests compare the stages with brute force.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model doesn't predict toxic; fitted to the labelled part of docs. Null and empty texts stay, as do null ids and repeated rows."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.clean(docs.select(*DOCUMENT_COLUMNS), model)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that repeat an earlier one; n_chars follows. Null texts stay null, a text whose lines all go is empty."""
    return lines.dedup(docs.select(*DOCUMENT_COLUMNS)).select(*DOCUMENT_COLUMNS)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that of the least id; null texts and null ids stay. Empty texts are one class."""
    return minhash.deduplicated(docs.select(*DOCUMENT_COLUMNS))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in equal shares; a document that is drawn several times is several rows, one drawn never is gone. Null sources are one source."""
    return mixing.mix(docs.select(*DOCUMENT_COLUMNS)).select(*DOCUMENT_COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of each row's tokens; a null text counts as empty."""
    return bpe.digests(docs, queries.tokenizer_path())


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("near-dedup", without_near_duplicates),
    ("mixing", mixed),
    ("bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*DOCUMENT_COLUMNS)
    for name, stage in STAGES:
        docs = materialize(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
