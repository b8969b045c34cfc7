"""A corpus pipeline: each stage takes the documents that the one before it left.

Stages: documents whose restored text is toxic go; one document of each class of
near copies stays (the smallest id; rows without an id all stay); personal data get surrogates; sources are mixed to
the default plan's target weights; the texts that remain are encoded and decoded.

Defined results: empty tables give an empty result; null texts and texts without
words pass every stage; without labels nothing is toxic; rows without an id and
repeated rows of the smallest id of their class stay; other columns are kept up
to the last stage. The mix cuts the text that a source's prefix ends in.
Texts of any length are read whole by every stage. Ties: of near copies the smallest
id stays; of equal rows at the end of a source's prefix some are taken whole and one
in part, whichever they are, as they are equal.

All stages but the last return the columns of ``documents``. Each result is
written to the folder that all executors share and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanmill.llm import bpe, mixing, pii, simhash, toxicity
from spanmill.llm.common import read_table, stored
from spanmill.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score below the threshold."""
    return toxicity.keep_clean(docs, read_table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return simhash.representatives(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with surrogates."""
    return pii.replace_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once for each epoch."""
    return mixing.select_documents(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids and decoded texts of the documents, as digests."""
    return bpe.round_trip(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("pii", replace_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode_texts),
]
#: The first two stages cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
