"""From raw documents to token ids: five operators, each on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pagelens.llm import bpe, minhash, mixing, quality_rules, suffix_dedup
from pagelens.llm.common import Scratch, read
from pagelens.llm.queries import VOCABULARY


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go.

    Null and empty texts have no words and go; repeated rows share one verdict; a null
    doc_id has no label and is judged like any other; an empty table stays empty; extra
    columns stay as they are.
    """
    return quality_rules.kept_documents(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each near-duplicate group stays.

    Null and empty texts link with nothing and stay; rows that repeat a doc_id stay or go
    together; a null doc_id stays; texts of any length are compared whole; an empty table
    stays empty; extra columns stay as they are.
    """
    return minhash.kept_documents(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that repeat a smaller document go.

    Null, empty and short texts stay as they are; rows that repeat a doc_id lose nothing
    to each other; a null doc_id loses nothing; a text that loses all its bytes becomes
    empty; n_chars follows a text that was cut; an empty table stays empty; extra columns
    stay as they are.
    """
    return suffix_dedup.dedup_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares; a row for each document and pass over its source.

    Null and empty texts have no words to take and go; repeated rows are separate
    documents; a null source is a source of its own, ordered last; n_chars follows the
    text; an empty table stays empty; extra columns stay as they are.
    """
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of the ids and of what they decode to.

    A null text is empty and has no ids; rows stay apart, whatever their doc_id; texts of
    any length are encoded whole; an empty table gives no rows; extra columns aren't kept.
    """
    return bpe.round_trip(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality rules", quality),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", substring_dedup),
    ("mixing sources", mix),
    ("BPE encoding", encode),
]

#: Learned rules and hashed draws have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.put(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
