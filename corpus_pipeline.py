"""A training-corpus pipeline: each stage calls one operator on all that its predecessor kept.

Defined results: null and empty texts fail the quality rules; rows are told apart by doc_id and text, so repeated rows
and copies leave one row (the least doc_id, nulls last), and different texts under one id, or with none, are judged each
by themselves; without labels no document is toxic or bad but by the base rules; without benchmark items nothing is
taken out as a leak; very long texts are read whole; an empty table gives an empty table; columns beside doc_id and
text go along unread, whatever their names.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.llm import bpe, decontam, quality, simhash, toxicity
from lectern.llm.common import cut, table
from lectern.llm.queries import RANKS


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the packed ids, with digests of the ids and of what they decode to."""
    coded = bpe.encode(docs, bpe.read_ranks(public_tokenizers.path(RANKS)), public_tokenizers.PATTERN, decoded=True)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxic), ("quality_rules", rules), ("simhash_near_dedup", near_duplicates), ("decontamination", decontaminate), ("byte_bpe", tokens)]

#: Learned scores, alignment and 64-bit hashes have no SQL; a test holds run() against each stage's decision made plainly.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage.  Between stages the kept documents are checkpointed in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
