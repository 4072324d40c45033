"""Corpus pipeline: from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it has
kept; its output is written as Parquet and read again as the next one's input. All but
the last return the columns of ``documents``, whatever further columns these have.

Every stage takes an empty table (no rows come out), repeated rows and ids, null or
empty texts and texts of any length; what it decides for them is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm import bpe, decontamination, exact_dedup, near_dedup, toxicity
from rivulet.llm.storage import Scratch, bounded_batches, documents


#: Workers serve all stages, so the last one's memos are kept small.
MEMO_BYTES = 40 << 20


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold.

    Null and empty texts have the score of no evidence and stay; repeated rows score
    alike and share their fate.
    """
    return toxicity.drop_toxic(bounded_batches(docs), toxicity.learn_from(spark, sf_dir))


def exact_dedup_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of equal texts.

    Null and empty texts are equal, so one row of them stays; rows that repeat an id and
    its text stay or go together; a row without an id gives way to one with.
    """
    return exact_dedup.drop_exact_duplicates(docs)


def near_dedup_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near copies.

    Texts without words and rows without an id are linked with nothing and stay; rows
    that repeat an id stay or go together.
    """
    return near_dedup.drop_near_duplicates(bounded_batches(docs))


def decontamination_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item.

    Texts without words hold none and stay; items without words are in no document.
    """
    return decontamination.decontaminate(bounded_batches(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of them and of the decoded bytes.

    Null and empty texts have no ids; every row, repeated ones too, gives one row.
    """
    found = bpe.bpe_round_trip(bounded_batches(docs), keep=("doc_id", "lang", "source"), memo_bytes=MEMO_BYTES)
    ids, decoded = F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    return found.select("doc_id", "lang", "source", "n_tokens", "token_ids", ids, decoded)


STAGES = [
    ("toxicity", toxicity_filter),
    ("exact_dedup", exact_dedup_filter),
    ("near_dedup", near_dedup_filter),
    ("decontamination", decontamination_filter),
    ("byte_bpe", encode),
]

#: A learned filter and a tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; a stage's table goes once the next is written."""
    docs, scratch, before = documents(spark, sf_dir), Scratch(spark), None
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            scratch.release(before)
        before = f"stage-{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
