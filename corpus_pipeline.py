"""A corpus from raw documents to tokens: reject toxic texts, drop near copies and repeated passages, mix, encode."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import bpe, mixing, simhash, suffix, toxicity
from tidemark.llm.common import checkpointed, fresh, read
from tidemark.llm.queries import TOKENIZER

#: Bytes of a repeated string that goes. Of all runs of 51 words in the test documents 99.4 % are as long (median 316).
PASSAGE = 250


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold; the model learns from `labels` of the sf_dir."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    name = fresh(docs, "score")
    return toxicity.score(docs, model, name=name).where(F.col(name) < toxicity.THRESHOLD).drop(name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that with the smallest id, of each group of near-equal fingerprints."""
    return simhash.simhash_dedup(docs)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of `PASSAGE` bytes that repeat; a document of which nothing is left stays, empty."""
    name = fresh(docs, "cut")
    cut = suffix.dedup(docs, length=PASSAGE).withColumn("text", F.when(F.col("text").isNotNull(), F.col(name)["kept"])).drop(name)
    return _with_length(cut)


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long")) if "n_chars" in docs.columns else docs


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training stream: documents as often as the source weights take them, in curriculum order."""
    return _with_length(mixing.curriculum(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text for each document of the mix."""
    return bpe.encode_decode(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("toxicity", reject_toxic), ("simhash near-dedup", drop_near_copies), ("suffix-array dedup", drop_passages), ("mixing", mix_sources), ("bpe", encode)]
#: The classifier, the fingerprints and the tokenizer have no SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn on `documents`. What a stage keeps is written before the next one, which reads it several times."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
