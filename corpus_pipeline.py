"""Corpus pipeline: five stages over ``documents``, each one of the operators of ``tessera.llm``.

toxicity -> exact dedup -> SimHash near-dedup -> mixing sources to target weights -> BPE encoding and decoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet to the shared folder and
read again as the next one's ``docs``, so a lost executor costs one stage at most. All but the last return the
columns of ``documents``; the last returns one row for each document of the mix (a document taken twice is there
twice) with its tokens.
"""
from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe_reuse, common, exact_dedup, mixing, simhash_cover, toxicity
from tessera.llm.units import tokenizer_blob
from tessera.session import discard

TOKENIZER = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the model learns from their labels (never from fold 2)."""
    common.prepare(spark)
    return toxicity.drop_toxic(docs, toxicity.train(docs, common.read(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the largest id."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest id."""
    return simhash_cover.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (unsigned 32-bit little-endian) and digests of ids and decoded text."""
    import public_tokenizers

    blob = tokenizer_blob(public_tokenizers.path(TOKENIZER))
    encoded = bpe_reuse.encode_decode(docs, blob, keep=["doc_id", "lang", "source"])
    return bpe_reuse.with_digests(encoded.withColumn("_ids", F.col("ids"))).withColumnRenamed("_ids", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

# a trained classifier, connected components, random rounding and a tokenizer are beyond SQL; see tests/llm
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    common.prepare(spark)
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, common.stage(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
        discard(before)     # the input table is not staged and stays
    return docs
