"""From raw documents to token counts, in five stages.

Each stage takes what its predecessor kept, as written to Parquet, and returns the columns of
``documents``; the last returns one row of token figures for each document. Extra columns
pass through all stages but the last, whatever their names. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrella.llm import bpe, exact_dedup, mixing, quality, simhash
from sentrella.llm.common import discard, remainder, saved, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier accepts (score of 0.5 or more)."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 3) != 1)
    return docs.where(quality.chance(docs["text"], model) >= 0.5)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row of the largest doc_id (one row where that repeats)."""
    return exact_dedup.survivors(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, the document whose doc_id names it."""
    return simhash.survivors(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose weights follow the target marginals; a document of a raised cell repeats."""
    return mixing.sample(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), columns=["doc_id", "source", "lang"])


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix),
    ("BPE encoding and decoding", tokenise),
]
#: A trained classifier and a tokenizer are no SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), "stage-" + "".join(c if c.isalnum() else "-" for c in name.lower()))
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
