"""A corpus pipeline of five stages, each applying one operator to all its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.exact_dedup import drop_copies
from tidewater.llm.ngram_join import keep_one
from tidewater.llm.packing import pack
from tidewater.llm.pii import key_of, replace
from tidewater.llm.tables import load, materialise
from tidewater.llm.toxicity import fit, keep_ordinary
from tidewater.sources.store import discard, scope

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return keep_ordinary(docs.select(*COLUMNS), fit(docs, load(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return drop_copies(docs.select(*COLUMNS)).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest id stays."""
    return keep_one(docs.select(*COLUMNS)).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by surrogates; n_chars follows the new text."""
    changed = replace(docs.select(*COLUMNS), key_of(spark))
    return changed.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return pack(
        docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, {"<|endoftext|>": 50256}
    )


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_copies),
    ("ngram_join", near_copies),
    ("pii", personal_data),
    ("packing", packing),
]

# a trained model decides in the first stage
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order on `documents`, each written and read again before the next.

    What a stage has written goes as soon as its result is written.
    """
    docs, before = load(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with scope() as written:
            docs = materialise(stage(spark, docs, sf_dir), name)
        discard(spark, before + written[:-1])
        before = written[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
