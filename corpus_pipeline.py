"""The corpus pipeline: documents in, tokens out, by five of the training-data operators.

Each stage takes what its predecessor kept, written as Parquet and read again. All but the last return the columns of
``documents``, whatever other columns there are. Every stage takes null ids, repeated rows, texts of any length and
empty tables, which give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxelake.llm import bpe, langid, mixing, secret_scan, simhash
from voxelake.llm.common import read, scratch, tune, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language cannot be told, and set ``lang`` to what is told of the others.

    Null and empty texts, texts of no letter and texts of too low a score go; repeated rows share their fate. Without
    any label to learn from, texts with a letter all stay as they are.
    """
    tune(spark)
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each group of near duplicates.

    Null texts count as empty ones, which are a group. A group of null ids alone keeps one row, and rows that repeat
    the kept id and text stay together, as one document.
    """
    tune(spark)
    return simhash.deduplicate(docs, words=3, close=3)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by a mark; every document stays. Null texts stay null, and ``n_chars`` follows the text."""
    tune(spark)
    return secret_scan.redact_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Give each document the number of copies that brings its source to its target.

    Null sources are one source, the last. Documents of no words are copied by their rate and count nothing; a
    document may get no copy, and repeated rows get equally many.
    """
    tune(spark)
    return mixing.apply_mix(docs, weights=(3, 1, 2), share=1.5, cap=2.0)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode: (doc_id, n_tokens, ids_sha256, decoded_sha256), a row per copy. Null texts have no tokens."""
    tune(spark)
    return bpe.round_trip(docs, bpe.default_tokenizer())


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("secrets", secrets),
    ("mix_sources", mix_sources),
    ("tokenize", tokenize),
]

#: SQL cannot express the classifier, the fingerprints and the tokenizer: tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        # what a stage wrote on the way goes when its result is stored; its input stays for a rerun
        with scratch(spark, name):
            docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
