"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, token files.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read back as
the next one's input; all but the last return the columns of `documents`. The stages' own handling
of nulls, ties, repeated rows and empty tables is in their modules' docstrings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scrollmill.llm import decontaminate, langid, mixing, simhash, token_files
from scrollmill.llm.common import new_folder, settle, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language classifier rejects go."""
    return langid.drop_rejected(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it."""
    return mixing.mix_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back: doc_id, start, n_tokens, ids_crc32."""
    folder = new_folder(spark, "tokens")
    return token_files.read_token_files(token_files.write_token_files(docs, folder, token_files.default_tokenizer()), folder)


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing_sources),
    ("token_files", token_output),
]

#: Compression sizes, XXH64 with a seed and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
