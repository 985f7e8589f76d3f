"""From raw documents to token ids: quality rules, exact and near copies, a mix, BPE.

Every stage is given a table that lies in files of its own, as ``run`` writes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namesieve.llm import bpe, exact_dedup, mixing, quality_rules, simhash
from namesieve.llm.common import table
from namesieve.llm.queries import token_digests, tokenizer
from namesieve.shipping import ship
from namesieve.workspace import work_folder, written


def reject_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality_rules.good_documents(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return exact_dedup.without_copies(docs, in_files=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return simhash.without_near_copies(docs, in_files=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    ship(spark)
    return mixing.mixed_documents(docs, in_files=True)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids); ``ids`` are little-endian unsigned 32-bit."""
    ship(spark)
    encoded = bpe.encode_documents(docs, tokenizer(spark))
    return token_digests(encoded, F.col("ids"))


STAGES = [
    ("quality rules", reject_by_rules),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("byte-level BPE", to_tokens),
]

#: SQL has neither the forest nor XXH64 fingerprints nor the subset sum nor BPE; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    ship(spark)
    folder = work_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        docs = written(stage(spark, docs, sf_dir), f"{folder}/stage-{number}")
    return STAGES[-1][1](spark, docs, sf_dir)
