"""Documents to a sharded training mix in five stages.

Each stage takes (spark, docs, sf_dir), works on every row of ``docs`` and
returns a DataFrame that is written as Parquet and read again for the next.
All but the last return the columns of ``docs``; the last adds size,
text_crc32, shard and slot. Empty tables pass through as empty tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillbook.llm import decontam, mixing, overlap, quality, sharding
from quillbook.llm.common import read
from quillbook.llm.queries import MIX_WEIGHTS
from quillbook.session import delete_folder, ensure_checkpoint_dir, scratch

SHARDS = 40


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and that the isolation forest, fitted on labelled rows, doesn't single out."""
    return quality.passing(docs, read(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that with the smallest doc_id, of each group of texts linked at 0.8 of their five-word shingles or more.

    Texts with fingerprints two bits apart or nearer are candidates, as are those that share a band of minima.
    """
    return overlap.one_per_group(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that cover no benchmark item."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, put in the order in which they are to be trained on: sources interleaved to their target weights."""
    return mixing.in_order(docs, MIX_WEIGHTS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard, and their slot in it."""
    return sharding.packed(docs, SHARDS)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing to target weights", mixing_to_weights),
    ("sharding", shard),
]

#: SQL has no isolation forest and no greedy packing; tests/llm compares the rows with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``, each written to the checkpoint folder and read again.

    A stage's rows are deleted when the next one's are written; the last one's stay for the caller.
    """
    docs = read(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(f"{folder}/{number}")
        if number:
            delete_folder(spark, f"{folder}/{number - 1}")
        docs = spark.read.schema(made.schema).parquet(f"{folder}/{number}")
    return docs
