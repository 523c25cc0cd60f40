"""A corpus pipeline over ``documents`` in five stages, each written and read again as the next one's input.

1. quality rules: documents that the robust rules reject go.
2. n-gram Jaccard join: one document of each component of near copies stays, the one with the least id.
3. secret scans: secrets in the texts are masked, and n_chars follows.
4. mixing: a document stays as often as the mix takes it (not at all, once or twice).
5. packing: the ids of what is left, cut into power-of-two sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import materialize, release
from paperloom.llm.mixing import mixed_rows
from paperloom.llm.ngram_join import one_of_each
from paperloom.llm.packing import pack_power_of_two
from paperloom.llm.quality_rules import keep_good
from paperloom.llm.secret_scan import redact_secrets

def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, the one with the least id; of equal rows one."""
    return one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with secrets masked."""
    return redact_secrets(docs).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixed_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces, each a sequence of its own."""
    packed = pack_power_of_two(docs)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


STAGES = [("quality rules", quality), ("n-gram jaccard join", near_duplicates), ("secret scans", secrets), ("mixing sources to target weights", mixing), ("packing", packing)]

#: SQL can express neither the novelty measure nor the tokenizer; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{i}")
            release(before)
    return docs
