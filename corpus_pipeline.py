"""A training corpus from raw documents: five stages, each over all rows that the one before kept.

Each stage returns the columns of ``documents`` (the last one token digests); ``n_chars`` follows the text.
"""

from __future__ import annotations

import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barline.llm import bpe, mixing, quality, simhash, suffixes
from barline.llm.common import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents_of(rows: DataFrame) -> DataFrame:
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that fail the base counts or score below the threshold go; those without text are among them."""
    return quality.judged(docs, table(spark, folder, "labels")).filter("_quality.kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id."""
    return simhash.deduplicated(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Bytes of passages that start earlier in the corpus go; a character that is cut goes whole.

    Every row stays, with what is left of its text, so that no id is lost here; the mix takes nothing from a row
    without words.
    """
    left = suffixes.deduplicated(docs, rest=True)
    return documents_of(left.select("_rest.*", whole_characters(F.col("kept")).alias("text")))


def whole_characters(raw: Column) -> Column:
    """The text of bytes without those that are no part of a whole UTF-8 character."""

    @F.arrow_udf("string")
    def clean(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else v.decode("utf-8", "ignore") for v in values.to_pylist()], pa.string())

    return clean(raw)


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """As many copies of each document as the mix of sources takes; the last of a source's quota is cut to size.

    The partitions, one after the other, hold the shards of the mix, each in its shuffled order; a large shard takes several.
    """
    rows = mixing.written(mixing.mixed(docs), COLUMNS)
    return documents_of(rows.repartitionByRange("_shard", "_order").sortWithinPartitions("_shard", "_order", "doc_id"))


def tokenize(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Digests of the token ids and of the decoded text of every row."""
    return bpe.digests(bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources", mix_sources),
    ("bpe round trip", tokenize),
]

#: Fingerprints, suffixes and merges are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written as Parquet and read again for the next."""
    docs = table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, folder), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, folder)
