"""STR-02: exact duplicates of texts on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barline.functions.text import text_hash


def stream_unique_texts(texts: DataFrame, delay: str = "7 days", text: str = "text") -> DataFrame:
    """The first arrival of every normalised text; hashes leave the state with the watermark."""
    return (
        texts.withColumn("hash", text_hash(F.col(text)))
        .withWatermark("ts", delay)
        .dropDuplicatesWithinWatermark(["hash"])
    )
