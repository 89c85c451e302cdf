"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from barline.llm import decontamination, licenses, mixing, phrases
from barline.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op3_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from barline.llm import bpe

    return bpe.digests(bpe.round_trip(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


@query
def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    from barline.llm import simhash

    found = simhash.near_groups(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from barline.llm import substrings

    left = substrings.deduplicated(table(spark, folder, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query
def op7_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from barline.llm import suffixes

    left = suffixes.deduplicated(table(spark, folder, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    from barline.llm import mixing

    mix = mixing.mixed(table(spark, folder, "documents"), keep=["doc_id"])
    taken = F.aggregate("_mix.draws", F.lit(0).cast("long"), lambda acc, d: acc + d["words"])
    return mix.select("doc_id", "_mix.size", "_mix.source_size", "_mix.target", taken.alias("taken"))


@query
def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    from barline.llm import quality

    judged = quality.judged(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels"))
    return judged.select("doc_id", "_quality.*")


ORACLE["op8_mixing"] = mixing.TAKEN_SQL.format(docs="documents")


@query
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from barline.llm import toxicity

    return toxicity.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op2_html(spark: SparkSession, folder: str) -> DataFrame:
    from barline.llm import html

    return html.extracted(table(spark, folder, "pages"))


@query
def op4_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scanned(table(spark, folder, "documents"))


ORACLE["op4_licenses"] = licenses.oracle()


@query
def op6_top_k(spark: SparkSession, folder: str) -> DataFrame:
    from barline.llm import topk

    return topk.top_k(table(spark, folder, "embeddings"), lambda i: F.col(i) % 20 == 0)


ORACLE["op6_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL
  AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query
def op11_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    from barline.llm import decontamination

    return decontamination.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


ORACLE["op11_decontamination"] = decontamination.SQL


@query
def op12_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))


ORACLE["op12_phrases"] = phrases.SQL


@query
def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers as given

    from barline.llm import alignment

    paths = given.path("byte_bpe_50k.json"), given.path("piece_bpe_32k.model")
    return alignment.alignment(table(spark, folder, "documents"), *paths, given.PATTERN).drop("links")
