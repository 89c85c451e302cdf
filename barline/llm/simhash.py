"""SimHash fingerprints, links by an inverted index over byte positions, and groups of near-duplicates.

Two fingerprints of eight bytes that differ in at most four bits agree in at least four byte positions. The index
therefore lists every distinct fingerprint under each choice of four positions and their bytes; lists that hold one
fingerprint are dropped. A pair is kept when its tally of equal positional bytes reaches four and its bits agree.

A list of many variants of one text is not paired out. Neighbours in the order of the list are linked first, those
links are joined to components, and only members of different components of a list are compared, so that no link
between components is lost and a list that hangs together costs one pass.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from barline.llm.common import components, stored, words

SEED, SHINGLE, BITS = 42, 4, 4
#: Positions that must agree: eight bytes less one for every bit that may differ.
TALLY = 8 - BITS
#: A list is linked to so many of its next members before components are formed.
NEXT = 3


def fingerprint_of(text: str | None) -> int:
    """SimHash of the A-Z-lower-cased shingles of four words, repeats included, unsigned; no word: zero."""
    w = [x.lower() for x in words(text)]
    if not w:
        return 0
    joined = b" ".join(w)
    lengths = np.fromiter(map(len, w), np.int64, len(w))
    ends = np.cumsum(lengths + 1) - 1
    n = max(1, len(w) - SHINGLE + 1)
    first, last = (ends - lengths)[:n].tolist(), ends[min(SHINGLE, len(w)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first, last)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        bits = np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text column as a long (two's complement)."""

    @F.arrow_udf("long")
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint_of(t.as_py()) for t in texts], np.uint64).view(np.int64))

    return prints(text)


def links(prints: DataFrame) -> DataFrame:
    """Star edges (a, b) that join every group of distinct fingerprints ``fp`` linked within ``BITS`` bits.

    Edges of the result connect exactly what the links connect; they need not be links themselves.
    """
    masks = [sum(0xFF << 8 * i for i in at) for at in combinations(range(8), TALLY)]
    # Masks as signed 64-bit numbers, ordered by positions.
    lits = F.array(*[F.lit(m - 2**64 if m >= 2**63 else m).cast("long") for m in masks])
    listed = prints.select("fp", F.explode(lits).alias("mask")).select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("bytes"))
    order = Window.partitionBy("mask", "bytes").orderBy("fp")
    shared = stored(
        listed.select("*", F.lag("fp").over(order).alias("before"), *[F.lead("fp", i).over(order).alias(f"next{i}") for i in range(1, NEXT + 1)])
        .filter("before IS NOT NULL OR next1 IS NOT NULL"),
        "shared",
    )
    near = shared.select(F.col("fp").alias("a"), F.explode(F.array(*[f"next{i}" for i in range(1, NEXT + 1)])).alias("b"))
    stars = components(near.filter(linked("a", "b")).distinct())
    rooted = shared.select("fp", "mask", "bytes").join(stars.withColumnRenamed("node", "fp"), "fp", "left")
    rooted = stored(rooted.withColumn("root", F.coalesce("root", "fp")), "rooted")
    # Lists of one component have nothing left to compare.
    mixed = rooted.groupBy("mask", "bytes").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi")
    left = rooted.join(mixed, ["mask", "bytes"], "left_semi")
    x = left.select("mask", "bytes", F.col("fp").alias("a"), F.col("root").alias("ra"))
    y = left.select(F.col("mask").alias("mask2"), F.col("bytes").alias("bytes2"), F.col("fp").alias("b"), F.col("root").alias("rb"))
    across = x.join(y, (F.col("mask") == F.col("mask2")) & (F.col("bytes") == F.col("bytes2")) & (F.col("ra") < F.col("rb")) & linked("a", "b"))
    return stars.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).union(
        across.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
    )


def linked(a: str, b: str) -> Column:
    """At least ``TALLY`` equal positional bytes, then at most ``BITS`` differing bits."""
    x = F.col(a).bitwiseXOR(F.col(b))
    equal = sum((F.when(F.shiftright(x, 8 * i).bitwiseAND(F.lit(255)) == 0, 1).otherwise(0) for i in range(8)), F.lit(0))
    return (equal >= TALLY) & (F.bit_count(x) <= BITS)


def named(prints: DataFrame) -> DataFrame:
    """(fp, root, component_id, pick) of the distinct fingerprints of (doc_id, fp) rows; ``pick`` marks one of a group."""
    firsts = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "firsts")
    groups = components(links(firsts.select("fp")))
    joined = firsts.join(groups, F.col("fp") == F.col("node")).select("fp", "root", "first")
    # The smallest id, nulls last, and the fingerprint that has it.
    lowest = joined.groupBy("root").agg(F.min(F.struct(F.isnull("first"), "first", "fp")).alias("low"))
    lowest = joined.join(lowest, "root").select("fp", "root", F.col("low.first").alias("lowest"), F.col("low.fp").alias("low_fp"))
    return firsts.join(lowest, "fp", "left").select(
        "fp",
        F.coalesce("root", "fp").alias("root"),
        F.when(F.isnull("root"), F.col("first")).otherwise(F.col("lowest")).alias("component_id"),
        (F.coalesce("low_fp", "fp") == F.col("fp")).alias("pick"),
    )


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, root, component_id) of every row of ``docs``.

    ``root`` names the group of linked fingerprints, ``component_id`` is its smallest doc_id. Null and empty texts
    have fingerprint zero and link like any other; repeated rows come back as often as they came; null ids are
    not counted for the smallest, and a group of null ids alone has a null ``component_id``.
    """
    prints = stored(docs.select("doc_id", fingerprint(F.col("text")).alias("fp")), "prints")
    return prints.join(named(prints).drop("pick"), "fp").select("doc_id", "fp", "root", "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each group: that with the smallest id, whole and once, with the columns of ``docs``."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    marked = stored(docs.select(whole, "doc_id", fingerprint(F.col("text")).alias("_fp")), "marked")
    picks = named(marked.select("doc_id", F.col("_fp").alias("fp"))).filter("pick")
    # Joined on fingerprint and id, so that the copies of one text do not meet in one task.
    key = lambda c: (F.coalesce(c, F.lit(0)), F.isnull(c))
    picks = picks.select(F.col("fp").alias("_fp"), *(k.alias(n) for k, n in zip(key(F.col("component_id")), ("_id", "_no"))))
    rows = marked.withColumns(dict(zip(("_id", "_no"), key(F.col("doc_id")))))
    kept = rows.join(picks, ["_fp", "_id", "_no"], "left_semi").dropDuplicates(["_fp", "_id", "_no"])
    return kept.select("_doc.*")
