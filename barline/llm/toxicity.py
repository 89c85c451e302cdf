"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

Features are hashes of words, of pairs of neighbouring words and of pairs with one word between, each counted once in
a text. The learner sees a bounded sample of labelled documents (``SAMPLE_ROWS``), one at a time in a fixed order,
with a rate for every coordinate; the L1 term leaves weights only where several toxic texts agree. Those few
(feature, weight) pairs go to all tasks, and every text is scored whole.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from barline.llm.common import CACHE_WORDS, mix

#: Most labelled rows that the learner sees, whatever the size of the corpus.
SAMPLE_ROWS = 12_000
EPOCHS = 8
#: Features of fewer sampled documents are not learnt.
LEAST_DOCUMENTS = 4
#: Rate, its offset, L1 and L2 of FTRL-proximal.
ALPHA, BETA, L1, L2 = 3.0, 1.0, 5.0, 0.1
#: A score from here on predicts a toxic text.
CUT = 0.7

TOKEN = re.compile(r"\w+")


class TokenHashes(dict):
    def __missing__(self, token: str) -> int:
        value = xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"), 1)
        if len(token) <= 64:
            self[token] = value
        return value


_hashes = TokenHashes()


def features(text: str | None) -> np.ndarray:
    """Hashes of the n-grams and skip-grams of a text, in no order, with repeats."""
    if not text:
        return np.empty(0, np.uint64)
    if len(_hashes) > CACHE_WORDS:
        _hashes.clear()
    tokens = TOKEN.findall(text.lower())
    h = np.fromiter(map(_hashes.__getitem__, tokens), np.uint64, len(tokens))
    pair, skip = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    return np.concatenate([h, mix(h[:-1] * pair + h[1:]), mix(h[:-2] * skip + h[2:])])


def distinct_features(text: Column) -> Column:
    @F.arrow_udf("array<long>")
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([np.unique(features(t.as_py())).view(np.int64) for t in texts], pa.list_(pa.int64()))

    return found(text)


def ftrl(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, bias): the coordinates that L1 leaves, of examples given as arrays of distinct features."""
    flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    names, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    often = count >= LEAST_DOCUMENTS
    left = often[at]
    names, at, owner = names[often], (np.cumsum(often) - 1)[at[left]], owner[left]
    ends = np.searchsorted(owner, np.arange(1, len(rows)))
    at = [np.append(x, len(names)) for x in np.split(at, ends)] if rows else []  # the last coordinate is the bias
    z, n = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    l1 = np.full(len(names) + 1, L1)
    l1[-1] = 0.0

    def weights(i):
        return np.where(np.abs(z[i]) <= l1[i], 0.0, (np.sign(z[i]) * l1[i] - z[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for i, y in zip(at, labels):
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    w = weights(np.arange(len(names) + 1))
    left = np.flatnonzero(w[:-1])
    return names[left], w[left], float(w[-1])


def held_out(doc_id: Column) -> Column:
    """Documents that labels are never learnt from; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights from at most about ``SAMPLE_ROWS`` labelled documents that are not held out.

    The sample follows the hash of the id, so it does not depend on the order of rows. Null labels are left out; of
    several labels of a document the largest counts. Without labels every score is one half.
    """
    known = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    rate = min(1.0, SAMPLE_ROWS / max(1, known.count()))
    known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(rate * 1_000_000))
    # The labels of the sample are a bounded table, so the texts stay where they are.
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    sample = sample.select("doc_id", F.col("_toxic").cast("int").alias("y"), distinct_features(F.col("text")).alias("x"))

    def learn(given: pd.DataFrame) -> pd.DataFrame:
        given = given.assign(o=given.doc_id.map(lambda i: xxhash.xxh64_intdigest(str(i)))).sort_values(["o", "y"])
        names, w, bias = ftrl([np.asarray(x, np.int64) for x in given.x], given.y.to_numpy())
        return pd.DataFrame({"feature": np.append(names, 0), "w": np.append(w, bias), "bias": np.append(np.zeros(len(w), bool), True)})

    # One group, as large as the sample.
    table = sample.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(learn, "feature long, w double, bias boolean").toPandas()
    rest = table[~table.bias].sort_values("feature")
    bias = float(table.w[table.bias].iloc[0]) if len(table) else 0.0
    return rest.feature.to_numpy(np.int64), rest.w.to_numpy(np.float64), bias


def score(text: Column, model: tuple[np.ndarray, np.ndarray, float]) -> Column:
    """Probability of toxicity; a null or empty text has the model's bias alone."""
    names, weights, bias = model
    order = np.argsort(names.view(np.uint64))
    keys, weights = names.view(np.uint64)[order], weights[order]
    sieve = np.zeros(1 << 16, bool)
    sieve[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        out = np.empty(len(texts))
        for row, t in enumerate(texts):
            x = features(t.as_py())
            x = x[sieve[(x & np.uint64(0xFFFF)).astype(np.int64)]]
            total = bias
            if len(x):
                x = np.unique(x)
                spot = np.searchsorted(keys, x)
                spot[spot == len(keys)] = 0
                total += weights[spot[keys[spot] == x]].sum()
            out[row] = 1 / (1 + np.exp(-np.clip(total, -500, 500)))
        return pa.array(out)

    return scores(text)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; repeated rows score alike."""
    model = fit(docs, labels)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
