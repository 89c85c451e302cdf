"""Exact top-k inner products: norm-sorted blocks, rotated partial sums, Cauchy-Schwarz bounds.

The Gram matrix of all vectors gives the rotation (its eigenvectors, by descending energy), so that the first
coordinates of a rotated vector hold most of an inner product. Vectors are sorted by descending length into blocks.
Queries meet the longest blocks first, which gives each a k-th best score; a later block is visited only by the
queries whose length times the block's longest vector reaches that score, and in a block only those vectors are
multiplied out whose partial sum plus the product of the residual lengths reaches it. Scores are whole numbers and
are recomputed exactly for the survivors; bounds are widened by more than any rounding.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from barline.llm.common import stored

K, SCALE = 20, 64
#: Vectors of a block and queries of a block; coordinates of the first partial sum, as a share of all.
BLOCK, QUERIES, HEAD = 2048, 1024, 0.25
#: Share of the longest blocks that all queries meet in the first round, at least one block.
LONGEST = 0.02
#: Added to bounds, relative to the product of the lengths.
SLACK = 1e-9


def whole(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v, norm): components floored to multiples of 1/64 as whole numbers; odd vectors take no part."""
    x = F.col(vec_col)
    fit = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    v = F.transform(x, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")))
    rows = vectors.filter(fit).select(F.col(id_col).alias("vec_id"), v.alias("v"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c)))


def rotation(rows: DataFrame) -> np.ndarray:
    """Eigenvectors of the Gram matrix of all vectors, columns by descending energy; its size is the dimension's."""

    def grams(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                m = matrix(batch.column("v"))
                g = m.T @ m
                total = g if total is None else total + g
        if total is not None:
            n = len(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(n), n)), pa.array(np.tile(np.arange(n), n)), pa.array(total.ravel())], ["i", "j", "g"])

    parts = rows.select("v").mapInArrow(grams, "i long, j long, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).toPandas()
    if parts.empty:
        return np.zeros((0, 0))
    n = int(parts.i.max()) + 1
    gram = np.zeros((n, n))
    gram[parts.i, parts.j] = parts.g
    return np.linalg.eigh(gram)[1][:, ::-1]


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def best(pairs: DataFrame, rotate: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, score) of (q, c, q rows, c rows, floor): the best of each query in each block of candidates."""
    head = max(1, int(len(rotate) * HEAD))

    def scan(batches):
        for batch in batches:
            for pair in batch.to_pylist():
                qs, cs = pair["q_rows"], pair["c_rows"]
                q, c = (np.array([r["v"] for r in x], np.float64) for x in (qs, cs))
                qi, ci = (np.array([r["vec_id"] for r in x]) for x in (qs, cs))
                floor = np.array([r["floor"] for r in qs], np.float64)
                qr, cr = q @ rotate, c @ rotate
                q_rest, c_rest = (np.linalg.norm(x[:, head:], axis=1) for x in (qr, cr))
                q_all, c_all = (np.linalg.norm(x, axis=1) for x in (qr, cr))
                out = [], [], []
                for i in range(len(qi)):
                    near = np.flatnonzero(q_all[i] * c_all * (1 + SLACK) + 1e-3 >= floor[i])
                    bound = cr[near, :head] @ qr[i, :head] + q_rest[i] * c_rest[near] + SLACK * q_all[i] * c_all[near] + 1e-3
                    near = near[(bound >= floor[i]) & (ci[near] != qi[i])]
                    score = np.rint(c[near] @ q[i]).astype(np.int64)
                    top = np.lexsort((ci[near], -score))[:k]
                    out[0].append(np.full(len(top), qi[i]))
                    out[1].append(ci[near][top])
                    out[2].append(score[top])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["query_id", "vec_id", "score"])

    return pairs.mapInArrow(scan, "query_id long, vec_id long, score long")


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """The k best of each query, of at most k for each block it visited."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``queries`` (a condition on vec_id) names, the k best others.

    Ties go to the smaller vec_id. Vectors that are null, empty or hold null or non-finite components take no part,
    nor do null ids; rows of equal id are one query each and never their own candidates. All vectors are of one
    length.
    """
    rows = stored(whole(vectors, id_col, vec_col).filter("vec_id IS NOT NULL"), "vectors")
    count = rows.count()
    spark = vectors.sparkSession
    rotate = rotation(rows)
    blocks = max(1, -(-count // BLOCK))
    # Ranges of descending norm, found by Spark's own sampling sort; ties of norm go by id.
    placed = rows.repartitionByRange(blocks, F.desc("norm"), "vec_id").withColumn("c", F.spark_partition_id())
    longest = stored(placed, "blocks")
    reach = longest.groupBy("c").agg(F.max("norm").alias("reach"))
    asked = rows.filter(queries("vec_id")).withColumn("q", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-count // (QUERIES * 20))))))
    cut = max(1, int(blocks * LONGEST))
    members = longest.groupBy("c").agg(F.collect_list(F.struct("vec_id", "v")).alias("c_rows"))

    def visit(given: DataFrame, chosen) -> DataFrame:
        """Queries (with ``floor``) against the blocks that ``chosen`` lets each of them see."""
        seen = given.join(reach, chosen)
        groups = seen.groupBy("q", "c").agg(F.collect_list(F.struct("vec_id", "v", "floor")).alias("q_rows"))
        return best(groups.join(members, "c").select("q_rows", "c_rows"), rotate, k)

    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    first = stored(visit(asked.withColumn("floor", F.lit(float("-inf"))), F.col("c") < cut), "first")
    floors = ranked(first, k).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("floor")).distinct()
    later = asked.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    rest = visit(later, (F.col("c") >= cut) & (later["norm"] * F.col("reach") * (1 + SLACK) + 1e-3 >= F.col("floor")))
    return ranked(first.union(rest), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
