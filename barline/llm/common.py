"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: A word is a maximal run of characters other than these six.
WHITE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one step inside a task: bounds the memory of a worker whatever the batch size of the session is.
STEP_ROWS = 256
#: Entries of a worker's word cache before it starts anew.
CACHE_WORDS = 200_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; ``bytes.split`` cuts at exactly the characters of ``WHITE``."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


class WordHashes(dict):
    """XXH64 of a word, remembered for the words of a worker."""

    def __init__(self, seed: int = 0):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word, self.seed)
        if len(word) <= 64:
            self[word] = value
        return value

    def of(self, text_words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, text_words), np.uint64, len(text_words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def rolling(values: np.ndarray, n: int, base: int) -> np.ndarray:
    """Polynomial fingerprints, modulo 2^64, of every run of ``n`` values."""
    m = len(values) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    # By doubling: the fingerprint of 2k values is that of the first k times base^k plus that of the next k.
    done, out, rest = 0, np.zeros(len(values), np.uint64), n
    power, block, width = base, values.astype(np.uint64), 1
    while rest:
        if rest & 1:
            keep = len(values) - done - width + 1
            out = out[:keep] * np.uint64(power) + block[done : done + keep]
            done += width
        rest >>= 1
        if rest:
            block = block[: len(block) - width] * np.uint64(power) + block[width:]
            power, width = power * power % 2**64, width * 2
    return out[:m]


def map_rows(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list] | pa.RecordBatch], schema: T.StructType | str) -> DataFrame:
    """Apply ``fn`` to column lists of at most ``STEP_ROWS`` rows; a batch never leaves its task."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, STEP_ROWS):
                out = fn(batch.slice(at, STEP_ROWS).to_pydict())
                if not isinstance(out, pa.RecordBatch):
                    out = pa.RecordBatch.from_arrays(
                        [pa.array(out[f.name], f.type) for f in arrow], schema=arrow
                    )
                if out.num_rows:
                    yield out

    return df.mapInArrow(run, kind)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """The smallest node of every node's component: (node, root), for nodes that have an edge.

    Each round every node hangs on the smallest root among its neighbours' roots (hook), then on its root's root
    (jump). Rounds are joins on node keys and are checkpointed to the shared folder; they end when nothing moves.
    """
    spark = edges.sparkSession
    both = stored(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(F.col(b), F.col(a))).distinct(), "edges")
    label = stored(both.groupBy(F.col("x").alias("node")).agg(F.least(F.col("node"), F.min("y")).alias("root")), "label")
    for _ in range(rounds):
        near = both.join(label.withColumnsRenamed({"node": "y"}), "y").groupBy(F.col("x").alias("node")).agg(F.min("root").alias("near"))
        # A root learns what its members have seen, so that chains shorten by more than one step a round.
        seen = label.join(near, "node").select("node", "root", F.least("root", "near").alias("low"))
        hooks = seen.groupBy(F.col("root").alias("r")).agg(F.min("low").alias("hook"))
        nxt = seen.join(hooks, F.col("root") == F.col("r")).select("node", F.least("low", "hook").alias("mid"), F.col("root").alias("was"))
        up = nxt.select(F.col("node").alias("m"), F.col("mid").alias("top"))
        nxt = nxt.join(up, F.col("mid") == F.col("m"), "left").select("node", F.least("mid", "top").alias("root"), "was")
        nxt = stored(nxt, "label")
        moved = nxt.filter("root < was").limit(1).count()
        label = nxt.select("node", "root")
        if not moved:
            return label
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage with files that outlive any executor."""
    from barline.session import durable

    return durable(df, name)
