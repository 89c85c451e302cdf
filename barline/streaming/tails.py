"""STR-05, STR-06, STR-10: what a key's next rows need of its earlier ones, as a stored table.

After each trigger the newest rows of every key are written with the key's running count and total (``seen``,
``total``). The next trigger joins them, numbers its own rows from there and runs ordinary ordered windows
(``operators.ordered``), so a hot key is cut into chunks and no task holds a key's rows. Each trigger owns one folder of
output and one of state and reads the state of the trigger before, so a replayed trigger writes the same rows again.

Rows of one trigger follow (ts, event_id); rows of a later trigger follow those of an earlier one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, types as T

from barline.operators.ordered import Running, Series, chunk_series, chunked, owned, running
from barline.session import durable, scratch_path

ARRIVAL = Series(("symbol",), ("ts", "event_id"))


@dataclass(frozen=True)
class Tail:
    """keep: rows of each key that stay stored; look_back: earlier rows a window reads; build: the output of numbered rows."""

    keep: int
    look_back: int
    build: Callable[[DataFrame, Series], DataFrame]
    columns: list[str]
    accept: str = "true"


def _numbered(batch: DataFrame, tail: DataFrame) -> DataFrame:
    """The batch with the running count and total of each key, going on from the stored ones."""
    before = tail.groupBy("symbol").agg(F.max("seen").alias("_seen"), F.max_by("total", "seen").alias("_total"))
    counts = {"seen": Running("sum", F.lit(1)), "total": Running("sum", F.col("price"))}
    rows = running(batch, counts, ARRIVAL).join(before, "symbol", "left")
    return rows.withColumns({
        "seen": (F.col("seen") + F.coalesce("_seen", F.lit(0))).cast("long"),
        "total": F.coalesce("total", F.lit(0.0)) + F.coalesce("_total", F.lit(0.0)),
    }).drop("_seen", "_total")


def _newest(rows: DataFrame, keep: int) -> DataFrame:
    last = rows.groupBy("symbol").agg(F.max("seen").alias("_last"))
    return rows.join(last, "symbol").filter(F.col("seen") > F.col("_last") - keep).drop("_last")


def advance(batch: DataFrame, tail: DataFrame, spec: Tail) -> tuple[DataFrame, DataFrame]:
    """One trigger: (its rows, the stored rows) -> (output, rows to store)."""
    rows = durable(_numbered(batch.filter(spec.accept), tail).select(*tail.columns), "arrived")
    both = rows.withColumn("_new", F.lit(True)).unionByName(tail.withColumn("_new", F.lit(False)))
    reach = both.filter("_new").unionByName(_newest(both.filter("NOT _new"), spec.look_back)) if spec.look_back else both.filter("_new")
    split = chunked(reach.withColumn("_pos", F.col("seen") - 1), halo=spec.look_back)
    out = owned(spec.build(split, chunk_series()).filter("_new")).select(*spec.columns)
    return out, _newest(both.drop("_new"), spec.keep)


def run_tails(stream: DataFrame, name: str, spec: Tail, out: str | None = None) -> DataFrame:
    """Drain a stream of (symbol, ts, event_id, price, ...) through ``spec`` and read its output back.

    ``out`` holds output, state and checkpoint; a second run with the same folder goes on where the first ended.
    """
    spark = stream.sparkSession
    out = out or scratch_path(spark, name)
    stored = T.StructType([*stream.schema.fields, T.StructField("seen", T.LongType()), T.StructField("total", T.DoubleType())])

    def handle(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        if batch_id == 0:
            tail = session.createDataFrame([], stored)
        else:
            tail = session.read.schema(stored).parquet(f"{out}/state/{batch_id - 1}")
        rows, kept = advance(batch, tail, spec)
        rows.write.mode("overwrite").parquet(f"{out}/data/batch={batch_id}")
        kept.write.mode("overwrite").parquet(f"{out}/state/{batch_id}")

    query = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{out}/data").drop("batch")


def rolling_buffer(size: int = 7) -> Tail:
    """STR-05: the last ``size`` values of each key with every arriving row, once there are that many."""

    def build(d: DataFrame, s: Series) -> DataFrame:
        values = F.collect_list(F.struct("price")).over(s.last(size))
        return d.withColumn("buffer", F.transform(values, lambda r: r["price"])).filter(F.col("seen") >= size)

    return Tail(size - 1, size - 1, build, ["symbol", "event_id", "buffer"])


def experience_buffer(capacity: int = 10_000, every: int = 100) -> Tail:
    """STR-06: the newest ``capacity`` rows stay stored; each ``every`` rows emit count, size, recent mean and total so far."""
    recent = min(capacity, every)

    def build(d: DataFrame, s: Series) -> DataFrame:
        mean = F.sum("price").over(s.last(recent)) / every
        held = F.least(F.col("seen"), F.lit(capacity).cast("long"))
        return d.withColumns({"recent_mean": mean, "held": held}).filter(F.col("seen") % every == 0)

    return Tail(capacity, recent - 1, build, ["symbol", "seen", "held", "recent_mean", "total"])


def hold_rows(columns: list[str], every: int = 12) -> Tail:
    """STR-10: every ``every``-th HOLD row of a symbol, counted across triggers."""
    return Tail(1, 0, lambda d, s: d.filter(F.col("seen") % every == 0), columns, "action = 'HOLD'")
