import pytest
from pyspark.sql import functions as F

from barline import udf


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    yield spark
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_series_longer_than_a_batch(small_batches):
    class Positions:
        """Gives out each row's position in its series and the size of the piece that brought it."""

        def start(self):
            return 0

        def step(self, n, rows):
            rows = rows[["k", "i"]].assign(at=range(n, n + len(rows)), piece=len(rows))
            return n + len(rows), rows

        def finish(self, key, n):
            return None

    spark = small_batches
    k = F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 < 9, F.concat(F.lit("k"), (F.col("id") % 37).cast("string")))
    d = spark.range(5000).select(k.alias("k"), (F.col("id") * 7919 % 5000).alias("i")).repartition(6)
    out = udf.fold_series(d, Positions(), ["k"], ["i"], "k string, i long, at long, piece long").collect()
    assert len(out) == 5000 and max(r.piece for r in out) <= 100
    series = {}
    for r in out:
        series.setdefault(r.k, []).append((r.i, r["at"]))
    for rows in series.values():  # the null key is one of them
        assert [at for _, at in sorted(rows)] == list(range(len(rows)))
    assert len(series[None]) == 500 and len(series["hot"]) == 3500


def test_reduce_guards_errors_and_empty_tables(small_batches):
    def step(total, rows):
        if (rows["k"] == "bad").any():
            raise KeyError("no")
        return total + rows["x"].sum()

    d = small_batches.range(900).select(F.when(F.col("id") % 3 == 0, "bad").otherwise("good").alias("k"), F.col("id").alias("x"))
    run = lambda df: udf.reduce_series(df, lambda: 0.0, step, lambda s: s, ["k"], ["x"], "total")
    out = {r.k: r for r in run(d).collect()}
    assert (out["good"].success, out["good"].data_size, out["good"].total) == (True, 600, float(sum(i for i in range(900) if i % 3)))
    assert (out["bad"].success, out["bad"].data_size, out["bad"].total) == (False, 300, None) and "KeyError" in out["bad"].error
    assert run(d.limit(0)).count() == 0
