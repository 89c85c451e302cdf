"""Mixing sources to target weights: exact quotas of blocks, split over output shards by a hypergeometric tree.

Documents get a random key from their id; the leading bits of the keys cut a source into blocks, and the order of the
keys is the permutation of blocks and of the documents in them. A source's quota is a number of words: whole passes
over all of its blocks, then the leading blocks of one more pass, the last of them in part. The blocks of all sources
are split over the shards by a binary tree: at each node half of the blocks go left, and how many of each source is
drawn from the multivariate hypergeometric distribution, one source after the other. So the shards' quotas add up to
the sources' quotas exactly, each shard draws its own stretch of every source's permuted blocks, and rows are
shuffled within their shard by another key.

Tables of sources, of blocks (one for some thousand documents) and of tree nodes are small. Sources and blocks are
written once, so that the planner sees their size and sends them to the documents, which stay where they are: only
those of the blocks in which a quota ends, one for a source at most, are brought together to be put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barline.llm.common import WORD, stored

#: Documents of a block, about; most copies of a document; weights of the sources in order, repeated.
BLOCK_DOCS, MOST, WEIGHTS = 4096, 3, (1, 2, 3)
KEY_BITS = 60


def random_key(*parts: Column) -> Column:
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, docs, source_size, target, quota) by source; ``target`` in words, ``quota`` the target rounded.

    All words are shared by weight; a source stops at three times its size and the rest is shared again. Sources fill
    up in the order of size by weight, so the level at which the others stop is found by running sums in that order.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("w", F.get(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(by_name) - 1) % len(WEIGHTS)).cast("long"))
    order = Window.orderBy((MOST * F.col("source_size") / F.col("w")), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    w = w.withColumns(
        {
            "left_words": F.sum("source_size").over(every) - F.coalesce(F.sum(MOST * F.col("source_size")).over(before), F.lit(0)),
            "left_w": F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)),
        }
    )
    open_ = MOST * F.col("source_size") * F.col("left_w") >= F.col("w") * F.col("left_words")
    level = F.max(F.when(open_, F.col("left_words") / F.col("left_w"))).over(every)
    w = w.withColumn("target", F.least((MOST * F.col("source_size")).cast("double"), F.col("w") * F.coalesce(level, F.lit(0.0))))
    return w.select("source", "docs", "source_size", "target", F.round("target").cast("long").alias("quota"))


def log_factorial(x: Column) -> Column:
    """Natural logarithm of x!, by the Stirling series from ten on."""
    import math

    z = x.cast("double") + 1
    far = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    near = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(10)])
    return F.when(x < 10, F.get(near, x.cast("int"))).otherwise(far)


def hypergeometric(total: Column, own: Column, draws: Column, u: Column) -> Column:
    """The number of ``own`` among ``draws`` out of ``total``, by inversion at ``u``, over twelve deviations each way."""
    t, q, n = (c.cast("double") for c in (total, own, draws))
    mean = n * q / F.greatest(t, F.lit(1.0))
    spread = 12 * F.sqrt(mean * (1 - q / F.greatest(t, F.lit(1.0)))) + 12
    low = F.greatest(F.lit(0).cast("long"), draws - (total - own), F.floor(mean - spread))
    high = F.least(own, draws, F.ceil(mean + spread))
    xs = F.sequence(low, F.greatest(low, high))
    logs = F.transform(xs, lambda x: -log_factorial(x) - log_factorial(own - x) - log_factorial(draws - x) - log_factorial(total - own - draws + x))
    weights = bind(logs, lambda v: bind(F.array_max(v), lambda top: F.transform(v, lambda a: F.exp(a - top))))

    def invert(ws: Column, goal: Column) -> Column:
        state = F.aggregate(
            ws,
            F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("n")),
            lambda s, a: F.struct((s["sum"] + a).alias("sum"), (s["n"] + F.when(s["sum"] + a < goal, 1).otherwise(0)).alias("n")),
        )
        return F.least(low + state["n"], F.greatest(low, high))

    return bind(weights, lambda ws: bind(u * F.aggregate(ws, F.lit(0.0), lambda acc, a: acc + a), lambda goal: invert(ws, goal)))


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shard_quotas(blocks: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source, bounds) of (source, draws): after how many of its draws each of ``shards`` shards ends.

    ``shards`` is a power of two. A level of the tree is one projection over the nodes, each with its list of quotas.
    """
    listed = blocks.agg(F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("no"), "source", "draws"))).alias("s"))
    node = listed.select(F.lit(1).cast("long").alias("node"), F.transform("s", lambda x: x["draws"]).alias("q"), F.col("s"))
    for _ in range(shards.bit_length() - 1):
        total = F.aggregate("q", F.lit(0).cast("long"), lambda acc, x: acc + x)
        state = F.struct(total.alias("rest"), F.floor(total / 2).alias("need"), F.array().cast("array<bigint>").alias("xs"))

        def draw(acc: Column, x: Column) -> Column:
            u = random_key(F.lit(seed), F.col("node"), F.size(acc["xs"])) / F.lit(float(1 << KEY_BITS))
            return bind(
                hypergeometric(acc["rest"], x, acc["need"], u),
                lambda k: F.struct((acc["rest"] - x).alias("rest"), (acc["need"] - k).alias("need"), F.concat(acc["xs"], F.array(k)).alias("xs")),
            )

        node = node.withColumn("left", F.aggregate("q", state, draw, lambda acc: acc["xs"]))
        right = F.zip_with("q", "left", lambda a, b: a - b)
        halves = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("q")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("q")))
        node = node.select("s", F.explode(halves).alias("h")).select("h.node", "h.q", "s")
    leaves = node.select("node", F.posexplode(F.arrays_zip("q", "s")).alias("i", "x")).select(
        (F.col("node") - shards).alias("shard"), F.col("x.s.source").alias("source"), F.col("x.q").alias("n")
    )
    ends = leaves.withColumn("end", F.sum("n").over(Window.partitionBy("source").orderBy("shard")))
    return ends.groupBy("source").agg(F.array_sort(F.collect_list("end")).alias("bounds"))


def mixed(docs: DataFrame, shards: int = 8, seed: int = 0, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all) of ``docs`` with the struct ``_mix``: size, source_size, target, and ``draws``, a list of (shard, order, words).

    Each entry of ``draws`` is one copy that the mix takes; sort a shard's rows by ``order`` to write it. Only the last
    document of a source's quota is taken in part: its first ``words`` words. A null text has size 0 and is never
    taken; a null source is a source of its own, the last. Rows with equal ids are ordered by size; equal rows are
    interchangeable. No documents: no rows.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != "_mix"]  # a column of that name is replaced
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    key = random_key(F.col("doc_id"))
    sizes = stored(docs.select("source", size.alias("_size"), key.alias("_key")), "mix-sizes")
    sources = targets(sizes.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("_size").alias("source_size")))
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("docs") / BLOCK_DOCS))).cast("int")
    sources = sources.withColumns(
        {
            "bits": bits,
            "passes": F.when(F.col("source_size") > 0, F.floor(F.col("quota") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"),
        }
    ).withColumn("part", F.col("quota") - F.col("passes") * F.col("source_size"))
    sources = stored(sources.withColumnRenamed("source", "_source"), "mix-sources")
    same = F.col("source").eqNullSafe(F.col("_source"))

    def in_blocks(some: DataFrame) -> DataFrame:
        return some.join(sources, same).drop("_source").withColumn("_block", F.expr(f"shiftright(_key, {KEY_BITS} - bits)"))

    # Blocks of each source: words before each, and how many the quota draws.
    sums = in_blocks(sizes).groupBy("source", "_block").agg(F.sum("_size").alias("words"), F.first("passes").alias("passes"), F.first("part").alias("part"))
    run = Window.partitionBy("source").orderBy("_block")
    sums = sums.withColumns(
        {"before": F.sum("words").over(run) - F.col("words"), "place": (F.row_number().over(run) - 1).cast("long"), "blocks": F.count(F.lit(1)).over(Window.partitionBy("source"))}
    )
    drawn = sums.groupBy("source").agg(F.sum(F.col("passes") + (F.col("before") < F.col("part")).cast("long")).alias("draws"))
    bounds = shard_quotas(drawn, shards, seed).withColumnRenamed("source", "_source")
    sums = sums.join(bounds, same).select(F.col("source").alias("_s"), F.col("_block").alias("_b"), "words", "before", "place", "blocks", "bounds")
    sums = stored(sums, "mix-blocks")
    rows = in_blocks(docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_doc"), "doc_id", "source", "text", key.alias("_key")))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b"))).drop("_s", "_b")
    # The last pass takes a block whole or not at all, but for the one in which the quota ends.
    ends = (F.col("before") < F.col("part")) & (F.col("part") < F.col("before") + F.col("words"))
    whole = rows.filter(~ends).withColumn("_size", size).drop("text")
    whole = whole.withColumn("_extra", F.when(F.col("before") < F.col("part"), F.col("_size")).otherwise(F.lit(0).cast("long")))
    inside = Window.partitionBy("source", "_block").orderBy("_key", "doc_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.col("before") + F.coalesce(F.sum("_size").over(inside), F.lit(0))
    last = rows.filter(ends).withColumn("_size", size).drop("text").withColumn("_before", taken)
    last = last.withColumn("_extra", F.greatest(F.lit(0).cast("long"), F.least(F.col("_size"), F.col("part") - F.col("_before"))))
    rows = whole.unionByName(last.drop("_before"))

    def copy(epoch: Column) -> Column:
        place = epoch * F.col("blocks") + F.col("place")
        return F.struct(
            F.size(F.filter("bounds", lambda b: b <= place)).alias("shard"),
            random_key(F.lit(seed), F.lit("order"), F.col("doc_id"), epoch).alias("order"),
            F.when(epoch < F.col("passes"), F.col("_size")).otherwise(F.col("_extra")).alias("words"),
        )

    draws = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), F.col("passes")), copy), lambda d: d["words"] > 0)
    made = F.struct(F.col("_size").alias("size"), "source_size", "target", draws.alias("draws"))
    return rows.select("_doc.*", made.alias("_mix"))


def written(mix: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each copy that the mix takes, with the given columns of the documents and ``shard``, ``order``."""
    rows = mix.select(*columns, F.col("_mix.size").alias("_size"), F.explode("_mix.draws").alias("_draw"))
    words = F.slice(F.regexp_extract_all("text", F.lit(WORD), 0), F.lit(1), F.col("_draw.words").cast("int"))
    text = F.when(F.col("_draw.words") < F.col("_size"), F.array_join(words, " ")).otherwise(F.col("text"))
    return rows.withColumn("text", text).select(*columns, F.col("_draw.shard").alias("_shard"), F.col("_draw.order").alias("_order"))


#: The same mix without shards: a running sum over the permuted documents of each source.
TAKEN_SQL = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15) AS k FROM {docs}),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0))::BIGINT AS left_words,
    (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::BIGINT AS left_w FROM w
  WINDOW b AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, w * coalesce(max(CASE WHEN 3 * source_size * left_w >= w * left_words
    THEN left_words::DOUBLE / left_w END) OVER (), 0.0)) AS target FROM l),
q AS (SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS passes FROM t),
r AS (SELECT d.*, q.source_size, q.target, q.passes, round(q.target)::BIGINT - q.passes * q.source_size AS part,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, (passes * size + greatest(0, least(size, part - before)))::BIGINT AS taken FROM r
"""
