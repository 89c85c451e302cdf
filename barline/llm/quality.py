"""Quality rules: base counts, and a hashed n-gram likelihood ratio between trusted and raw text.

Words and pairs of neighbouring words are hashed into the buckets of two tables of fixed width, one for each. Two
multinomials over the buckets are counted from every n-gram of the corpus, one over the documents marked as trusted and
one over all; a document's score is the mean log ratio of its n-grams, and every document at or above the threshold
passes. Counts are combined before they are dealt, and the ratios of all buckets are one row of 16 MB, whatever the
input, in which each text looks its n-grams up: no row per n-gram ever leaves a task. All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barline.llm.common import WHITE, stored

#: Buckets of the words, and as many of the pairs; and the buckets that are gathered into one row at a time.
BUCKETS, BLOCK = 1 << 20, 1 << 12
#: Most trusted ids that are sent to all tasks; more are joined by id.
SENT_IDS = 2_000_000
#: Ratios are summed as whole multiples of one part in so many: exact in any order of rows.
PARTS = 1 << 32
#: Added to each bucket's raw count, and in proportion of their sizes to its trusted count: rare n-grams weigh little.
SMOOTHING = 30.0
#: Mean log ratio below which a document is rejected. Text like the trusted text lies near zero.
THRESHOLD = -0.15
#: Words of a window that must not repeat, least words of a document, largest share of repeated words in percent.
REPEAT_WORDS, LEAST_WORDS, MOST_REPEATED = 5, 10, 20

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def word_list(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE + "+"))


def with_words(docs: DataFrame) -> DataFrame:
    """Adds ``_t``, the text without null, ``_w``, its words, and in order ``_h``, their hashes, and ``_p``, those of pairs."""
    docs = docs.withColumn("_t", F.coalesce("text", F.lit("")))
    docs = docs.withColumn("_w", word_list(F.col("_t")))
    return docs.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w))).withColumn("_p", pairs("_h"))


def pairs(h: str) -> Column:
    """Hashes of each word with the next; the last word is paired with the end, a null, which a hash passes over."""
    return F.zip_with(h, F.slice(h, F.lit(2), F.size(h)), lambda x, y: F.xxhash64(F.lit(2), x, y))


def bucket(x: Column) -> Column:
    return x.bitwiseAND(F.lit(BUCKETS - 1).cast("long"))


def buckets(h: str, p: str) -> Column:
    """The buckets of the words, then of the pairs."""
    return F.concat(F.transform(h, bucket), F.transform(p, lambda x: bucket(x) + F.lit(BUCKETS).cast("long")))


def repeated_words(p: str, n: str) -> Column:
    """A hash for each window of five words, from its pairs: of two pairs for four words, of two such for five."""
    size = F.greatest(F.col(n) - (REPEAT_WORDS - 2), F.lit(0)).cast("int")
    fours = F.zip_with(F.slice(p, F.lit(1), size), F.slice(p, F.lit(3), size), lambda x, y: F.xxhash64(x, y))
    less = F.greatest(size - 1, F.lit(0))

    def fives(f: Column) -> Column:
        return F.zip_with(F.slice(f, F.lit(1), less), F.slice(f, F.lit(2), less), lambda x, y: F.xxhash64(x, y))

    return F.get(F.transform(F.array(fours), fives), F.lit(0))


def covered_words(grams: str) -> Column:
    k = REPEAT_WORDS
    ordered = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

    def with_ordered(s: Column) -> Column:
        return F.filter(s, lambda p, j: F.get(s, j - 1)["g"].eqNullSafe(p["g"]) | F.get(s, j + 1)["g"].eqNullSafe(p["g"]))

    # let-bindings: a one-element array carries the sorted list and the positions into the next step.
    at = F.get(F.transform(F.array(ordered), lambda s: F.array_sort(F.transform(with_ordered(s), lambda p: p["i"]))), F.lit(0))
    widths = F.get(F.transform(F.array(at), lambda a: F.transform(a, lambda p, j: F.least(F.lit(k), F.coalesce(F.get(a, j + 1) - p, F.lit(k))))), F.lit(0))
    return F.aggregate(widths, F.lit(0).cast("long"), lambda acc, x: acc + x)


def base_counts(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed as ``_``-prefixed columns."""
    t = F.col("_t")
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    docs = docs.withColumns(
        {
            "_n": F.size("_h").cast("long"),
            "_word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "_n_symbols": F.length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")).cast("long"),
            "_lines": lines,
        }
    ).drop("_w")
    docs = docs.withColumn("_n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")
    docs = docs.withColumn("_grams", repeated_words("_p", "_n"))
    twice = F.size(F.array_distinct("_grams")) < F.size("_grams")
    docs = docs.withColumn("_n_repeat_words", F.when(twice, covered_words("_grams")).otherwise(F.lit(0).cast("long"))).drop("_grams")
    failed = (F.col("_n") < LEAST_WORDS) | (100 * F.col("_n_repeat_words") > MOST_REPEATED * F.col("_n"))
    return docs.withColumn("_base_failed", failed)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of the documents that a label marks with a quality of 1, each once."""
    ids = labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    few = ids.limit(SENT_IDS + 1).count() <= SENT_IDS
    return F.broadcast(ids) if few else ids


def ratios(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row with ``llr``, the log ratio of every bucket: trusted against all documents, both smoothed, in ``PARTS``.

    Labels with a quality of 1 mark trusted documents; a document that is labelled twice is trusted if one label says so.
    Without any trusted text all ratios are zero and the base counts alone decide.
    """
    trusted = trusted_ids(labels).withColumn("_trusted", F.lit(1).cast("long"))
    marked = docs.select("doc_id", "text").join(trusted, "doc_id", "left")
    # Hashes become buckets only as rows, where the code is compiled: a lambda is interpreted for each word.
    hashes = with_words(marked).select(
        F.coalesce("_trusted", F.lit(0).cast("long")).alias("_in"), F.size("_h").alias("_n"), F.posexplode(F.concat("_h", "_p")).alias("_i", "_x"))
    shift = F.when(F.col("_i") < F.col("_n"), 0).otherwise(BUCKETS).cast("long")
    grams = hashes.select("_in", (bucket(F.col("_x")) + shift).alias("bucket"))
    counts = stored(grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("_in").alias("own")), "quality-buckets")
    own, raw = counts.agg(F.coalesce(F.sum("own"), F.lit(0)), F.coalesce(F.sum("raw"), F.lit(0))).first()
    share = own / raw if own else 1.0
    ratio = F.log((F.col("own") + SMOOTHING * share) / (share * (F.col("raw") + SMOOTHING)))
    llr = F.round(ratio * PARTS).cast("long") if own else F.lit(0).cast("long")
    every = docs.sparkSession.range(2 * BUCKETS).withColumnRenamed("id", "bucket").join(counts, "bucket", "left").na.fill(0)

    def ordered(key: str, value: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value])

    blocks = every.select("bucket", (F.col("bucket") / BLOCK).cast("long").alias("block"), llr.alias("llr"))
    blocks = blocks.groupBy("block").agg(ordered("bucket", "llr").alias("part"))
    return blocks.agg(F.flatten(ordered("block", "part")).alias("llr"))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with the struct ``_quality``: n_words, the base counts, base_failed, score, kept.

    A null text is an empty one, has no words and fails; its score is null. Every row is judged by its own text, so
    repeated rows get equal verdicts. Labels of unknown documents and null ids have no effect. A column ``_quality`` of
    ``docs`` is replaced.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "_quality"])
    rows = base_counts(with_words(docs.select(row.alias("_doc"), "text"))).withColumn("_b", buckets("_h", "_p"))
    # Buckets and table are used once, so that both become part of the score: as columns they would be copied for each row.
    rows = rows.withColumn("_llr", ratios(docs, labels).scalar())
    total = F.aggregate("_b", F.lit(0).cast("long"), lambda acc, b: acc + F.get("_llr", b.cast("int")))
    rows = rows.withColumn("_score", F.when(F.col("_n") > 0, total / (2 * F.col("_n")) / PARTS))
    kept = ~F.col("_base_failed") & F.coalesce(F.col("_score") >= THRESHOLD, F.lit(False))
    fields = {"_n": "n_words"} | {f"_{c}": c for c in ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score")}
    made = F.struct(*[F.col(a).alias(b) for a, b in fields.items()], kept.alias("kept"))
    # A generator, so that a later filter on the verdict is not pushed below and spelled out once for each word.
    return rows.select("_doc", F.explode(F.array(made)).alias("_quality")).select("_doc.*", "_quality")
