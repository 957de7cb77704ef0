"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

An item's windows are its runs of 13 words (a shorter item is one window). The
tokens of a window are its word shingles, ordered by how rare they are in the
whole corpus. A window inside a document holds all its shingles, so its rarest
one is a necessary prefix: only that token is joined. A match fixes where the
window would begin; length and position must fit the document, and the words
are compared one by one, so every reported window is exact.

The corpus is read twice: once to count the benchmark's shingles, once to join.
Words are never shuffled while the benchmark side is under ``broadcast_rows``
(counted first); beyond that the same joins run as shuffled joins.

Defined cases: null or empty text has no words, n_hit 0, not contaminated.
An item without words has no window; an item with null id marks words but is
not listed. Repeated documents come back as often as they came in; an item
repeated counts once. Other columns of the tables are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .text import neutral

WINDOW = 13
SHINGLE = 3
#: what separates words before A-Z are lowered
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of a text with A-Z lowered, other letters kept; null gives none."""
    plain = F.length(text) == F.octet_length(text)
    small = F.transform(F.split(text, BREAKS), lambda w: F.when(F.length(w) == F.octet_length(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER)))
    return F.coalesce(F.array_remove(F.when(plain, F.split(F.lower(text), BREAKS)).otherwise(small), ""), F.array().cast("array<string>"))


def token(words: Column, at: Column, width: int) -> Column:
    """Hash of the shingle of ``width`` words at a 0-based position."""
    return F.xxhash64(F.lit(width), *[F.get(words, at + k) for k in range(width)])


def item_windows(items: DataFrame, window=WINDOW) -> DataFrame:
    """window_id, size, words, items, width: every distinct window of the items once."""
    w = items.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    start = F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1))))
    w = w.select("item", "words", start.alias("start")).select("item", F.slice("words", F.col("start"), window).alias("words"))
    w = w.groupBy("words").agg(F.collect_set("item").alias("items"))
    return w.select(F.sha2(F.array_join("words", " "), 256).alias("window_id"), F.size("words").alias("size"), "words", "items",
                    F.least(F.size("words"), F.lit(SHINGLE)).alias("width"))


def exploded(docs: DataFrame) -> DataFrame:
    """One row per word, and one at the end of each document (at = n_words)."""
    w = docs.select("doc_id", F.xxhash64("text").alias("print"), words_of(F.col("text")).alias("words"))
    return w.select("doc_id", "print", "words", F.size("words").alias("n_words"), F.posexplode(F.array_append("words", "")).alias("at", "word"))


def tokens_at(words: DataFrame, widths) -> DataFrame:
    """The tokens that start at each word, one row per width in use."""
    keys = [token(F.col("words"), F.col("at"), n) for n in widths]
    if len(keys) == 1:
        return words.withColumn("token", keys[0])
    return words.withColumn("token", F.explode(F.array(*keys)))


def contamination(docs: DataFrame, items: DataFrame, window=WINDOW, broadcast_rows=500_000) -> DataFrame:
    """doc_id, print (xxhash64 of the text), n_words, n_hit, spans (start, size of hit windows), items; one row per document row."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    windows = durable(item_windows(items, window))
    widths = sorted(r["width"] for r in windows.select("width").distinct().collect()) or [SHINGLE]  # 1, 2, 3 at most
    offset = F.explode(F.sequence(F.lit(0), F.col("size") - F.col("width")))
    cases = F.coalesce(*[F.when(F.col("width") == n, token(F.col("words"), F.col("offset"), n)) for n in widths])
    shingles = windows.withColumn("offset", offset).withColumn("token", cases)
    small = windows.count() * window <= broadcast_rows
    side = F.broadcast if small else (lambda df: df)

    wanted = shingles.select("token").distinct()
    counts = tokens_at(exploded(docs), widths).select("token").join(side(wanted), "token").groupBy("token").agg(F.count("*").alias("df"))
    rarest = shingles.join(counts, "token", "left").groupBy("window_id").agg(
        F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token", "offset")).alias("r"))
    # a window with a shingle that no document has cannot occur
    prefix = windows.join(rarest.filter("r.df > 0"), "window_id").select(
        F.col("r.token").alias("token"), F.col("r.offset").alias("offset"), "size", F.col("words").alias("want"), "items")
    end = spark.range(1).select(F.lit(None).cast("long").alias("token"), F.lit(0).alias("offset"), F.lit(0).alias("size"),
                                F.array().cast("array<string>").alias("want"), F.array().cast("array<string>").alias("items"))
    prefix = durable(prefix.unionByName(end).withColumn("key", F.coalesce("token", F.lit(0))).withColumn("ends", F.col("token").isNull()).drop("token"))

    # the row at a document's end meets the one row without a token, so that every document comes out
    found = tokens_at(exploded(docs), widths).withColumn("last", F.col("at") == F.col("n_words"))
    if len(widths) > 1:
        found = found.filter(~F.col("last") | (F.col("token") == token(F.col("words"), F.col("at"), widths[0])))
    found = found.withColumn("key", F.when(F.col("last"), F.lit(0)).otherwise(F.col("token")))
    found = found.join(side(prefix), "key").filter(F.col("last") == F.col("ends"))
    start = F.col("at") - F.col("offset")
    fits = F.col("last") | ((start >= 0) & (start + F.col("size") <= F.col("n_words"))
                            & (F.slice(F.col("words"), F.greatest(start, F.lit(0)) + 1, F.col("size")) == F.col("want")))
    hits = found.filter(fits).select("doc_id", "print", "n_words", start.alias("start"), "size", "items", "last")
    hits = hits.groupBy("doc_id", "print", "n_words").agg(
        F.collect_set(F.when(~F.col("last"), F.struct("start", "size"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"), F.sum(F.col("last").cast("int")).alias("times"))
    covered = F.aggregate(F.array_sort("spans"), F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum")),
                          lambda s, x: F.struct(F.greatest(s["end"], x["start"] + x["size"]).alias("end"),
                                                (s["sum"] + F.greatest(F.lit(0), x["start"] + x["size"] - F.greatest(s["end"], x["start"]))).alias("sum")),
                          lambda s: s["sum"])
    out = hits.withColumn("n_hit", covered).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return out.select("doc_id", "print", F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"), "spans", F.array_sort("items").alias("items"))


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """A twentieth of the words or more."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def clean(docs: DataFrame, items: DataFrame, window=WINDOW) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    found = contamination(docs, items, window).filter(is_contaminated(F.col("n_hit"), F.col("n_words")))
    bad = found.select(F.col("doc_id").alias("_id"), F.col("print").alias("_print")).distinct()
    kept = neutral(docs).join(bad, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_print")), "left_anti")
    return kept.toDF(*docs.columns)
