"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue: its documents in shuffled order, then once more in
another order, up to ``epochs`` times. A copy of a document gets a virtual
finish time, the source's words up to and with it over the source's target.
All copies are sorted by that time and taken until the budget is full, so the
sources advance side by side and each stops near its target.

Targets share the budget by weight. A source can give ``epochs`` times its
size at most; what its weight would give it beyond that is shared again among
the others by weight, until none is above. A round of this is one sum over the
table of sources.

Only (source, size, id) rows move, never texts. Both running sums are range
scans, so neither a source with most documents nor the global order meets in
one task; sources are counted and ranked by a scan as well.

Defined results: a null text has size 0; a null source is a source, the last;
documents without words take nothing, and a table without words has targets of
0; rows with one doc_id are documents of their own, equal rows are
interchangeable; a null doc_id is kept. Other columns are not read.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.draws import hash_number
from ..plans.ordered import scan
from ..session import durable

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sources: DataFrame, share, epochs: int) -> tuple[DataFrame, int]:
    """Adds target to (source, source_size, weight) rows; also the budget in words.

    Weights are whole numbers. The level, words per unit of weight, is
    (share * all - capped sizes * epochs) / weight left; it only rises, and the
    rounds end when no more source is capped by it.
    """
    part = Fraction(str(share))
    big = lambda c: F.col(c).cast("decimal(38,0)")
    total, left = sources.agg(F.sum(big("source_size")), F.sum(big("weight"))).first()
    total, weights = int(total or 0), int(left or 0)
    budget = min(part * total, Fraction(epochs * total))
    up, down, capped = budget.numerator, budget.denominator * max(weights, 1), None
    while True:
        # cap <= weight * up / down, without rounding
        full = big("source_size") * F.lit(epochs * down).cast("decimal(38,0)") <= big("weight") * F.lit(up).cast("decimal(38,0)")
        size, w = sources.filter(full).agg(F.sum(big("source_size")), F.sum(big("weight"))).first()
        now = int(size or 0), int(w or 0)
        if now == capped or now[1] >= weights:
            break
        capped = now
        level = (budget - epochs * now[0]) / (weights - now[1])
        up, down = level.numerator, level.denominator
    target = F.when(full, (F.col("source_size") * epochs).cast("double")).otherwise(F.col("weight").cast("double") * float(up) / float(down))
    return sources.withColumn("target", target), int(budget)


def mix(docs: DataFrame, weights=(3, 1, 2), share=1.5, epochs=2, seed=11, text="text") -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per document.

    ``weights`` repeat over the sources in code point order, null last.
    ``share`` is the budget as a part of all words. ``taken`` counts words,
    those of whole copies and of the one copy that the end of the budget cuts.
    """
    sized = durable(docs.select(
        "doc_id", F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size")))
    sized = sized.withColumn("_row", F.monotonically_increasing_id())  # of the files just written
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumns({"_last": F.col("source").isNull(), "_one": F.lit(1)})
    at = F.pmod(F.col("_rank"), F.lit(len(weights))).cast("int")
    ranked = durable(scan(per, [], ["_last", "source"], {"_one": "_rank"}).withColumn("weight", F.array(*[F.lit(int(w)) for w in weights])[at]))
    sources, budget = source_targets(ranked.select("source", "source_size", "weight", "_rank"), share, epochs)
    named = sources.select(F.col("source").alias("_source"), "source_size", "target", "_rank")
    rows = sized.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("source", "_source")
    copies = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(epochs)))).withColumn("_shuffle", hash_number("doc_id", "_copy", seed))
    queued = scan(copies, ["_rank"], ["_copy", "_shuffle", "doc_id", "size", "_row"], ends={"size": "_words"})
    timed = queued.withColumn("_finish", F.col("_words") / F.nullif(F.col("target"), F.lit(0.0)))
    lined = scan(timed, [], ["_finish", "_rank", "_copy", "_shuffle", "doc_id", "size", "_row"], {"size": "_before"})
    took = F.greatest(F.lit(0), F.least(F.col("size"), F.lit(budget) - F.col("_before")))
    return lined.groupBy("_row", "doc_id", "size", "source_size", "target").agg(F.sum(took).alias("taken")).drop("_row")


def mixed_texts(docs: DataFrame, mixed: DataFrame, text="text") -> DataFrame:
    """The mix itself: the columns of ``docs`` once per copy that was taken, and
    ``copy_no`` (which replaces a column of that name). The text of the copy that
    the budget cuts ends after its last taken word. ``doc_id`` must name each
    document once."""
    copies = mixed.filter("taken > 0").select(
        F.col("doc_id").alias("_mix_id"), F.col("size").alias("_mix_size"), F.col("taken").alias("_mix_taken"),
        F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))).alias("_mix_copy"))
    rows = docs.join(copies, docs["doc_id"] == copies["_mix_id"])
    words = copies["_mix_taken"] - (copies["_mix_copy"] - 1) * copies["_mix_size"]
    pieces = F.regexp_extract_all(docs[text], F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    cut = F.when(words >= copies["_mix_size"], docs[text]).otherwise(F.array_join(F.slice(pieces, F.lit(1), words.cast("int")), ""))
    return rows.select(*[cut.alias(c) if c == text else docs[c] for c in docs.columns if c != "copy_no"], copies["_mix_copy"].alias("copy_no"))
