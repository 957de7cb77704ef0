"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

Per document: counts of words, symbols, repeated lines and words inside
repeated 3-word windows. On these stand ratio rules ("reject above a cutoff").
A cutoff is not set by hand: for every stratum, rule and candidate cutoff the
labelled good documents that it would reject are counted, and the cutoff is
admitted only if an exact binomial test says that its false-rejection rate is
at most ``alpha / rules`` at level ``delta / (strata * rules)``. The cutoffs of
a rule are nested, so they are tested in a fixed order, loosest first, and the
first that fails ends the row: no correction is due inside a row, a Bonferroni
one between strata and rules is. The last admitted cutoff is used. As a lower
cutoff rejects no less, p-values rise along the row and that is the lowest one
under the level. So with confidence 1 - delta no stratum loses more than
``alpha`` of its good documents by the rules; a stratum with too few labels
gets no cutoff and loses nothing.

Defined cases: null or empty text has no words and fails the base rules. Null
stratum is a stratum of its own. A document labelled twice is good only if
all its labels are; labels of unknown documents are ignored. Each input row
gives one output row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: candidate cutoffs, in thousandths; none at 0, where a single symbol or line would reject
CUTOFFS = [10, 20, 30, 50, 75, 100, 150, 200, 300, 400, 500, 700]
#: rule name to (numerator, denominator)
RATIOS = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words")}


def repeated_words(words: str) -> tuple[list[tuple[str, Column]], Column]:
    """Steps (column name, expression) and the count of words inside 3-word
    windows that occur twice or more.

    Hashes of the windows, with the position in the low bits, are sorted as
    plain longs; equal neighbours are candidates, and only those are compared
    word by word. n log n for any text.
    """
    n = F.size(F.col(words))
    shift = F.col("_shift")
    window = lambda i: [F.get(F.col(words), i + k) for k in range(3)]
    coded = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.call_function(
        "shiftleft", F.call_function("shiftright", F.xxhash64(*window(i)), shift), shift).bitwiseOR(i.cast("long")))
    high = lambda x: F.call_function("shiftright", x, shift)
    near = F.filter(F.col("_sorted"), lambda x, i: (high(x) == high(F.get(F.col("_sorted"), i - 1))) | (high(x) == high(F.get(F.col("_sorted"), i + 1))))
    low = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), shift) - 1).cast("int")
    exact = F.array_sort(F.transform(F.col("_near"), lambda x: F.struct(F.concat_ws(" ", *window(low(x))).alias("w"), low(x).alias("p"))))
    twice = F.filter(F.col("_exact"), lambda x, i: (x["w"] == F.get(F.col("_exact"), i - 1)["w"]) | (x["w"] == F.get(F.col("_exact"), i + 1)["w"]))
    covered = F.aggregate(F.col("_at"), F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum")),
                          lambda s, p: F.struct((p + 3).alias("end"), (s["sum"] + F.least(F.lit(3), p + 3 - s["end"])).alias("sum")), lambda s: s["sum"])
    none = F.array().cast("array<bigint>")
    steps = [("_shift", F.greatest(F.lit(1), F.length(F.bin(F.coalesce(n, F.lit(0)).cast("long"))))),
             ("_sorted", F.when(n >= 3, F.sort_array(coded)).otherwise(none)), ("_near", F.coalesce(near, none)),
             ("_exact", F.when(F.size("_near") > 0, exact)),
             ("_at", F.when(F.size("_near") > 0, F.sort_array(F.transform(twice, lambda x: x["p"]))))]
    return steps, F.coalesce(covered, F.lit(0))


def features(docs: DataFrame, stratum="lang") -> DataFrame:
    """doc_id, stratum and the counts; one row per row."""
    f = docs.select(F.col("doc_id").cast("long"), F.col(stratum).cast("string").alias("stratum"), F.coalesce("text", F.lit("")).alias("text"))
    f = f.withColumn("_words", F.array_remove(F.split("text", SPACES), ""))
    f = f.withColumn("_lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    steps, repeats = repeated_words("_words")
    for name, step in steps:
        f = f.withColumn(name, step)
    size = lambda c: F.size(c).cast("long")
    return f.select("doc_id", "stratum", size("_words").alias("n_words"), F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
                    F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"), size("_lines").alias("n_lines"),
                    (size("_lines") - size(F.array_distinct("_lines"))).alias("n_dup_lines"), repeats.cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def exceeds(rule: str, cutoff: Column) -> Column:
    """The rule's ratio is above the cutoff; whole numbers only, so exact."""
    a, b = RATIOS[rule]
    return 1000 * F.col(a) > cutoff * F.col(b)


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(Binomial(n, rate) <= k) summed term by term in logarithms; 1 where k is above the mean."""
    odds = F.log(F.lit(rate / (1 - rate)))
    first = n * F.log(F.lit(1 - rate))
    total = F.aggregate(F.sequence(F.lit(0).cast("long"), k), F.struct(first.alias("term"), F.lit(0.0).alias("sum")),
                        lambda s, j: F.struct((s["term"] + F.log((n - j) / (j + 1)) + odds).alias("term"), (s["sum"] + F.exp(s["term"])).alias("sum")), lambda s: s["sum"])
    return F.when(k <= n * rate, total).otherwise(F.lit(1.0))


def cutoffs(good: DataFrame, alpha=0.03, delta=0.05, grid=CUTOFFS) -> DataFrame:
    """stratum, rule, cutoff, n, rejected, p_value: the lowest admitted cutoff of each rule.

    ``good``: features of the labelled good documents. Every document is
    reduced to one sum per stratum before anything is shuffled.
    """
    sums = [F.sum(exceeds(r, F.lit(c)).cast("long")).alias(f"{r}_{c}") for r in RATIOS for c in grid]
    per = good.groupBy("stratum").agg(F.count("*").alias("n"), *sums)
    rows = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"{r}_{c}").alias("rejected")) for r in RATIOS for c in grid]))
    strata = good.select("stratum").distinct().count()
    level = delta / max(1, strata * len(RATIOS))
    tested = per.select("stratum", "n", rows.alias("r")).select("stratum", "n", "r.*").withColumn("p_value", binomial_tail(F.col("rejected"), F.col("n"), alpha / len(RATIOS)))
    best = tested.filter(F.col("p_value") <= level).groupBy("stratum", "rule").agg(F.min(F.struct("cutoff", "n", "rejected", "p_value")).alias("b"))
    return best.select("stratum", "rule", "b.*")


def apply(docs: DataFrame, labels: DataFrame, stratum="lang", **args) -> DataFrame:
    """Features, base_failed, kept and the rule that rejects. labels: doc_id, quality (1 is good)."""
    f = durable(features(docs, stratum))
    good = labels.select(F.col("doc_id").cast("long"), "quality").groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1").select("doc_id")
    chosen = cutoffs(f.join(good, "doc_id", "left_semi"), **args)
    wide = chosen.groupBy(F.col("stratum").alias("_stratum")).agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_{r}") for r in RATIOS])
    # one row per stratum with labels; their number is that of the languages
    f = f.join(F.broadcast(wide), F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    fails = F.coalesce(*[F.when(exceeds(r, F.col(f"_{r}")), F.lit(r)) for r in RATIOS])
    f = f.withColumn("base_failed", base_failed()).withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")).otherwise(fails))
    return f.withColumn("kept", F.col("rejected_by").isNull()).drop("_stratum", *[f"_{r}" for r in RATIOS])
