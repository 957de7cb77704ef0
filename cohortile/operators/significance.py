"""Paired and unpaired tests between models on long (model, metric, value) rows.

Statistics are aggregates over per-value counts; only one row per test
reaches the p-value functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pvalues import mann_whitney_pvalue, signed_rank_pvalue, t_pvalue
from ..plans.ordered import running_sums
from .metrics import combinations_of


def rank_sum_counts(counts: DataFrame, keys, value="value", a="a", b="b") -> DataFrame:
    """Mann-Whitney U of sample a against b from per-value counts."""
    rows = counts.withColumn("_t", F.col(a) + F.col(b))
    placed = running_sums(rows, keys, value, {b: "_below"})
    return placed.groupBy(*keys).agg(
        F.sum(F.col(a) * (F.col("_below") + F.col(b) / 2.0)).alias("u"),
        F.sum(a).alias("n1"), F.sum(b).alias("n2"),
        F.sum((F.col("_t") * F.col("_t") * F.col("_t") - F.col("_t")).cast("double")).alias("tie_term"),
    )


def paired_t(pairs: DataFrame, keys, diff="_d") -> DataFrame:
    n, m, sd = F.count(diff), F.avg(diff), F.stddev_samp(diff)
    return pairs.groupBy(*keys).agg(
        n.alias("n_pairs"),
        F.when((n >= 3) & (sd > 0), m / (sd / F.sqrt(n))).alias("t_stat"))


def signed_rank(pairs: DataFrame, keys, diff="_d") -> DataFrame:
    """Zero differences are dropped; equal sizes share an average rank."""
    d = F.col(diff)
    sizes = pairs.filter(d.isNotNull() & (d != 0)).groupBy(*keys, F.abs(d).alias("_size")).agg(
        F.sum((d > 0).cast("long")).alias("_up"), F.sum((d < 0).cast("long")).alias("_down"))
    rows = sizes.withColumn("_t", F.col("_up") + F.col("_down"))
    placed = running_sums(rows, keys, "_size", {"_t": "_below"})
    rank = F.col("_below") + (F.col("_t") + 1) / 2.0
    return placed.groupBy(*keys).agg(
        F.sum(F.col("_up") * rank).alias("w_plus"), F.sum(F.col("_down") * rank).alias("w_minus"),
        F.sum("_t").alias("n_nonzero"),
        F.sum((F.col("_t") * F.col("_t") * F.col("_t") - F.col("_t")).cast("double")).alias("w_ties"))


def test_statistics(boot: DataFrame, reference: str, iteration="iter", by=("metric",)) -> DataFrame:
    """Per (by, model): paired t, signed-rank and rank-sum statistics of the
    reference against the model, plus means and population stds.

    Paired tests use iterations where both have a value; the rank-sum test
    uses all values. Fewer than three values leave the statistics null.
    """
    by = list(by)
    keys = by + ["model"]
    ref = boot.filter(F.col("model") == reference).select(*by, iteration, F.col("value").alias("_ref"))
    others = boot.filter(F.col("model") != reference)
    pairs = others.join(ref, by + [iteration], "left").withColumn("_d", F.col("_ref") - F.col("value"))
    names = others.select(*keys).distinct()
    side_a = names.join(ref.select(*by, F.col("_ref").alias("value")), by).withColumn("_a", F.lit(1))
    side_b = others.select(*keys, "value").withColumn("_a", F.lit(0))
    values = side_a.unionByName(side_b).filter(F.col("value").isNotNull())
    counts = values.groupBy(*keys, "value").agg(
        F.sum("_a").alias("a"), F.sum(1 - F.col("_a")).alias("b"))
    moments = others.groupBy(*keys).agg(F.avg("value").alias("model_mean"), F.stddev_pop("value").alias("model_std"))
    ref_m = ref.groupBy(*by).agg(F.avg("_ref").alias("reference_mean"), F.stddev_pop("_ref").alias("reference_std"))
    out = (
        moments.join(ref_m, by, "left")
        .join(paired_t(pairs, keys), keys, "left")
        .join(signed_rank(pairs, keys), keys, "left")
        .join(rank_sum_counts(counts, keys), keys, "left")
    )
    enough = (F.col("n1") >= 3) & (F.col("n2") >= 3)
    paired = enough & (F.col("n_pairs") >= 3)
    return out.select(
        *keys, "reference_mean", "reference_std", "model_mean", "model_std", "n1", "n2", "n_pairs",
        F.when(paired, F.col("t_stat")).alias("t_stat"),
        F.when(paired, F.col("w_plus")).alias("w_plus"), F.when(paired, F.col("w_minus")).alias("w_minus"),
        "n_nonzero", "w_ties", F.when(enough, F.col("u")).alias("u"), "tie_term")


def paired_tests(boot: DataFrame, reference: str, iteration="iter", by=("metric",)) -> DataFrame:
    """``test_statistics`` with p-values."""
    s = test_statistics(boot, reference, iteration, by)
    return s.select(
        *by, "model", "reference_mean", "reference_std", "model_mean", "model_std",
        F.col("t_stat").alias("ttest_stat"), t_pvalue("t_stat", (F.col("n_pairs") - 1).cast("double")).alias("ttest_p"),
        F.least("w_plus", "w_minus").alias("wilcoxon_stat"),
        signed_rank_pvalue(F.col("w_plus"), F.col("w_minus"), F.col("n_nonzero").cast("double"), F.col("w_ties"),
                           (F.col("n_pairs") - F.col("n_nonzero")).cast("double")).alias("wilcoxon_p"),
        F.col("u").alias("mannwhitney_stat"),
        mann_whitney_pvalue(F.col("u"), F.col("n1").cast("double"), F.col("n2").cast("double"),
                            F.col("tie_term")).alias("mannwhitney_p"))


def pairwise_statistics(boot: DataFrame, by=("metric",), ddof=1) -> DataFrame:
    """Two-sided rank-sum statistic for each unordered model pair under ``by``.
    Each value row is copied once per partner model, never per partner value."""
    by = list(by)
    vals = boot.filter(F.col("value").isNotNull())
    std = F.stddev_samp("value") if ddof == 1 else F.stddev_pop("value")
    moments = vals.groupBy(*by, "model").agg(F.avg("value").alias("mean"), std.alias("std"))
    pairs = moments.groupBy(*by).agg(F.collect_set("model").alias("_m")).select(
        *by, F.explode(combinations_of(F.col("_m"), 2)).alias("_p"))
    sides = pairs.select(*by, F.col("_p")[0].alias("model1"), F.col("_p")[1].alias("model2"), F.explode(F.array(
        F.struct(F.col("_p")[0].alias("model"), F.lit(1).alias("_a")),
        F.struct(F.col("_p")[1].alias("model"), F.lit(0).alias("_a")))).alias("_s")).select(
        *by, "model1", "model2", "_s.*")
    per_value = vals.groupBy(*by, "model", "value").agg(F.count(F.lit(1)).alias("_c"))
    keys = by + ["model1", "model2"]
    counts = per_value.join(sides, by + ["model"]).groupBy(*keys, "value").agg(
        F.sum(F.col("_a") * F.col("_c")).alias("a"), F.sum((1 - F.col("_a")) * F.col("_c")).alias("b"))

    def moment(i):
        return moments.select(*by, F.col("model").alias(f"model{i}"), F.col("mean").alias(f"mean{i}"),
                              F.col("std").alias(f"std{i}"))

    return rank_sum_counts(counts, keys).join(moment(1), by + ["model1"]).join(moment(2), by + ["model2"]).select(
        *keys, "mean1", "std1", "mean2", "std2", "u", "n1", "n2", "tie_term")


def pairwise_rank_sum(boot: DataFrame, by=("metric",), ddof=1) -> DataFrame:
    s = pairwise_statistics(boot, by, ddof)
    p = mann_whitney_pvalue(F.col("u"), F.col("n1").cast("double"), F.col("n2").cast("double"), F.col("tie_term"))
    return s.withColumn("p_value", p).drop("tie_term")


def display_order(model, first=("pruned", "naive")):
    """Sort key: the named models first (any case), then A to Z."""
    m = F.lower(model)
    out = F.when(m == first[0], F.lit(0))
    for i, name in enumerate(first[1:], 1):
        out = out.when(m == name, F.lit(i))
    return out.otherwise(F.lit(len(first)))


def model_summary_with_reference(boot: DataFrame, comparisons: DataFrame, reference="pruned", by=("metric",),
                                 ddof=1, alpha=0.05) -> DataFrame:
    """Mean and std per model, display order and a flag from the comparison of
    the model with the reference, whichever way round the pair is stored."""
    by = list(by)
    std = F.stddev_samp("value") if ddof == 1 else F.stddev_pop("value")
    s = boot.filter(F.col("value").isNotNull()).groupBy(*by, "model").agg(
        F.avg("value").alias("mean"), std.alias("std"))
    cmp = comparisons.filter((F.col("model1") == reference) | (F.col("model2") == reference)).select(
        *by, F.when(F.col("model1") == reference, F.col("model2")).otherwise(F.col("model1")).alias("model"), "p_value")
    return s.join(cmp, by + ["model"], "left").select(
        *by, "model", "mean", "std", "p_value",
        F.coalesce(F.col("p_value") < alpha, F.lit(False)).alias("significant"),
        display_order(F.col("model"), (reference, "naive")).alias("group_order"))
